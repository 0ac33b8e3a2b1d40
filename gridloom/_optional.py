"""Optional packages and version reports."""

from __future__ import annotations

import importlib
import platform
from typing import Any

from .errors import MissingDependencyError


def import_optional(name: str, purpose: str) -> Any:
    """A package that isn't always installed."""
    try:
        return importlib.import_module(name)
    except ImportError as error:
        raise MissingDependencyError(f"{purpose} needs the package {name}; install it with: pip install {name}") from error


def show_versions() -> None:
    """Prints the versions of what the engine runs on."""
    print(f"python: {platform.python_version()}")
    for name in ("gridloom", "pyspark", "numpy", "pyarrow", "pandas", "xarray"):
        try:
            print(f"{name}: {importlib.import_module(name).__version__}")
        except ImportError:
            print(f"{name}: not installed")
