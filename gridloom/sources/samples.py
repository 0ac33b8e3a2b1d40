"""Sample files: a registry of names and checksums over a local cache. Nothing is downloaded here."""

from __future__ import annotations

import hashlib
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DatasetError


def cache_dir() -> Path:
    """GRIDLOOM_DATA_DIR, else the user's cache folder."""
    own = os.environ.get("GRIDLOOM_DATA_DIR")
    if own:
        return Path(own)
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "gridloom"


def checksum(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def ensure_asset(name: str, sha256: str, source: str | os.PathLike | None = None) -> Path:
    """The cached file of a name; copied from ``source`` if missing, refused if its checksum differs."""
    path = cache_dir() / name
    if not path.exists():
        if source is None or not os.path.exists(source):
            raise DatasetError(f"{name} isn't in {cache_dir()} and no source is at hand")
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(path.suffix + ".part")
        shutil.copyfile(source, part)
        part.replace(path)
    if checksum(path) != sha256:
        path.unlink()
        raise DatasetError(f"{name} is damaged")
    return path


class SampleFile(os.PathLike):
    """A sample's path, fetched and checked when it is first used."""

    def __init__(self, name: str, sha256: str, source: str | None = None):
        self.name, self.sha256, self.source = name, sha256, source
        self._path: Path | None = None

    def fetch(self) -> Path:
        self._path = self._path or ensure_asset(self.name, self.sha256, self.source)
        return self._path

    def __fspath__(self) -> str:
        return str(self.fetch())

    def __repr__(self) -> str:
        return f"SampleFile({self.name!r})"


def load_sample_dataset(registry: dict[str, tuple[str, str | None]], prefetch: bool = False) -> dict[str, SampleFile]:
    """Handles of a registry {name: (sha256, source)}; ``prefetch`` checks all of them now."""
    files = {n: SampleFile(n, *v) for n, v in registry.items()}
    if prefetch:
        for f in files.values():
            f.fetch()
    return files


def verified_files(spark: SparkSession, path: str, registry: dict[str, str]) -> DataFrame:
    """name, ok of many stored files against {name: sha256}, hashed on the executors."""
    known = spark.createDataFrame(list(registry.items()), "name string, sha256 string")
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    return known.join(found, "name", "left").select("name", F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False)).alias("ok"))
