"""Projections and datums against published points, and there and back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import ValidationError
from gridloom.functions.crs import definition
from gridloom.functions.projection import convert, convert_arrays, convert_columns

CLARKE = "+ellps=clrk66"
#: Published examples: projection, its geographic system, longitude, latitude, easting, northing, and to what they are given.
POINTS = [
    ("+proj=lcc +lat_0=27.8333333333333 +lon_0=-99 +lat_1=28.3833333333333 +lat_2=30.2833333333333 +x_0=609601.2192024384 +y_0=0 +units=us-ft " + CLARKE, "+proj=longlat " + CLARKE, -96, 28.5, 2963503.91, 254759.80, 0.01),
    ("+proj=lcc +lat_0=18 +lon_0=-77 +lat_1=18 +k=1 +x_0=250000 +y_0=150000 " + CLARKE, "+proj=longlat " + CLARKE, -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.8 / 3600, 255966.58, 142493.51, 0.01),
    ("EPSG:32661", "EPSG:4326", 44, 73, 3320416.75, 632668.43, 0.01),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", "EPSG:4326", 120, -75, 7255380.79, 7053389.56, 0.01),
    ("EPSG:3035", "EPSG:4258", 5, 50, 3962799.45, 2999718.85, 0.01),
    ("+proj=aea +lat_0=23 +lon_0=-96 +lat_1=29.5 +lat_2=45.5 " + CLARKE, "+proj=longlat " + CLARKE, -75, 35, 1885472.7, 1535925.0, 0.1),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", "+proj=longlat +ellps=airy", 0.5, 50.5, 577274.99, 69740.50, 0.01),
    ("+proj=merc +lon_0=110 +k=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", "+proj=longlat +ellps=bessel", 120, -3, 5009726.58, 569150.82, 0.01),
    ("+proj=sinu +lon_0=-90 " + CLARKE, "+proj=longlat " + CLARKE, -75, -50, 1075471.5, -5540628.0, 0.1),
    ("EPSG:3857", "EPSG:4326", -(100 + 20 / 60), 24 + 22 / 60 + 54.433 / 3600, -11169055.58, 2800000.00, 0.01),
]


@pytest.mark.parametrize("crs,geographic,lon,lat,x,y,to", POINTS)
def test_published_points(spark, crs, geographic, lon, lat, x, y, to):
    got = convert(geographic, crs, lon, lat)
    assert got == pytest.approx((x, y), abs=to)
    df, u, v = convert_columns(spark.createDataFrame([(float(lon), float(lat))], "x double, y double"), geographic, crs, F.col("x"), F.col("y"))
    assert tuple(df.select(u.alias("u"), v.alias("v")).first()) == pytest.approx(got, abs=1e-6)
    df, u, v = convert_columns(spark.createDataFrame([got], "x double, y double"), crs, geographic, F.col("x"), F.col("y"))
    assert tuple(df.select(u.alias("u"), v.alias("v")).first()) == pytest.approx((lon, lat), abs=1e-9)


AREAS = {
    "EPSG:3034": (-10, 35, 30, 70), "EPSG:3035": (-10, 35, 30, 70), "EPSG:2154": (-5, 41, 10, 51), "EPSG:5070": (-125, 24, -66, 50), "EPSG:3577": (112, -44, 154, -9), "EPSG:3031": (-180, -90, 180, -60), "EPSG:3413": (-180, 60, 180, 90), "EPSG:3395": (-180, -80, 180, 80), "EPSG:6931": (-180, 0, 180, 90), "EPSG:6932": (-180, -90, 180, 0),
    "EPSG:27700": (-8, 49, 2, 61), "EPSG:31467": (7, 47, 12, 55), "EPSG:32719": (-72, -60, -66, 0), "EPSG:25832": (6, 40, 12, 60), "EPSG:26911": (-120, 30, -114, 50), "+proj=sinu +R=6371007.181": (-170, -85, 170, 85), "EPSG:3857": (-180, -85, 180, 85), "+proj=longlat +datum=potsdam": (6, 47, 15, 55),
}


@pytest.mark.parametrize("crs", AREAS)
def test_there_and_back_within_a_millimetre(crs):
    w, s, e, n = AREAS[crs]
    r = np.random.default_rng(0)
    lon, lat = r.uniform(w, e, 2000), r.uniform(s, n, 2000)
    a, b = convert_arrays(crs, "EPSG:4326", *convert_arrays("EPSG:4326", crs, lon, lat))
    d = (a - lon + 180) % 360 - 180
    assert np.hypot(d * np.cos(np.radians(lat)), b - lat).max() * 111e6 < 1


def test_datums():
    lon, lat = convert("EPSG:27700", "EPSG:4326", 651409.903, 313177.270)
    assert (lon, lat) == pytest.approx((1.716052, 52.657979), abs=2e-6)  # the survey's own worked example, by seven parameters


def test_wkt():
    wkt = 'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",49],PARAMETER["standard_parallel_2",44],PARAMETER["latitude_of_origin",46.5],PARAMETER["central_meridian",3],PARAMETER["false_easting",700000],PARAMETER["false_northing",6600000],UNIT["metre",1]]'
    assert convert("EPSG:4258", wkt, 2.35, 48.85) == pytest.approx(convert("EPSG:4258", "EPSG:2154", 2.35, 48.85), abs=1e-6)
    polar = 'PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["WGS 84",6378137,298.257223563]]],PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",-71],PARAMETER["central_meridian",0],UNIT["metre",1]]'
    assert convert("EPSG:4326", polar, 30.0, -80.0) == pytest.approx(convert("EPSG:4326", "EPSG:3031", 30.0, -80.0), abs=1e-6)


def test_unknown_systems():
    for crs in ("EPSG:99999", "+proj=robin", "+proj=stere +lat_0=45", "+proj=lcc +lat_1=10 +lat_2=-10", "nonsense", None, "+proj=utm +zone=33 +datum=nowhere", "+proj=longlat +towgs84=1,2"):
        with pytest.raises(ValidationError):
            definition(crs)
    assert math.isclose(definition("EPSG:32733").y_0, 1e7)
