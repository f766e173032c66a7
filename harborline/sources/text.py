"""Readers of delimited text and JSON: gauge, weather, river, satellite, register, grid and harmonics files.

All columns are read as text against an explicit schema and cast with try_cast, so bad rows become nulls and are dropped (or
raise, where a reader says so). Folders and globs are read like single files; nothing is inferred, nothing is collected but
header lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.common import iso_instant


def _number(c: str) -> Column:
    v = F.col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def _instant(c: str) -> Column:
    """UTC timestamp of ISO text with blanks around it; 'z' counts as Z; compact dates have none."""
    return F.timestamp_micros(iso_instant(F.regexp_replace(F.trim(F.col(c)), "z$", "Z")))


def columns(spark: SparkSession, path: str, wanted: dict[str, list[str]], positional: bool = True, comment: str | None = None) -> DataFrame:
    """Text columns by header name: wanted maps the new name to lower-case headers, a trailing * standing for any rest.

    The first line of the files decides. Without a header the wanted order is taken if `positional`, else it raises. Columns
    not wanted are not read. Repeated headers inside the data are dropped by the casts that follow.
    """
    reader = spark.read.option("comment", comment) if comment else spark.read
    head = spark.read.text(path).where("trim(value) <> ''" + (f" AND NOT startswith(value, '{comment}')" if comment else "")).limit(1).collect()
    names = [h.strip().strip('"').lower().lstrip("﻿") for h in head[0][0].split(",")] if head else []

    def find(patterns: list[str]) -> int | None:
        for p in patterns:
            for k, n in enumerate(names):
                if n == p or (p.endswith("*") and p.strip("*") in n if p.startswith("*") else p.endswith("*") and n.startswith(p[:-1])):
                    return k
        return None

    at = {n: find(p) for n, p in wanted.items()}
    if all(v is None for v in at.values()):
        if names and not positional:
            raise ValueError(f"{path}: none of the columns {list(wanted)} in the header")
        at = {n: k for k, n in enumerate(wanted)}
    elif lacking := [n for n, v in at.items() if v is None]:
        raise ValueError(f"{path}: no column for {lacking}")
    width = max(max(at.values()) + 1, len(names))
    schema = ", ".join(f"_{k} string" for k in range(width))
    return reader.schema(schema).csv(path, mode="PERMISSIVE", multiLine=False).select(*(F.col(f"_{k}").alias(n) for n, k in at.items()), F.col("_metadata.file_name").alias("file_name"))


def gauge_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """time, height -> (t, height, file_name). Rows without a time are dropped; bad heights are dropped, or raise if `strict`."""
    raw = columns(spark, path, {"time": ["time", "date time"], "height": ["height", "water level"]})
    height = F.col("height").cast("double") if strict else _number("height")
    got = raw.withColumn("t", _instant("time")).where("t IS NOT NULL").select("t", height.alias("height"), "file_name")
    return got if strict else got.where("height IS NOT NULL")


def feed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A gauge CSV in order of time; equal times keep the lower height first."""
    return gauge_csv(spark, path).orderBy("t", "height")


def noaa_csv(spark: SparkSession, path: str) -> DataFrame:
    """'Date Time', 'Water Level' wherever they stand -> (t, height); blank levels are gaps and are skipped."""
    raw = columns(spark, path, {"time": ["date time"], "height": ["water level"]}, positional=False)
    return raw.select(_instant("time").alias("t"), _number("height").alias("height")).dropna()


def weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """time, wind_speed, wind_dir, pressure -> (t, ...); further columns are ignored, rows with bad cells dropped."""
    names = ["wind_speed", "wind_dir", "pressure"]
    raw = columns(spark, path, {"time": ["time"], **{n: [n] for n in names}})
    return raw.select(_instant("time").alias("t"), *(_number(n).alias(n) for n in names)).dropna()


def noaa_weather(wind: DataFrame, pressure: DataFrame) -> DataFrame:
    """wind(t, wind_speed, wind_dir), pressure(t, pressure) -> rows that have all three, one a time."""
    return wind.dropna().dropDuplicates(["t"]).join(pressure.dropna().dropDuplicates(["t"]), "t")


def noaa_wind_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = columns(spark, path, {"time": ["date time"], "wind_speed": ["speed"], "wind_dir": ["direction", "dir*"]}, positional=False)
    return raw.select(_instant("time").alias("t"), _number("wind_speed").alias("wind_speed"), _number("wind_dir").alias("wind_dir")).dropna()


def noaa_pressure_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = columns(spark, path, {"time": ["date time"], "pressure": ["*pressure*"]}, positional=False)
    return raw.select(_instant("time").alias("t"), _number("pressure").alias("pressure")).dropna()


def discharge_csv(spark: SparkSession, path: str) -> DataFrame:
    """time, discharge -> (t, discharge)."""
    raw = columns(spark, path, {"time": ["time"], "discharge": ["discharge"]})
    return raw.select(_instant("time").alias("t"), _number("discharge").alias("discharge")).dropna()


def altimetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """time, lon, lat, ssh -> (t, lon, lat, ssh)."""
    raw = columns(spark, path, {n: [n] for n in ("time", "lon", "lat", "ssh")})
    return raw.select(_instant("time").alias("t"), *(_number(n).alias(n) for n in ("lon", "lat", "ssh"))).dropna()


def coordinates_csv(spark: SparkSession, path: str) -> DataFrame:
    """station, lon, lat (header optional, # comments) -> positions; unreadable rows dropped."""
    raw = columns(spark, path, {n: [n] for n in ("station", "lon", "lat")}, comment="#")
    return raw.select(F.trim("station").alias("station"), _number("lon").alias("lon"), _number("lat").alias("lat")).dropna()


def grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, constituent, amplitude, phase -> one row per point (6 decimals) and constituent, the last in the file."""
    raw = columns(spark, path, {n: [n] for n in ("lon", "lat", "constituent", "amplitude", "phase")})
    rows = raw.select(F.round(_number("lon"), 6).alias("lon"), F.round(_number("lat"), 6).alias("lat"), F.trim("constituent").alias("constituent"), _number("amplitude").alias("amplitude"), _number("phase").alias("phase"), "file_name", F.monotonically_increasing_id().alias("_at")).dropna()
    return rows.groupBy("lon", "lat", "constituent").agg(F.max_by(F.struct("amplitude", "phase"), F.struct("file_name", "_at")).alias("m")).select("lon", "lat", "constituent", "m.*")


QUALITY = {"raw": 0, "processed": 1, "validated": 2}


def portal_csv(spark: SparkSession, path: str, least: str | None = None) -> DataFrame:
    """First header containing 'time', first containing 'value' or 'level' -> (t, height) in order of time.

    With `least` only rows whose 'quality' is at least that (raw < processed < validated); unknown and missing flags count
    as below.
    """
    wanted = {"time": ["*time*"], "height": ["*value*", "*level*"]} | ({"quality": ["*quality*"]} if least else {})
    raw = columns(spark, path, wanted, positional=False)
    if least:
        rank = F.create_map(*(F.lit(x) for p in QUALITY.items() for x in p))
        raw = raw.where(F.coalesce(F.element_at(rank, F.lower(F.trim("quality"))), F.lit(-1)) >= QUALITY[least])
    return raw.select(_instant("time").alias("t"), _number("height").alias("height")).dropna().orderBy("t")


HARMONICS = "station string, region string, lat double, lon double, mean double, constituents array<struct<name string, amplitude double, phase double>>"


def harmonics_json(spark: SparkSession, path: str) -> DataFrame:
    """Published harmonics, one JSON document a file -> (station, ..., constituents) with cosine and sine parts in `coef`."""
    got = spark.read.schema(HARMONICS + ", _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE")
    part = F.flatten(F.transform("constituents", lambda c: F.array(c["amplitude"] * F.cos(F.radians(c["phase"])), c["amplitude"] * F.sin(F.radians(c["phase"])))))
    return got.where("constituents IS NOT NULL").drop("_corrupt_record").withColumn("coef", F.concat(F.array(F.coalesce("mean", F.lit(0.0))), part))


PACK = "name string, constituents array<struct<name string, doodson array<int>, phase0 double, species string, nodal string, f_power double, u_power double>>"


def constituent_packs(spark: SparkSession, path: str) -> DataFrame:
    """Constituent packs, one JSON document a file; unreadable files and constituents without six Doodson numbers are left out.

    Of a constituent defined twice the definition of the first pack by name holds.
    """
    got = spark.read.schema(PACK).json(path, multiLine=True, mode="DROPMALFORMED").where("constituents IS NOT NULL")
    each = got.select(F.col("name").alias("pack"), F.explode("constituents").alias("c")).where("c.name IS NOT NULL AND size(c.doodson) = 6")
    best = each.groupBy("c.name").agg(F.min_by("c", "pack").alias("c"), F.min("pack").alias("pack"))
    return best.selectExpr("c.name", "c.doodson", "coalesce(c.phase0, 0.0) AS phase0", "coalesce(c.species, 'unknown') AS species", "coalesce(c.nodal, 'unity') AS nodal", "coalesce(c.f_power, 1.0) AS f_power", "coalesce(c.u_power, 1.0) AS u_power", "pack")


def harmonic_text(spark: SparkSession, path: str) -> DataFrame:
    """Files of '# key: value' headers and 'name amplitude phase' lines -> (station, datum, mean, constituents)."""
    lines = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    key = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^# {k}:(.*)$", 1)), F.lit(""))
    rows = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda p: (F.size(p) == 3) & ~p[0].startswith("#") & p[1].try_cast("double").isNotNull() & p[2].try_cast("double").isNotNull())
    each = F.transform(rows, lambda p: F.struct(p[0].alias("name"), p[1].cast("double").alias("amplitude"), p[2].cast("double").alias("phase")))
    return lines.select("file_name", key("station").alias("station"), F.coalesce(key("datum"), F.lit("MLLW")).alias("datum"), F.coalesce(key("mean_level_m").try_cast("double"), F.lit(0.0)).alias("mean"), each.alias("constituents"))
