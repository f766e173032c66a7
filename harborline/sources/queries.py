"""Queries over the readers and writers: a table goes out through a writer, or as a file of the layout, and comes back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import micros, table, written_dir
from harborline.operators.near import on_globe
from harborline.operators.tides import hours, predict, predict_sql, published_models
from harborline.sources import sinks, text


def folder(spark, label: str) -> str:
    return f"{written_dir(spark)}/{label}-{uuid.uuid4().hex}"


def as_csv(df: DataFrame, label: str) -> str:
    """df as CSV files with a header in the shared folder; nulls are blanks."""
    path = folder(df.sparkSession, label)
    df.write.csv(path, header=True, emptyValue="", nullValue="")
    return path


def _iso(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _obs(spark, d: str) -> DataFrame:
    return table(spark, d, "obs").where("t IS NOT NULL")


def _levels(spark, d: str) -> DataFrame:
    return _obs(spark, d).where("station IS NOT NULL AND height IS NOT NULL AND NOT isnan(height)")


def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy(F.unix_micros("t").alias("us"), (F.col("height") + 0.0).alias("height")).agg(F.count(F.lit(1)).alias("n"))


def ref_read_gauge(spark, d: str) -> DataFrame:
    """Readings written as gauge files by station (whole seconds, four decimals) and read back."""
    path = folder(spark, "gauges")
    sinks.write_gauges(_levels(spark, d).select("station", micros(F.col("t")).alias("us"), "height"), path)
    return _counted(text.gauge_csv(spark, path))


def ref_read_portal(spark, d: str) -> DataFrame:
    """A portal's answer with quality flags: what is at least processed."""
    flag = F.expr("CASE upload_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'Processed' ELSE 'validated' END")
    path = as_csv(_obs(spark, d).select("obs_id", _iso("t").alias("observation_time"), F.col("height").alias("sea_level_m"), flag.alias("quality")), "portal")
    return _counted(text.portal_csv(spark, path, "processed"))


def ref_read_noaa(spark, d: str) -> DataFrame:
    """Water levels by 'Date Time' and 'Water Level'; blank levels are gaps."""
    path = as_csv(_obs(spark, d).select(_iso("t").alias("Date Time"), F.when(~F.isnan("height"), F.col("height")).alias("Water Level"), F.lit(0.01).alias("Sigma")), "levels")
    return _counted(text.noaa_csv(spark, path))


def _events(spark, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts IS NOT NULL AND value IS NOT NULL").groupBy("ts").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))


def ref_read_weather(spark, d: str) -> DataFrame:
    """Wind and pressure answers joined on their times."""
    e = _events(spark, d)
    wind = as_csv(e.where("event_id % 5 <> 0").select(_iso("ts").alias("Date Time"), F.col("value").alias("Speed"), F.expr("event_id % 360").alias("Direction"), F.lit("W").alias("Dir")), "wind")
    pressure = as_csv(e.where("event_id % 7 <> 0").select(_iso("ts").alias("Date Time"), F.expr("990 + event_id % 40").alias(" Pressure")), "pressure")
    got = text.noaa_weather(text.noaa_wind_csv(spark, wind), text.noaa_pressure_csv(spark, pressure))
    return got.select(F.unix_micros("t").alias("us"), "wind_speed", "wind_dir", "pressure")


def ref_read_met(spark, d: str) -> DataFrame:
    """Weather files with columns in another order and one more; rows with bad cells are dropped."""
    e = _events(spark, d)
    rows = e.select(F.expr("990 + event_id % 40").alias("pressure"), F.lit("x").alias("remark"), F.expr("CASE WHEN event_id % 11 = 0 THEN 'calm' ELSE CAST(value AS STRING) END").alias("wind_speed"), _iso("ts").alias("time"), F.expr("event_id % 360").alias("wind_dir"))
    return text.weather_csv(spark, as_csv(rows, "met")).select(F.unix_micros("t").alias("us"), "wind_speed", "wind_dir", "pressure")


def ref_read_discharge(spark, d: str) -> DataFrame:
    """River discharge by time."""
    got = text.discharge_csv(spark, as_csv(_events(spark, d).select(_iso("ts").alias("time"), F.col("value").alias("discharge")), "discharge"))
    return got.select(F.unix_micros("t").alias("us"), "discharge")


def ref_read_altimetry(spark, d: str) -> DataFrame:
    """Satellite heights: time, position, height."""
    got = text.altimetry_csv(spark, as_csv(_events(spark, d).select(_iso("ts").alias("time"), F.expr("event_id % 3600 / 10.0 - 180").alias("lon"), F.expr("event_id % 1700 / 10.0 - 85").alias("lat"), F.col("value").alias("ssh")), "altimetry"))
    return got.select(F.unix_micros("t").alias("us"), "lon", "lat", "ssh")


def ref_read_coordinates(spark, d: str) -> DataFrame:
    """Positions of stations; those without one are dropped."""
    return text.coordinates_csv(spark, as_csv(table(spark, d, "gauges").select("station", "lon", "lat"), "places"))


def ref_read_grid(spark, d: str) -> DataFrame:
    """Harmonic grid files: one row per position and constituent."""
    g = table(spark, d, "grid").where(on_globe("lon", "lat") & F.col("constituent").isNotNull() & F.col("amplitude").isNotNull() & F.col("phase").isNotNull())
    one = g.groupBy(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "constituent").agg(F.max(F.struct("amplitude", "phase")).alias("m")).select("lon", "lat", "constituent", "m.*")
    return text.grid_csv(spark, as_csv(one, "grid"))


def ref_read_harmonics(spark, d: str) -> DataFrame:
    """Published harmonics as JSON documents, one file a region: constituents with cosine and sine parts."""
    path = folder(spark, "harmonics")
    doc = F.to_json(F.struct("station", F.col("region_name").alias("region"), "lat", "lon", "mean", "constituents"))
    g = table(spark, d, "gauges").where("station IS NOT NULL AND constituents IS NOT NULL").groupBy(F.coalesce("region_name", F.lit("-")).alias("r")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(doc), ","), F.lit("]")).alias("value"))
    g.repartition("r").write.partitionBy("r").text(path)
    got = text.harmonics_json(spark, path)
    return got.select("station", F.size("constituents").alias("n"), F.round(F.aggregate("coef", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def ref_read_harmonic_text(spark, d: str) -> DataFrame:
    """Constants written as harmonic text files, one a station, and read back."""
    path = folder(spark, "harmonic-text")
    models = table(spark, d, "gauges").where("station IS NOT NULL AND size(constituents) > 0").select("station", "mean", "constituents").dropDuplicates(["station"])
    sinks.write_harmonic_text(models, path)
    got = text.harmonic_text(spark, path).select("station", "mean", F.explode("constituents").alias("c"))
    return got.select("station", F.round("mean", 6).alias("mean"), "c.name", F.round("c.amplitude", 5).alias("amplitude"), F.round("c.phase", 3).alias("phase"))


def ref_read_models(spark, d: str) -> DataFrame:
    """Models written as JSON documents and read back."""
    path = folder(spark, "models")
    models = table(spark, d, "gauges").where("station IS NOT NULL").select("station", "mean", "constituents")
    sinks.write_models(models, path)
    got = spark.read.schema(models.schema).json(path)
    return got.select("station", "mean", F.coalesce(F.size("constituents"), F.lit(0)).alias("n"), F.round(F.aggregate("constituents", F.lit(0.0), lambda a, c: a + c["amplitude"]), 6).alias("amplitudes"))


def ref_write_feed(spark, d: str) -> DataFrame:
    """A day's curves written as prediction feeds by station and read back."""
    path = folder(spark, "feed")
    models = published_models(table(spark, d, "gauges"))
    curve = predict(hours(models, "2025-01-01", 1), models)
    sinks.write_feed(curve.withColumn("tide", F.round("tide", 4)).selectExpr("station", "us", "tide AS mean", "tide - 0.2 AS lower", "tide + 0.2 AS upper", "CAST(0.1 AS DOUBLE) AS se"), path)
    got = spark.read.schema("time string, height_m double, lower_m double, upper_m double, se_m double, station string").csv(path, header=True)
    return got.select("station", F.unix_seconds(F.to_timestamp("time")).alias("unix_s"), *((F.round(c, 4) + 0.0).alias(c) for c in ("height_m", "lower_m", "upper_m", "se_m")))


QUERIES = {
    f.__name__: f
    for f in (
        ref_read_gauge, ref_read_portal, ref_read_noaa, ref_read_weather, ref_read_met, ref_read_discharge, ref_read_altimetry, ref_read_coordinates, ref_read_grid,
        ref_read_harmonics, ref_read_harmonic_text, ref_read_models, ref_write_feed,
    )
}

_HAVE = "height IS NOT NULL AND NOT isnan(height) AND t IS NOT NULL"
_E = "e AS (SELECT ts, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1)"
_DAY_AT = "(SELECT station, epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') + hour * 3600000000 AS us FROM gauges, range(24) AS r(hour))"
SQL = {
    "ref_read_gauge": f"SELECT epoch_us(t) // 1000000 * 1000000 AS us, round(height, 4) + 0.0 AS height, count(*) AS n FROM obs WHERE station IS NOT NULL AND {_HAVE} GROUP BY 1, 2",
    "ref_read_portal": f"SELECT epoch_us(t) AS us, height + 0.0 AS height, count(*) AS n FROM obs WHERE {_HAVE} AND upload_id % 3 <> 0 GROUP BY 1, 2",
    "ref_read_noaa": f"SELECT epoch_us(t) AS us, height + 0.0 AS height, count(*) AS n FROM obs WHERE {_HAVE} GROUP BY 1, 2",
    "ref_read_weather": f"WITH {_E} SELECT epoch_us(ts) AS us, value AS wind_speed, CAST(event_id % 360 AS DOUBLE) AS wind_dir, CAST(990 + event_id % 40 AS DOUBLE) AS pressure FROM e WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "ref_read_met": f"WITH {_E} SELECT epoch_us(ts) AS us, value AS wind_speed, CAST(event_id % 360 AS DOUBLE) AS wind_dir, CAST(990 + event_id % 40 AS DOUBLE) AS pressure FROM e WHERE event_id % 11 <> 0",
    "ref_read_discharge": f"WITH {_E} SELECT epoch_us(ts) AS us, value AS discharge FROM e",
    "ref_read_altimetry": f"WITH {_E} SELECT epoch_us(ts) AS us, CAST(event_id % 3600 / 10.0 - 180 AS DOUBLE) AS lon, CAST(event_id % 1700 / 10.0 - 85 AS DOUBLE) AS lat, value AS ssh FROM e",
    "ref_read_coordinates": "SELECT station, lon, lat FROM gauges WHERE station IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat)",
    "ref_read_grid": "WITH m AS (SELECT round(lon, 6) AS lon, round(lat, 6) AS lat, constituent, max({'amplitude': amplitude, 'phase': phase}) AS m FROM grid WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360 AND constituent IS NOT NULL AND amplitude IS NOT NULL AND phase IS NOT NULL GROUP BY 1, 2, 3) SELECT lon, lat, constituent, m.amplitude AS amplitude, m.phase AS phase FROM m",
    "ref_read_harmonics": "SELECT station, CAST(len(constituents) AS INT) AS n, round(coalesce(mean, 0.0) + list_sum(list_transform(constituents, lambda c: c.amplitude * cos(radians(c.phase)) + c.amplitude * sin(radians(c.phase)))), 5) AS total FROM gauges WHERE station IS NOT NULL AND constituents IS NOT NULL",
    "ref_read_harmonic_text": "SELECT station, round(coalesce(mean, 0.0), 6) AS mean, c.name AS name, round(c.amplitude, 5) AS amplitude, round(c.phase, 3) AS phase FROM (SELECT station, mean, unnest(constituents) AS c FROM gauges WHERE station IS NOT NULL)",
    "ref_read_models": "SELECT station, mean, CAST(coalesce(len(constituents), 0) AS INT) AS n, round(list_sum(list_transform(constituents, lambda c: c.amplitude)), 6) AS amplitudes FROM gauges WHERE station IS NOT NULL",
    "ref_write_feed": f"SELECT station, us // 1000000 AS unix_s, round(tide, 4) + 0.0 AS height_m, round(round(tide, 4) - 0.2, 4) + 0.0 AS lower_m, round(round(tide, 4) + 0.2, 4) + 0.0 AS upper_m, CAST(0.1 AS DOUBLE) AS se_m FROM {predict_sql(_DAY_AT)}",
}
