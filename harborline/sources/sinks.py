"""Writers: prediction feeds, gauge files, model documents, harmonic text. All write in parallel, one folder a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _iso(c: str = "us"):
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss+00:00")


def write_feed(curves: DataFrame, path: str) -> None:
    """curves(station, us, mean, lower, upper, se) -> time,height_m,lower_m,upper_m,se_m with six decimals, by station."""
    cols = [F.format_string("%.6f", c).alias(n) for c, n in (("mean", "height_m"), ("lower", "lower_m"), ("upper", "upper_m"), ("se", "se_m"))]
    out = curves.select("station", _iso().alias("time"), *cols)
    out.repartition("station", F.substring("time", 1, 7)).sortWithinPartitions("station", "time").write.partitionBy("station").csv(path, header=True)


def write_gauges(obs: DataFrame, path: str) -> None:
    """obs(station, us, height) -> time,height with four decimals, by station; the layout gauge_csv() reads."""
    out = obs.select("station", _iso().alias("time"), F.format_string("%.4f", "height").alias("height"))
    out.repartition("station", F.substring("time", 1, 7)).sortWithinPartitions("station", "time").write.partitionBy("station").csv(path, header=True)


def write_models(models: DataFrame, path: str) -> None:
    """Fitted models as JSON documents, one a line; covariance is left out where the model has none."""
    models.write.json(path, ignoreNullFields=True)


def harmonic_text(models: DataFrame) -> DataFrame:
    """models(station, mean, constituents) -> (station, value): header and 'name amplitude phase' lines."""
    lines = F.transform("constituents", lambda c: F.format_string("%s %.6f %.4f", c["name"], c["amplitude"], c["phase"]))
    head = F.format_string("# station: %s\n# datum: MLLW\n# mean_level_m: %.6f", "station", F.coalesce("mean", F.lit(0.0)))
    return models.select("station", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("value"))


def write_harmonic_text(models: DataFrame, path: str) -> None:
    """One folder a station, one text file each."""
    harmonic_text(models).write.partitionBy("station").text(path)
