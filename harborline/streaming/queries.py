"""Queries that run the live operators: readings are laid down as feed files and taken in by a stream that stops when all are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import table, written_dir
from harborline.operators.fitting import BASIC
from harborline.operators.scores import _P as SCORED_SQL
from harborline.operators.scores import persistence
from harborline.streaming import live


def _paths(spark, label: str) -> tuple[str, str, str]:
    root = f"{written_dir(spark)}/{label}-{uuid.uuid4().hex}"
    return f"{root}/in", f"{root}/out", f"{root}/state"


def _laid(spark, d: str, path: str) -> None:
    rows = table(spark, d, "obs").where("station IS NOT NULL AND t IS NOT NULL")
    rows.select("station", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.when(~F.isnan("height"), F.col("height"))).coalesce(8).write.csv(path)


def ref_stream_first(spark, d: str) -> DataFrame:
    """The feed with one reading per station and instant: readings and instants of each station."""
    source, out, state = _paths(spark, "first")
    _laid(spark, d, source)
    live.run_once(live.first_wins(live.feed(spark, source)), out, state)
    return spark.read.schema(live.FEED).parquet(out).groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("instants"))


def ref_stream_hourly(spark, d: str) -> DataFrame:
    """Hourly figures of the feed, of the hours that the watermark has passed."""
    source, out, state = _paths(spark, "hourly")
    _laid(spark, d, source)
    live.run_once(live.hourly(live.feed(spark, source)), out, state)
    got = spark.read.schema("station string, hour timestamp, n long, mean double, low double, high double").parquet(out)
    return got.select("station", F.unix_seconds("hour").alias("unix_s"), "n", *((F.col(c) + 0.0).alias(c) for c in ("low", "high")), (F.round("mean", 6) + 0.0).alias("mean"))


def ref_stream_rerun(spark, d: str) -> DataFrame:
    """A second run over the same feed takes nothing in twice: readings of each station after both."""
    source, out, state = _paths(spark, "rerun")
    _laid(spark, d, source)
    for _ in range(2):
        live.run_once(live.feed(spark, source), out, state)
    return spark.read.schema(live.FEED).parquet(out).groupBy("station").agg(F.count(F.lit(1)).alias("n"))


def ref_health(spark, d: str) -> DataFrame:
    """Rolling health of the persistence forecast at each station: the last window's coverage, RMSE and bias, and whether a refit is due."""
    source, out, state = _paths(spark, "health")
    # Times made distinct by the id, so that the last readings are the same ones everywhere.
    persistence(spark, d).selectExpr("station", "us * 1000 + obs_id % 1000 AS us", "height - mean AS error", "sigma AS se").write.parquet(source)
    stream = spark.readStream.schema("station string, us long, error double, se double").option("maxFilesPerTrigger", 10_000).parquet(source)
    write = lambda batch, _: batch.write.mode("append").parquet(out)
    live.Health().over(stream).writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(live.Health.OUT).parquet(out)
    return got.select("station", "n", *(F.round(c, 6).alias(c) for c in ("coverage", "rmse", "bias")), "needs_refit")


def ref_nowcast(spark, d: str) -> DataFrame:
    """The nowcast started without models over the whole feed: forecasts made, RMSE and bias of each station."""
    source, out, state = _paths(spark, "nowcast")
    _laid(spark, d, source)
    live.run_once(live.Nowcast([], BASIC).over(live.feed(spark, source).where("abs(height) < 25")), out, state)
    got = spark.read.schema(live.Nowcast.OUT).parquet(out)
    return got.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("innovation") ** 2)), 4).alias("rmse"), F.round(F.avg("innovation"), 4).alias("bias"))


QUERIES = {f.__name__: f for f in (ref_stream_first, ref_stream_hourly, ref_stream_rerun, ref_health, ref_nowcast)}
_FEED = "f AS (SELECT station, t, height FROM obs WHERE station IS NOT NULL AND t IS NOT NULL AND height IS NOT NULL AND NOT isnan(height))"
SQL = {
    "ref_stream_first": f"WITH {_FEED} SELECT station, count(DISTINCT t) AS n, count(DISTINCT t) AS instants FROM f GROUP BY 1",
    "ref_stream_hourly": f"""WITH {_FEED} SELECT station, epoch_us(t) // 3600000000 * 3600 AS unix_s, count(*) AS n, round(avg(height), 6) + 0.0 AS mean, min(height) + 0.0 AS low, max(height) + 0.0 AS high FROM f
GROUP BY 1, 2 HAVING (epoch_us(any_value(t)) // 3600000000 + 1) * 3600000 <= (SELECT epoch_ms(max(t)) FROM f) - 7200000""",
    "ref_stream_rerun": f"WITH {_FEED} SELECT station, count(*) AS n FROM f GROUP BY 1",
    "ref_health": f"""WITH {SCORED_SQL}, k AS (SELECT station, height - mean AS e, sigma, row_number() OVER (PARTITION BY station ORDER BY us * 1000 + obs_id % 1000 DESC) AS back FROM p),
g AS (SELECT station, count(*) AS n, avg(CAST(abs(e) <= 1.96 * sigma AS DOUBLE)) AS c, sqrt(avg(e * e)) AS r, avg(e) AS b FROM k WHERE back <= {live.Health.WINDOW} GROUP BY 1)
SELECT station, n, round(c, 6) AS coverage, round(r, 6) AS rmse, round(b, 6) AS bias, c < {live.Health.LEAST_COVERAGE} OR abs(b) > {live.Health.MOST_BIAS} AS needs_refit FROM g""",
}
