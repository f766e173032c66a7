"""Scores of forecasts: errors, coverage, CRPS, calibration, conformal bands, exceedance; and of logged decisions.

The forecast scored by the queries is persistence: each reading is forecast by the one before it in its upload, with the
station's usual change as its spread. Scores are plain aggregates, so they combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.common import small, table
from harborline.functions import normal
from harborline.operators.series import OBS_SQL, _obs, order_statistic, with_neighbours

Z95 = 1.96
LEVELS = (0.5, 0.8, 0.9, 0.95, 0.99)


def rmse(p: Column, o: Column) -> Column:
    return F.sqrt(F.avg((p - o) * (p - o)))


def crps_text(o: str, mean: str, sigma: str) -> str:
    """Closed form for a normal forecast; the spread is at least 1e-9."""
    s = f"greatest({sigma}, 1e-9)"
    z = f"(({o} - {mean}) / {s})"
    return f"({s} * ({z} * (2 * {normal.cdf(z)} - 1) + 2 * {normal.pdf(z)} - 1 / sqrt(pi())))"


def persistence(spark, d: str) -> DataFrame:
    """Readings (not impossible) with forecast mean, spread and 95 % band; the first of an upload has none."""
    columns = {"mean": lambda w: F.lag("height").over(w), "peak": lambda w: (F.col("height") > F.lag("height").over(w)) & (F.col("height") > F.lead("height").over(w)), "trough": lambda w: (F.col("height") < F.lag("height").over(w)) & (F.col("height") < F.lead("height").over(w))}
    got = with_neighbours(_obs(spark, d).where(F.abs("height") < 25), "upload_id", ["us", "obs_id"], columns, 1).where("mean IS NOT NULL")
    usual = got.groupBy("station").agg(F.round(F.sqrt(F.avg((F.col("height") - F.col("mean")) ** 2)), 4).alias("sigma"))
    got = got.join(small(usual), "station")
    return got.withColumns({"lower": F.col("mean") - Z95 * F.col("sigma"), "upper": F.col("mean") + Z95 * F.col("sigma")})


def ref_evaluate(spark, d: str) -> DataFrame:
    """n, RMSE, MAE, bias, coverage, error at turning points and CRPS of the persistence forecast at each station."""
    p, o = F.col("mean"), F.col("height")
    got = persistence(spark, d).withColumn("crps", F.expr(crps_text("height", "mean", "sigma")))
    return got.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.round(rmse(p, o), 10).alias("rmse"), F.round(F.avg(F.abs(p - o)), 10).alias("mae"), F.round(F.avg(p - o), 10).alias("bias"),
        F.round(F.avg(o.between(F.col("lower"), F.col("upper")).cast("double")), 10).alias("coverage"),
        F.round(F.avg(F.when(F.col("peak") | F.col("trough"), F.abs(p - o))), 10).alias("peak_error"), F.round(F.avg("crps"), 10).alias("crps"),
    )


def ref_reliability(spark, d: str) -> DataFrame:
    """Share of readings inside the forecast's central intervals."""
    z = F.abs(F.col("height") - F.col("mean")) / F.greatest(F.col("sigma"), F.lit(1e-12))
    levels = [F.avg((z <= normal.quantile(0.5 + x / 2)).cast("double")).alias(str(x)) for x in LEVELS]
    got = persistence(spark, d).agg(*levels)
    return got.select(F.inline(F.array(*(F.struct(F.lit(x).alias("level"), F.round(F.col(f"`{x}`"), 5).alias("covered")) for x in LEVELS)))).where("covered IS NOT NULL")


def ref_pit(spark, d: str) -> DataFrame:
    """Histogram of the probability integral transform in ten bins, the last closed."""
    z = "((height - mean) / greatest(sigma, 1e-9))"
    got = persistence(spark, d).select(F.least(F.floor(F.expr(normal.cdf(z)) * 10), F.lit(9)).cast("int").alias("bin"))
    return got.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def ref_conformal(spark, d: str) -> DataFrame:
    """The conformal 95 % quantile of absolute errors at each station: an order statistic."""
    got = persistence(spark, d).select("station", F.round(F.abs(F.col("height") - F.col("mean")), 4).alias("score"))
    return order_statistic(got, "station", "score", 0.95).withColumnRenamed("q", "half_width")


def ref_exceedance(spark, d: str) -> DataFrame:
    """Share of each station's readings above each of several levels."""
    levels = (0.5, 1.0, 1.5, 2.0)
    got = _obs(spark, d).where(F.abs("height") < 25).groupBy("station").agg(*(F.avg((F.col("height") > x).cast("double")).alias(f"l{k}") for k, x in enumerate(levels)))
    return got.select("station", F.inline(F.array(*(F.struct(F.lit(x).alias("level_m"), F.round(f"l{k}", 5).alias("share")) for k, x in enumerate(levels)))))


def ref_histogram(spark, d: str) -> DataFrame:
    """Readings of each kind of sensor by quarter metre of height; heights beyond 25 m share the outer bins."""
    obs = table(spark, d, "obs").where(F.col("height").isNotNull() & ~F.isnan("height"))
    bin_ = F.floor(F.greatest(F.lit(-25.0), F.least(F.lit(25.0), F.col("height"))) * 4).cast("long")
    return obs.groupBy(F.coalesce("source", F.lit("unknown")).alias("sensor"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ref_outcomes(spark, d: str) -> DataFrame:
    """Resolved decisions of each station: number, events, hits, false alarms, misses, recall and precision."""
    done = table(spark, d, "ledger").where(F.col("realized_level").isNotNull() & F.col("act").isNotNull())
    event, act = F.col("realized_level") > F.col("threshold_m"), F.col("act")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    got = done.groupBy("station").agg(F.count(F.lit(1)).alias("n"), count(event, "events"), count(event & act, "hits"), count(act & ~event, "false_alarms"), count(event & ~act, "misses"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 5))
    return got.withColumns({"recall": ratio(F.col("hits"), F.col("events")), "precision": ratio(F.col("hits"), F.col("hits") + F.col("false_alarms"))})


def ref_brier(spark, d: str) -> DataFrame:
    """Brier score of the decisions' probabilities and their mean by tenth, on resolved decisions."""
    done = table(spark, d, "ledger").where("realized_level IS NOT NULL AND probability IS NOT NULL")
    event = (F.col("realized_level") > F.col("threshold_m")).cast("double")
    tenth = F.least(F.floor(F.col("probability") * 10), F.lit(9)).cast("int")
    return done.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("probability") - event) ** 2), 6).alias("brier"), F.round(F.avg(event), 6).alias("observed"))


def ref_report_counts(spark, d: str) -> DataFrame:
    """Reports by sensor and reason: reports, rejected, share of readings flagged. A report with several reasons counts for each."""
    got = table(spark, d, "qc_reports").select("sensor", "rejected", "n_flagged", "n_total", F.explode_outer("reasons").alias("reason"))
    return got.groupBy(F.coalesce("sensor", F.lit("unknown")).alias("sensor"), F.coalesce("reason", F.lit("none")).alias("reason")).agg(
        F.count(F.lit(1)).alias("reports"), F.count(F.when(F.col("rejected"), 1)).alias("rejected"), F.round(F.sum("n_flagged") / F.sum("n_total"), 6).alias("flagged_share")
    )


def ref_trust(spark, d: str) -> DataFrame:
    """Trust of each sensor kind at each station: acceptance, halved for each tolerance of datum shift and drift, squared."""
    part = lambda c, tol: F.pow(F.lit(2.0), -F.pow(F.coalesce(c, F.lit(0.0)) / tol, 2))
    usable = lambda c: F.when(F.abs(c) < 1e3, F.abs(c))
    got = table(spark, d, "qc_reports").groupBy("station").agg(
        F.count(F.lit(1)).alias("reports"), F.avg(F.col("rejected").cast("double")).alias("rejects"), F.avg(usable(F.col("datum_shift_m"))).alias("datum"), F.avg(usable(F.col("drift_slope_m_per_day"))).alias("drift")
    )
    trust = (1 - F.col("rejects")) * part(F.col("datum"), 0.30) * part(F.col("drift"), 0.10)
    return got.select("station", "reports", F.round(F.greatest(F.lit(1e-3), trust), 5).alias("trust"))


QUERIES = {f.__name__: f for f in (ref_evaluate, ref_reliability, ref_pit, ref_conformal, ref_exceedance, ref_histogram, ref_outcomes, ref_brier, ref_report_counts, ref_trust)}

_P = f"""f AS (SELECT *, height > mean AND height > nx AS peak, height < mean AND height < nx AS trough FROM (SELECT *, lag(height) OVER w AS mean, lead(height) OVER w AS nx FROM {OBS_SQL} WHERE upload_id IS NOT NULL AND abs(height) < 25
  WINDOW w AS (PARTITION BY upload_id ORDER BY us, obs_id)) WHERE mean IS NOT NULL),
u AS (SELECT station, round(sqrt(avg((height - mean) * (height - mean))), 4) AS sigma FROM f GROUP BY 1),
p AS (SELECT *, mean - {Z95} * sigma AS lower, mean + {Z95} * sigma AS upper FROM f JOIN u USING (station))"""
SQL = {
    "ref_evaluate": f"""WITH {_P} SELECT station, count(*) AS n, round(sqrt(avg((mean - height) * (mean - height))), 10) AS rmse, round(avg(abs(mean - height)), 10) AS mae, round(avg(mean - height), 10) AS bias,
round(avg(CAST(height BETWEEN lower AND upper AS DOUBLE)), 10) AS coverage, round(avg(abs(mean - height)) FILTER (peak OR trough), 10) AS peak_error, round(avg({crps_text('height', 'mean', 'sigma')}), 10) AS crps FROM p GROUP BY 1""",
    "ref_reliability": f"WITH {_P}, l(level, z) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE), CAST({normal.quantile(0.5 + x / 2)!r} AS DOUBLE))' for x in LEVELS)}) SELECT level, round(avg(CAST(abs(height - mean) / greatest(sigma, 1e-12) <= z AS DOUBLE)), 5) AS covered FROM p, l GROUP BY 1",
    "ref_pit": f"WITH {_P} SELECT CAST(least(floor({normal.cdf('((height - mean) / greatest(sigma, 1e-9))')} * 10), 9) AS INT) AS bin, count(*) AS n FROM p GROUP BY 1",
    "ref_conformal": f"""WITH {_P}, s AS (SELECT station, round(abs(height - mean), 4) AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY score) AS k, count(*) OVER (PARTITION BY station) AS n FROM s)
SELECT station, n, score AS half_width FROM r WHERE k = least(n, CAST(ceil(round((n + 1) * 0.95, 9)) AS BIGINT))""",
    "ref_exceedance": f"SELECT station, level_m, round(avg(CAST(height > level_m AS DOUBLE)), 5) AS share FROM {OBS_SQL}, (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (1.5), (2.0)) AS l(level_m) WHERE upload_id IS NOT NULL AND abs(height) < 25 GROUP BY ALL",
    "ref_histogram": "SELECT coalesce(source, 'unknown') AS sensor, CAST(floor(greatest(-25.0, least(25.0, height)) * 4) AS BIGINT) AS bin, count(*) AS n FROM obs WHERE height IS NOT NULL AND NOT isnan(height) GROUP BY 1, 2",
    "ref_outcomes": """WITH r AS (SELECT station, count(*) AS n, count(*) FILTER (realized_level > threshold_m) AS events, count(*) FILTER (realized_level > threshold_m AND act) AS hits,
  count(*) FILTER (act AND NOT realized_level > threshold_m) AS false_alarms, count(*) FILTER (realized_level > threshold_m AND NOT act) AS misses FROM ledger WHERE realized_level IS NOT NULL AND act IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN events > 0 THEN round(hits / events, 5) END AS recall, CASE WHEN hits + false_alarms > 0 THEN round(hits / (hits + false_alarms), 5) END AS precision FROM r""",
    "ref_brier": "SELECT CAST(least(floor(probability * 10), 9) AS INT) AS tenth, count(*) AS n, round(avg(pow(probability - CAST(realized_level > threshold_m AS DOUBLE), 2)), 6) AS brier, round(avg(CAST(realized_level > threshold_m AS DOUBLE)), 6) AS observed FROM ledger WHERE realized_level IS NOT NULL AND probability IS NOT NULL GROUP BY 1",
    "ref_report_counts": """WITH x AS (SELECT *, unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE [NULL] END) AS reason FROM qc_reports)
SELECT coalesce(sensor, 'unknown') AS sensor, coalesce(reason, 'none') AS reason, count(*) AS reports, count(*) FILTER (rejected) AS rejected, round(sum(n_flagged) / sum(n_total), 6) AS flagged_share FROM x GROUP BY 1, 2""",
    "ref_trust": """WITH g AS (SELECT station, count(*) AS reports, avg(CAST(rejected AS DOUBLE)) AS rejects, avg(abs(datum_shift_m)) FILTER (abs(datum_shift_m) < 1e3) AS datum, avg(abs(drift_slope_m_per_day)) FILTER (abs(drift_slope_m_per_day) < 1e3) AS drift FROM qc_reports GROUP BY 1)
SELECT station, reports, round(greatest(1e-3, (1 - rejects) * pow(2.0, -pow(coalesce(datum, 0) / 0.30, 2)) * pow(2.0, -pow(coalesce(drift, 0) / 0.10, 2))), 5) AS trust FROM g""",
}
