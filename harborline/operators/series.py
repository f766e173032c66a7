"""Windowed operators on time series: neighbours, extrema, runs, clusters, interpolation, rolling statistics, splits.

Series are cut by ordered_blocks(), so a hot series is many tasks; runs that cross a cut are merged over the runs, not the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import explode_steps, materialize, micros, small, table
from harborline.operators.blocks import BLOCK_ROWS, ordered_blocks
from harborline.operators.tides import OBS_SQL, predict, predict_sql, published_models

HOUR, DAY = 3_600_000_000, 86_400_000_000


def blocks(df: DataFrame, key: str, order: list[str], halo: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """The series in blocks with halos, and the window over a block; order[0] is in microseconds."""
    cut = ordered_blocks(df, key, order, F.floor(F.col(order[0]) / (7 * DAY)), halo, block_rows)
    return cut, Window.partitionBy(key, "_blk").orderBy(*order)


def with_neighbours(df: DataFrame, key: str, order: list[str], columns: dict[str, Callable[[Window], Column]], halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add columns computed over the window of each series; `halo` bounds how far they look."""
    cut, w = blocks(df, key, order, halo, block_rows)
    return cut.withColumns({n: f(w) for n, f in columns.items()}).where("_core").drop("_core", "_blk")


def runs(df: DataFrame, key: str, order: list[str], starts: Callable[[Window], Column], aggregates: dict[str, tuple[Column, Callable[[str], Column]]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per run of each series: key, the first column of `order` as start and end, and the aggregates.

    `starts` says of a row, by its window, whether a run begins there (true for the first row). aggregates: name -> (of
    rows, how to merge parts by name).
    """
    cut, w = blocks(df, key, order, 1, block_rows)
    t = order[0]
    rows = cut.withColumn("_start", F.coalesce(starts(w), F.lit(True))).where("_core")
    rows = rows.withColumn("_run", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = rows.groupBy(key, "_blk", "_run").agg(F.max("_start").alias("_start"), F.min(t).alias("start_us"), F.max(t).alias("end_us"), *(a.alias(n) for n, (a, _) in aggregates.items()))
    over_runs = Window.partitionBy(key).orderBy("_blk", "_run").rowsBetween(Window.unboundedPreceding, 0)
    merged = first.withColumn("_all", F.sum(F.col("_start").cast("int")).over(over_runs))
    return merged.groupBy(key, "_all").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), *(f(n).alias(n) for n, (_, f) in aggregates.items())).drop("_all")


def interpolate(df: DataFrame, key: str, time: str, value: str, step_us: int = HOUR) -> DataFrame:
    """(key, at_us, level): linear between readings at whole steps from the first reading to the last; no extrapolation.

    Of several readings at one instant the last in order of value counts for what follows, the first for what precedes.
    """
    pairs = with_neighbours(df, key, [time, value], {"_t": lambda w: F.lead(time).over(w), "_v": lambda w: F.lead(value).over(w)}, 1)
    first = F.ceil(F.col(time) / step_us) * step_us
    # Each whole step belongs to the pair that starts at or before it; the last reading only to itself.
    end = F.coalesce(F.when(F.col("_t") > F.col(time), F.ceil(F.col("_t") / step_us) * step_us - step_us), F.when(F.col("_t").isNull(), F.col(time)))
    steps = explode_steps(pairs.withColumn("_end", end), first, F.col("_end"), F.lit(step_us), "at_us")
    part = (F.col("at_us") - F.col(time)) / (F.col("_t") - F.col(time))
    return steps.select(key, "at_us", F.coalesce(F.col(value) + (F.col("_v") - F.col(value)) * part, F.col(value)).alias("level"))


def order_statistic(df: DataFrame, key: str, value: str, part: float) -> DataFrame:
    """(key, n, q): the k-th smallest value, k = min(n, ceil((n + 1) * part)); counted over distinct values, not rows."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    k = F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * part, 9)))
    return ranked.where(F.col("upto") >= k).groupBy(key).agg(F.max("n").alias("n"), F.min(value).alias("q"))


def _obs(spark, d: str) -> DataFrame:
    obs = table(spark, d, "obs").where(F.col("height").isNotNull() & ~F.isnan("height") & F.col("t").isNotNull() & F.col("upload_id").isNotNull())
    return obs.select("obs_id", "upload_id", "station", micros(F.col("t")).alias("us"), "height")


def _predicted(spark, d: str) -> DataFrame:
    return predict(_obs(spark, d), published_models(table(spark, d, "gauges")))


def _is_peak(c: str, w: Window) -> Column:
    return (F.col(c) > F.lag(c).over(w)) & (F.col(c) > F.lead(c).over(w))


def _is_trough(c: str, w: Window) -> Column:
    return (F.col(c) < F.lag(c).over(w)) & (F.col(c) < F.lead(c).over(w))


def ref_extrema(spark, d: str) -> DataFrame:
    """Strict local highs and lows of each upload; plateaus and ends are none."""
    kind = lambda w: F.when(_is_peak("height", w), "high").when(_is_trough("height", w), "low")
    return with_neighbours(_obs(spark, d), "upload_id", ["us", "obs_id"], {"kind": kind}, 1).where("kind IS NOT NULL").select("obs_id", "kind")


def ref_skew_surge(spark, d: str) -> DataFrame:
    """Observed less predicted at the strict maxima of the predicted tide."""
    peaks = with_neighbours(_predicted(spark, d), "upload_id", ["us", "obs_id"], {"peak": lambda w: _is_peak("tide", w)}, 1).where("peak")
    return peaks.select("obs_id", F.round(F.col("height") - F.col("tide"), 3).alias("skew_m"))


def ref_exposure_windows(spark, d: str) -> DataFrame:
    """Stretches of each upload whose heights stay below 0.5 m."""
    low = F.col("height") < 0.5
    got = runs(
        _obs(spark, d).withColumn("low", low), "upload_id", ["us", "obs_id"], lambda w: F.col("low") != F.lag("low").over(w),
        {"n": (F.count(F.lit(1)), F.sum), "low": (F.max("low"), F.max), "lowest": (F.min("height"), F.min)},
    )
    return got.where("low").select("upload_id", "start_us", "end_us", "n", "lowest")


def _residuals(spark, d: str) -> DataFrame:
    """Readings with residual against the tide and the station's usual residual (sample deviation)."""
    # Written once: the spread, the blocks' counts and the rows themselves all read it.
    got = materialize(_predicted(spark, d).withColumn("resid", F.round(F.col("height") - F.col("tide"), 4)).where(F.abs("height") < 25), "residuals")
    spread = got.groupBy("station").agg(F.stddev_samp("resid").alias("sigma"), F.avg("resid").alias("offset"), F.count(F.lit(1)).alias("n_station"))
    return got.join(small(spread), "station")


def ref_decompose(spark, d: str) -> DataFrame:
    """Residual level of each station: readings, mean, deviation, and readings beyond three deviations."""
    got = _residuals(spark, d)
    return got.groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("resid"), 4).alias("offset"), F.round(F.first("sigma"), 4).alias("sigma"), F.sum((F.abs("resid") > 3 * F.col("sigma")).cast("int")).alias("flagged")
    )


def ref_surge_events(spark, d: str) -> DataFrame:
    """Stretches in which an upload's residual stays beyond 0.6 m of the station's mean residual, with the peak."""
    far = _residuals(spark, d).withColumn("far", F.abs(F.col("resid") - F.round("offset", 2)) > 0.6)
    got = runs(
        far, "upload_id", ["us", "obs_id"], lambda w: F.col("far") != F.lag("far").over(w),
        {"n": (F.count(F.lit(1)), F.sum), "far": (F.max("far"), F.max), "peak_m": (F.max(F.abs("resid")), F.max)},
    )
    return got.where("far").select("upload_id", "start_us", "end_us", "n", "peak_m")


GAP_HOURS = 72


def ref_decluster(spark, d: str) -> DataFrame:
    """Storm peaks by station: readings above the 90 % quantile, clusters split at gaps of 72 hours, the first maximum kept."""
    obs = _obs(spark, d).where(F.abs("height") < 25)
    # Heights come in millimetres, so the exact quantile counts a bounded number of distinct values.
    limit = small(obs.groupBy("station").agg(F.percentile("height", F.lit(0.9)).alias("limit_m")))
    over = obs.join(limit, "station").where(F.col("height") > F.col("limit_m"))
    got = runs(
        over, "station", ["us", "obs_id"], lambda w: F.col("us") - F.lag("us").over(w) >= GAP_HOURS * HOUR,
        {"n": (F.count(F.lit(1)), F.sum), "top": (F.max(F.struct("height", (-F.col("us")).alias("neg"), (-F.col("obs_id")).alias("id"))), F.max)},
    )
    return got.select("station", "start_us", "end_us", "n", F.col("top.height").alias("peak_m"), (-F.col("top.id")).alias("obs_id"))


def ref_rolling(spark, d: str) -> DataFrame:
    """Trailing mean of five, centred median of five and rate an hour at every reading of an upload."""
    columns = {
        "mean5": lambda w: F.avg("height").over(w.rowsBetween(-4, 0)),
        "median5": lambda w: F.percentile("height", F.lit(0.5)).over(w.rowsBetween(-2, 2)),
        "rate": lambda w: (F.lead("height").over(w) - F.lag("height").over(w)) / ((F.lead("us").over(w) - F.lag("us").over(w)) / HOUR),
    }
    got = with_neighbours(_obs(spark, d).where(F.abs("height") < 25), "upload_id", ["us", "obs_id"], columns, 4)
    return got.select("obs_id", F.round("mean5", 5).alias("mean5"), F.round("median5", 5).alias("median5"), F.round("rate", 3).alias("rate"))


def ref_hourly(spark, d: str) -> DataFrame:
    """Each upload interpolated onto whole hours."""
    return interpolate(_distinct(spark, d), "upload_id", "us", "height").select("upload_id", F.expr("at_us DIV 1000000").alias("unix_s"), F.round("level", 4).alias("level"))


def _distinct(spark, d: str) -> DataFrame:
    """One reading per upload and instant: the lowest obs_id."""
    return _obs(spark, d).where(F.abs("height") < 25).groupBy("upload_id", "us").agg(F.min_by("height", "obs_id").alias("height"))


def ref_common_grid(spark, d: str) -> DataFrame:
    """The network's hourly grid: mean level and number of series of each station and hour."""
    owner = _obs(spark, d).groupBy("upload_id").agg(F.min("station").alias("station"))
    grid = interpolate(_distinct(spark, d), "upload_id", "us", "height").join(owner, "upload_id")
    return grid.groupBy("station", F.expr("at_us DIV 1000000").alias("unix_s")).agg(F.round(F.avg("level"), 4).alias("level"), F.count(F.lit(1)).alias("series"))


def ref_first_wins(spark, d: str) -> DataFrame:
    """One reading per station and instant, the first received."""
    obs = table(spark, d, "obs").where("t IS NOT NULL")
    order = F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp")), F.col("obs_id"))
    return obs.groupBy("station", F.unix_micros("t").alias("us")).agg(F.min_by("obs_id", order).alias("obs_id"), F.count(F.lit(1)).alias("n"))


def ref_last_readings(spark, d: str) -> DataFrame:
    """The last 168 readings of each station; the rank is cut before the shuffle."""
    w = Window.partitionBy("station").orderBy(F.desc("us"), F.desc("obs_id"))
    return _obs(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 168").select("station", "obs_id", "place")


def ref_split(spark, d: str) -> DataFrame:
    """Chronological split of each upload: the last quarter, at least 24 readings, is held out.

    Readings are ranked within their day and the days' counts are added up, so no window sees more than an upload's day.
    """
    obs = _obs(spark, d).withColumn("day", F.expr(f"us DIV {DAY}"))
    days = obs.groupBy("upload_id", "day").agg(F.count(F.lit(1)).alias("c"))
    later = Window.partitionBy("upload_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("c").over(Window.partitionBy("upload_id"))
    days = days.select("upload_id", "day", F.coalesce(F.sum("c").over(later), F.lit(0)).alias("after"), F.greatest(F.lit(24), F.bround(n * 0.25).cast("long")).alias("held"))
    w = Window.partitionBy("upload_id", "day").orderBy(F.desc("us"), F.desc("obs_id"))
    ranked = obs.withColumn("place", F.row_number().over(w)).join(days, ["upload_id", "day"])
    return ranked.select("obs_id", F.when(F.col("place") + F.col("after") <= F.col("held"), "test").otherwise("train").alias("part"))


def ref_ar1(spark, d: str) -> DataFrame:
    """First-order autoregression of each station's residuals along its uploads: coefficient, pairs."""
    near = with_neighbours(_residuals(spark, d), "upload_id", ["us", "obs_id"], {"before": lambda w: F.lag("resid").over(w)}, 1)
    return near.where("before IS NOT NULL").groupBy("station").agg(F.round(F.sum(F.col("resid") * F.col("before")) / F.sum(F.col("before") * F.col("before")), 4).alias("phi"), F.count(F.lit(1)).alias("pairs"))


def ref_daily_range(spark, d: str) -> DataFrame:
    """Range of each station's day of readings, and whether it is above the station's median day (spring) or not (neap)."""
    days = _obs(spark, d).where(F.abs("height") < 25).groupBy("station", F.expr("us DIV 86400000000").alias("day")).agg((F.max("height") - F.min("height")).alias("range_m"))
    days = days.withColumn("range_m", F.round("range_m", 3))
    usual = days.groupBy("station").agg(F.percentile("range_m", F.lit(0.5)).alias("usual"))
    return days.join(small(usual), "station").select("station", "day", "range_m", F.when(F.col("range_m") >= F.col("usual"), "spring").otherwise("neap").alias("phase"))


def ref_upload_overlap(spark, d: str) -> DataFrame:
    """Interval join: reports whose upload was still being read when another upload of its station began."""
    span = _obs(spark, d).groupBy("upload_id").agg(F.min("station").alias("station"), F.min("us").alias("a"), F.max("us").alias("b"))
    # Days are the equi-join key, so no station's uploads meet all in one task.
    cells = span.withColumn("day", F.explode(F.sequence(F.expr(f"a DIV {DAY}"), F.expr(f"b DIV {DAY}"))))
    left, right = cells.alias("l"), cells.select("station", "upload_id", "a", "day").alias("r")
    met = left.join(right, (F.col("l.station") == F.col("r.station")) & (F.col("l.day") == F.col("r.day")) & (F.col("r.a") > F.col("l.a")) & (F.col("r.a") <= F.col("l.b")))
    return met.where(F.expr(f"r.day = r.a DIV {DAY}")).select(F.col("l.upload_id").alias("upload_id"), F.col("r.upload_id").alias("other"))


QUERIES = {
    f.__name__: f
    for f in (ref_extrema, ref_skew_surge, ref_exposure_windows, ref_decompose, ref_surge_events, ref_decluster, ref_rolling, ref_hourly, ref_common_grid, ref_first_wins, ref_last_readings, ref_split, ref_ar1, ref_daily_range, ref_upload_overlap)
}

_O = f"SELECT * FROM {OBS_SQL} WHERE upload_id IS NOT NULL"
_P = f"SELECT obs_id, upload_id, station, us, height, tide FROM {predict_sql(f'({_O})')}"
_R = f"""p AS ({_P}), q AS (SELECT *, round(height - tide, 4) AS resid FROM p WHERE abs(height) < 25),
r AS (SELECT *, stddev_samp(resid) OVER (PARTITION BY station) AS sigma, avg(resid) OVER (PARTITION BY station) AS "offset" FROM q)"""
_D = f"e AS (SELECT upload_id, us, arg_min(height, obs_id) AS height FROM ({_O}) WHERE abs(height) < 25 GROUP BY ALL)"
_H = f"""{_D}, n AS (SELECT *, lead(us) OVER w AS t2, lead(height) OVER w AS v2 FROM e WINDOW w AS (PARTITION BY upload_id ORDER BY us)),
k AS (SELECT *, unnest(range(CAST(ceil(us / {HOUR}) AS BIGINT), CASE WHEN t2 IS NULL THEN us // {HOUR} + 1 ELSE CAST(ceil(t2 / {HOUR}) AS BIGINT) END)) AS hour FROM n),
g AS (SELECT upload_id, hour * 3600 AS unix_s, coalesce(height + (v2 - height) * (hour * {HOUR} - us) / (t2 - us), height) AS level FROM k)"""
_ISLANDS = "SELECT *, sum(s) OVER (PARTITION BY {k} ORDER BY us, obs_id) AS g FROM (SELECT *, CASE WHEN {new} THEN 0 ELSE 1 END AS s FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY us, obs_id))"
SQL = {
    "ref_extrema": f"SELECT * FROM (SELECT obs_id, CASE WHEN height > lag(height) OVER w AND height > lead(height) OVER w THEN 'high' WHEN height < lag(height) OVER w AND height < lead(height) OVER w THEN 'low' END AS kind FROM ({_O}) WINDOW w AS (PARTITION BY upload_id ORDER BY us, obs_id)) WHERE kind IS NOT NULL",
    "ref_skew_surge": f"SELECT obs_id, round(height - tide, 3) AS skew_m FROM (SELECT *, tide > lag(tide) OVER w AND tide > lead(tide) OVER w AS peak FROM ({_P}) WINDOW w AS (PARTITION BY upload_id ORDER BY us, obs_id)) WHERE peak",
    "ref_exposure_windows": f"""WITH o AS (SELECT *, height < 0.5 AS low FROM ({_O})), i AS ({_ISLANDS.format(k='upload_id', new='low = lag(low) OVER w', t='o')})
SELECT upload_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, min(height) AS lowest FROM i WHERE low GROUP BY upload_id, g""",
    "ref_decompose": f"""WITH {_R} SELECT station, count(*) AS n, round(avg(resid), 4) AS "offset", round(max(sigma), 4) AS sigma, CAST(count(*) FILTER (abs(resid) > 3 * sigma) AS BIGINT) AS flagged FROM r GROUP BY station""",
    "ref_surge_events": f"""WITH {_R}, f AS (SELECT *, abs(resid - round("offset", 2)) > 0.6 AS far FROM r), i AS ({_ISLANDS.format(k='upload_id', new='far = lag(far) OVER w', t='f')})
SELECT upload_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(abs(resid)) AS peak_m FROM i WHERE far GROUP BY upload_id, g""",
    "ref_decluster": f"""WITH o AS (SELECT *, quantile_cont(height, 0.9) OVER (PARTITION BY station) AS l FROM ({_O}) WHERE abs(height) < 25), f AS (SELECT * FROM o WHERE height > l),
i AS ({_ISLANDS.format(k='station', new=f'us - lag(us) OVER w < {GAP_HOURS * HOUR}', t='f')})
SELECT station, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(height) AS peak_m, first(obs_id ORDER BY height DESC, us, obs_id) AS obs_id FROM i GROUP BY station, g""",
    "ref_rolling": f"""SELECT obs_id, round(avg(height) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS mean5, round(quantile_cont(height, 0.5) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS median5,
round((lead(height) OVER w - lag(height) OVER w) / ((lead(us) OVER w - lag(us) OVER w) / {HOUR}), 3) AS rate FROM ({_O}) WHERE abs(height) < 25 WINDOW w AS (PARTITION BY upload_id ORDER BY us, obs_id)""",
    "ref_hourly": f"WITH {_H} SELECT upload_id, unix_s, round(level, 4) AS level FROM g",
    "ref_common_grid": f"WITH {_H}, w AS (SELECT upload_id, min(station) AS station FROM ({_O}) GROUP BY 1) SELECT station, unix_s, round(avg(level), 4) AS level, count(*) AS series FROM g JOIN w USING (upload_id) GROUP BY 1, 2",
    "ref_first_wins": "SELECT station, epoch_us(t) AS us, first(obs_id ORDER BY received_at NULLS LAST, obs_id) AS obs_id, count(*) AS n FROM obs WHERE t IS NOT NULL GROUP BY station, t",
    "ref_last_readings": f"SELECT station, obs_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY us DESC, obs_id DESC) AS place FROM ({_O})) WHERE place <= 168",
    "ref_split": f"SELECT obs_id, CASE WHEN row_number() OVER (PARTITION BY upload_id ORDER BY us DESC, obs_id DESC) <= greatest(24, CAST(round_even(n * 0.25, 0) AS BIGINT)) THEN 'test' ELSE 'train' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY upload_id) AS n FROM ({_O}))",
    "ref_ar1": f"WITH {_R}, b AS (SELECT *, lag(resid) OVER (PARTITION BY upload_id ORDER BY us, obs_id) AS bf FROM r) SELECT station, round(sum(resid * bf) / sum(bf * bf), 4) AS phi, count(*) AS pairs FROM b WHERE bf IS NOT NULL GROUP BY station",
    "ref_daily_range": f"""WITH d AS (SELECT station, us // {DAY} AS day, round(max(height) - min(height), 3) AS range_m FROM ({_O}) WHERE abs(height) < 25 GROUP BY ALL)
SELECT station, day, range_m, CASE WHEN range_m >= quantile_cont(range_m, 0.5) OVER (PARTITION BY station) THEN 'spring' ELSE 'neap' END AS phase FROM d""",
    "ref_upload_overlap": f"WITH s AS (SELECT upload_id, min(station) AS station, min(us) AS a, max(us) AS b FROM ({_O}) GROUP BY 1) SELECT l.upload_id, r.upload_id AS other FROM s l JOIN s r ON l.station = r.station AND r.a > l.a AND r.a <= l.b",
}
