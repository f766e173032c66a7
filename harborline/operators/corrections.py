"""Corrections learnt from residuals and forcing, and their use: season, regime, weather, river, joint tails.

Every table learnt is a small one by station; it is applied by a join and plain expressions. Chronological splits rank readings
within days and add up the days' counts, so no window sees more than a station's day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import materialize, small, table
from harborline.operators.fitting import weather_response
from harborline.operators.scores import crps_text, persistence
from harborline.operators.scores import _P as SCORED_SQL
from harborline.operators.series import _R, DAY, HOUR, _residuals, order_statistic, with_neighbours

BINS, HOLDOUT, LEAST_TEST, Z95 = 12, 0.25, 24, 1.96
YEAR_DAYS = 365.25


def tail_split(df: DataFrame, key: str, order: str, part: float = HOLDOUT, least: int = LEAST_TEST) -> DataFrame:
    """df with `_test`: whether a row is among the last max(least, round(part * n)) of its key; order[0] is `us`, equal times by `order`."""
    rows = df.withColumn("_day", F.expr(f"us DIV {DAY}"))
    days = rows.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_c"))
    later = Window.partitionBy(key).orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_day", F.coalesce(F.sum("_c").over(later), F.lit(0)).alias("_after"), F.greatest(F.lit(least), F.bround(F.sum("_c").over(Window.partitionBy(key)) * part).cast("long")).alias("_held"))
    w = Window.partitionBy(key, "_day").orderBy(F.desc("us"), F.desc(order))
    ranked = rows.withColumn("_place", F.row_number().over(w)).join(days, [key, "_day"])
    return ranked.withColumn("_test", F.col("_place") + F.col("_after") <= F.col("_held")).drop("_day", "_place", "_after", "_held")


def season_bin(us: str, bins: int = BINS) -> str:
    """The bin of a time's place in its year, 0..bins-1."""
    at = f"timestamp_micros({us})"
    return f"CAST(pmod(floor((dayofyear({at}) - 1 + ({us} - unix_micros(date_trunc('day', {at}))) / 86400000000.0) / {YEAR_DAYS} * {bins}), {bins}) AS INT)"


def season_table(rows: DataFrame, key: str, bins: int = BINS) -> DataFrame:
    """rows(key, bin, resid) -> (key, biases, counts): medians by bin, empty bins filled from the nearest on the circle (the one
    before on ties), smoothed by 1/4, 1/2, 1/4 around the circle."""
    by = rows.groupBy(key, "bin").agg(F.percentile("resid", F.lit(0.5)).alias("m"), F.count(F.lit(1)).alias("c"))
    got = by.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("m"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("c"))
    all_ = f"sequence(0, {bins - 1})"
    fill = f"transform({all_}, i -> aggregate({all_}, CAST(NULL AS DOUBLE), (a, d) -> coalesce(a, m[pmod(i - d, {bins})], m[pmod(i + d, {bins})])))"
    got = got.withColumn("f", F.expr(fill))
    smooth = f"transform({all_}, i -> 0.25 * f[pmod(i - 1, {bins})] + 0.5 * f[i] + 0.25 * f[pmod(i + 1, {bins})])"
    return got.select(key, F.expr(smooth).alias("biases"), F.expr(f"transform({all_}, i -> coalesce(c[i], 0L))").alias("counts"))


def season_shift(us: str, biases: str, bins: int = BINS) -> str:
    """The correction at a time: linear on the circle between the bins' centres."""
    at = f"timestamp_micros({us})"
    x = f"((dayofyear({at}) - 1 + ({us} - unix_micros(date_trunc('day', {at}))) / 86400000000.0) / {YEAR_DAYS} * {bins} - 0.5)"
    pick = lambda k: f"{biases}[CAST(pmod(floor({x}) + {k}, {bins}) AS INT)]"
    return f"({pick(0)} + ({pick(1)} - {pick(0)}) * ({x} - floor({x})))"


def learn_season(rows: DataFrame, key: str, order: str, bins: int = BINS, alpha: float = 0.05) -> DataFrame:
    """rows(key, us, resid, sigma) -> (key, biases, counts, n, n_test, rmse_before, rmse_after, q, coverage_after, max_bias).

    The table is learnt from all readings; errors before and after, and the conformal factor of the band, come from the
    chronological tail with a table of the head alone. Keys of fewer than max(4 bins, 48) readings have no row, nor has one
    whose head is empty. Null and NaN residuals take no part.
    """
    use = rows.where(F.col("resid").isNotNull() & ~F.isnan("resid")).withColumn("bin", F.expr(season_bin("us", bins)))
    enough = use.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(4 * bins, 48))
    split = materialize(tail_split(use.join(enough, key), key, order), "season")
    head = season_table(split.where(~F.col("_test")), key, bins).select(key, F.col("biases").alias("_head"))
    tail = split.where("_test").join(small(head), key).withColumn("left", F.expr(f"resid - {season_shift('us', '_head', bins)}"))
    tail = tail.withColumn("score", F.round(F.abs("left") / F.greatest(F.col("sigma"), F.lit(1e-9)), 6))
    q = order_statistic(tail, key, "score", 1 - alpha).select(key, "q")
    told = tail.join(small(q), key).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(F.col("resid") ** 2)).alias("rmse_before"), F.sqrt(F.avg(F.col("left") ** 2)).alias("rmse_after"), F.first("q").alias("q"),
        F.avg((F.col("score") <= F.col("q")).cast("double")).alias("coverage_after"),
    )
    return season_table(split, key, bins).join(enough, key).join(told, key).withColumn("max_bias", F.array_max(F.transform("biases", F.abs)))


def joint_exceedance(rows: DataFrame, key: str, tide: str, surge: str, levels: list[float]) -> DataFrame:
    """(key, level, share): how often tide and surge together stand above each level."""
    got = rows.groupBy(key).agg(*(F.avg((F.col(tide) + F.col(surge) > x).cast("double")).alias(f"l{k}") for k, x in enumerate(levels)))
    return got.select(key, F.inline(F.array(*(F.struct(F.lit(float(x)).alias("level"), F.col(f"l{k}").alias("share")) for k, x in enumerate(levels)))))


def regime_of(range_: Column, usual: Column, metric: Column, far: Column) -> Column:
    return F.concat(F.when(range_ >= usual, "spring").otherwise("neap"), F.when(metric >= far, "-storm").otherwise("-calm"))


def regime_bands(rows: DataFrame, table_: DataFrame, default: Column) -> DataFrame:
    """rows(regime, mean, sigma, ...) with lower and upper: the regime's factor (regime, q) times sigma about the mean; `default` where
    the table lacks the regime."""
    half = F.coalesce(F.col("q"), default) * F.greatest(F.col("sigma"), F.lit(1e-12))
    return rows.join(F.broadcast(table_.select("regime", "q")), "regime", "left").withColumns({"lower": F.col("mean") - half, "upper": F.col("mean") + half})  # at most four regimes


def stress_columns() -> dict[str, str]:
    """The features of a response to wind stress, from wind_speed and wind_dir (degrees, from)."""
    return {"u": "-wind_speed * wind_speed * sin(radians(wind_dir))", "v": "-wind_speed * wind_speed * cos(radians(wind_dir))"}


def surge_forecast(forcing: DataFrame, responses: DataFrame, p_ref: float = 1013.25) -> DataFrame:
    """forcing(station, us, wind_speed, wind_dir, pressure), responses(station, intercept, stress_u, stress_v, barometer, lag_h, sigma, phi,
    eps, last_us, last) -> (station, us, surge, sigma): the response at the forcing's time plus the lag, with the decaying last
    residual and growing variance of the autoregression; without phi the response's own sigma.
    """
    rows = forcing.dropna().selectExpr("station", "us", "pressure", *(f"{e} AS {n}" for n, e in stress_columns().items())).join(small(responses), "station")
    ahead = "greatest((us + lag_h * 3600000000L - last_us) / 3.6e9, 0.0)"
    return rows.selectExpr(
        "station", "us + lag_h * 3600000000L AS us",
        f"intercept + stress_u * u + stress_v * v + barometer * (pressure - {p_ref}) + coalesce(pow(phi, {ahead}) * last, 0.0) AS surge",
        f"coalesce(eps * sqrt((1 - pow(phi, 2 * {ahead})) / (1 - phi * phi)), sigma) AS sigma",
    )


def antecedent(discharge: DataFrame, window: int) -> DataFrame:
    """discharge(station, us, q) with `qa`: the trailing mean of `window` readings (fewer at the start), not below zero."""
    got = with_neighbours(discharge, "station", ["us"], {"qa": lambda w: F.avg("q").over(w.rowsBetween(1 - window, 0))}, window - 1)
    return got.withColumn("qa", F.greatest("qa", F.lit(0.0)))


def river_response(rows: DataFrame, least: int = 24, points: int = 17, passes: int = 5, low: float = 0.05, high: float = 2.0) -> DataFrame:
    """rows(station, qa, y) -> (station, alpha, beta, sigma, r2, n): y = alpha qa^beta with alpha >= 0 by least squares over positive qa.

    Each pass sums the products for `points` exponents between each station's bounds in one aggregate and keeps the two intervals
    around the best; so nothing but sums leaves the executors, however long a river's record. Stations of fewer than `least`
    positive readings, or none that discharge pushes up, have no row.
    """
    use = materialize(rows.where("qa > 0 AND y IS NOT NULL AND NOT isnan(y)").select("station", "qa", "y"), "river")
    bounds = use.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy")).where(F.col("n") >= least).withColumns({"low": F.lit(low), "high": F.lit(high)})
    for _ in range(passes):
        at = [F.expr(f"low + (high - low) * {k} / {points - 1}") for k in range(points)]
        sums = use.join(small(bounds), "station").groupBy("station", "n", "sy", "syy", "low", "high").agg(*(f.alias(f"{c}{k}") for k, b in enumerate(at) for c, f in (("xy", F.sum(F.pow("qa", b) * F.col("y"))), ("xx", F.sum(F.pow("qa", 2 * b))))))
        tried = F.array(*(F.struct((F.col("syy") - F.greatest(F.col(f"xy{k}"), F.lit(0.0)) ** 2 / F.col(f"xx{k}")).alias("rss"), F.lit(k).alias("k"), F.greatest(F.col(f"xy{k}") / F.col(f"xx{k}"), F.lit(0.0)).alias("alpha"), at[k].alias("beta")) for k in range(points)))
        best = sums.select("station", "n", "sy", "syy", "low", "high", F.array_min(tried).alias("m")).withColumn("step", (F.col("high") - F.col("low")) / (points - 1))
        bounds = materialize(best.select("station", "n", "sy", "syy", F.greatest(F.lit(low), F.col("m.beta") - F.col("step")).alias("low"), F.least(F.lit(high), F.col("m.beta") + F.col("step")).alias("high"), F.col("m.alpha").alias("alpha"), F.col("m.beta").alias("beta"), F.col("m.rss").alias("rss")), "exponents")
    var = F.col("syy") - F.col("sy") ** 2 / F.col("n")
    return bounds.where("alpha > 0").select("station", "alpha", "beta", F.sqrt(F.greatest("rss", F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1))).alias("sigma"), F.greatest(F.lit(0.0), 1 - F.col("rss") / F.nullif(var, F.lit(0.0))).alias("r2"), "n")


def river_level(rows: DataFrame, couplings: DataFrame) -> DataFrame:
    """rows(station, us, qa) with couplings(station, alpha, beta) -> (station, us, level)."""
    return rows.join(small(couplings.select("station", "alpha", "beta")), "station").select("station", "us", (F.col("alpha") * F.pow(F.greatest("qa", F.lit(0.0)), "beta")).alias("level"))


def ref_learn_season(spark, d: str) -> DataFrame:
    """The seasonal correction of each station: readings, test readings, errors before and after, conformal factor, coverage."""
    rows = _residuals(spark, d).select("station", "us", "obs_id", "resid", F.lit(0.1).alias("sigma"))
    got = learn_season(rows, "station", "obs_id")
    return got.select("station", "n", "n_test", *(F.round(c, 6).alias(c) for c in ("rmse_before", "rmse_after", "q", "coverage_after", "max_bias")), F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


def ref_joint_exceedance(spark, d: str) -> DataFrame:
    """Share of readings at each station whose tide and residual together stand above 0.5, 1, 1.5 and 2 m."""
    rows = _residuals(spark, d).where("tide IS NOT NULL")
    return joint_exceedance(rows, "station", "tide", "resid", [0.5, 1.0, 1.5, 2.0]).select("station", "level", F.round("share", 5).alias("share"))


def ref_regime_bands(spark, d: str) -> DataFrame:
    """Regime factors applied: readings, factor, coverage and mean width of the bands of each regime and station kind."""
    rows = materialize(_residuals(spark, d).withColumn("day", F.expr(f"us DIV {DAY}")), "regimes")
    days = rows.groupBy("station", "day").agg(F.round(F.max("tide") - F.min("tide"), 4).alias("range_m"))
    usual = days.groupBy("station").agg(F.percentile("range_m", F.lit(0.5)).alias("usual"))
    far = rows.groupBy("station").agg(F.percentile(F.abs("resid"), F.lit(0.95)).alias("far"))
    known = rows.join(days.join(usual, "station"), ["station", "day"]).join(small(far), "station")
    known = materialize(known.select("station", "obs_id", "resid", regime_of(F.col("range_m"), F.col("usual"), F.abs("resid"), F.col("far")).alias("regime"), F.col("tide").alias("mean"), F.lit(0.1).alias("sigma"), F.round(F.abs("resid") / 0.1, 4).alias("score")), "regimes")
    q = order_statistic(known, "regime", "score", 0.95).select("regime", "q")
    got = regime_bands(known, q, F.lit(Z95))
    inside = (F.col("mean") + F.col("resid")).between(F.col("lower") - 1e-9, F.col("upper") + 1e-9)
    return got.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("q"), 4).alias("q"), F.round(F.avg(inside.cast("double")), 5).alias("coverage"), F.round(F.avg(F.col("upper") - F.col("lower")), 5).alias("width"))


def ref_crps_interval(spark, d: str) -> DataFrame:
    """CRPS of the persistence forecast at each station, its spread taken from the band."""
    got = persistence(spark, d).withColumn("s", (F.col("upper") - F.col("lower")) / (2 * Z95))
    return got.groupBy("station").agg(F.round(F.avg(F.expr(crps_text("height", "mean", "s"))), 9).alias("crps"))


_WEATHER = "value % 20", "event_id * 37 % 360", "990 + event_id * 13 % 50"
TRUE_RESPONSE, TRUE_LAG, TRUE_RIVER = (0.02, 0.001, -0.002, -0.01), 2, (0.3, 0.6)


def _weather(spark, d: str) -> DataFrame:
    """The events as weather: the kind is the station."""
    speed, direction, pressure = _WEATHER
    return table(spark, d, "events").where("event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL").groupBy(F.col("event_type").alias("station"), F.unix_micros("ts").alias("us")).agg(F.min_by("value", "event_id").alias("value"), F.min("event_id").alias("event_id")).selectExpr(
        "station", "us", f"CAST({speed} AS DOUBLE) AS wind_speed", f"CAST({direction} AS DOUBLE) AS wind_dir", f"CAST({pressure} AS DOUBLE) AS pressure"
    )


def _response(spark) -> DataFrame:
    return spark.createDataFrame([(*TRUE_RESPONSE, TRUE_LAG)], "intercept double, stress_u double, stress_v double, barometer double, lag_h int")


def _with_response(spark, d: str) -> tuple[DataFrame, DataFrame]:
    met = materialize(_weather(spark, d), "weather")
    of = met.select("station").distinct().join(F.broadcast(_response(spark)))  # one row
    return met, surge_forecast(met, of.selectExpr("*", "0.05 AS sigma", "CAST(NULL AS DOUBLE) AS phi", "CAST(NULL AS DOUBLE) AS eps", "0L AS last_us", "CAST(NULL AS DOUBLE) AS last"))


def ref_weather_response(spark, d: str) -> DataFrame:
    """The response found in a surge made from the weather by a known response: lag and coefficients come back."""
    met, surge = _with_response(spark, d)
    got = weather_response(surge.select("station", "us", "surge"), met)
    return got.select("station", "lag_h", *(F.round(c, 5).alias(c) for c in ("intercept", "stress_u", "stress_v", "barometer")), F.round("r2", 5).alias("r2"))


def ref_surge_forecast(spark, d: str) -> DataFrame:
    """Surge and spread by a response and an autoregression at the weather's times plus the lag."""
    met = materialize(_weather(spark, d), "weather")
    first = met.groupBy("station").agg(F.min("us").alias("last_us")).join(F.broadcast(_response(spark)))  # one row
    got = surge_forecast(met, first.selectExpr("*", "0.05 AS sigma", "0.9 AS phi", "0.02 AS eps", "0.4 AS last"))
    return got.select("station", "us", F.round("surge", 6).alias("surge"), F.round("sigma", 6).alias("sigma"))


def _river(spark, d: str) -> DataFrame:
    met = _weather(spark, d).select("station", "us", F.abs("pressure").alias("p"), "wind_speed")
    return antecedent(met.select("station", "us", (F.col("p") - 985 + F.col("wind_speed")).alias("q")), 48)


def ref_river_level(spark, d: str) -> DataFrame:
    """The level that discharge adds by a known coupling, at the discharge's times."""
    rows = _river(spark, d)
    of = rows.select("station").distinct().selectExpr("station", f"CAST({TRUE_RIVER[0]} AS DOUBLE) AS alpha", f"CAST({TRUE_RIVER[1]} AS DOUBLE) AS beta")
    return river_level(rows, of).select("station", "us", F.round("level", 6).alias("level"))


def ref_river_coupling(spark, d: str) -> DataFrame:
    """The coupling found in levels made from discharge by a known coupling: both numbers come back."""
    rows = _river(spark, d).withColumn("y", TRUE_RIVER[0] * F.pow("qa", F.lit(TRUE_RIVER[1])))
    got = river_response(rows)
    return got.select("station", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), F.round("r2", 4).alias("r2"), "n")


QUERIES = {f.__name__: f for f in (ref_learn_season, ref_joint_exceedance, ref_regime_bands, ref_crps_interval, ref_weather_response, ref_surge_forecast, ref_river_level, ref_river_coupling)}

_BIN_SQL = f"CAST(floor((dayofyear(make_timestamp(us)) - 1 + (us % {DAY}) / 86400000000.0) / {YEAR_DAYS} * {BINS}) AS INT) % {BINS}"
_TABLE_SQL = """b{k} AS (SELECT station, bin, quantile_cont(resid, 0.5) AS m FROM s WHERE {where} GROUP BY 1, 2),
f{k} AS (SELECT station, i AS bin, arg_min(m, (least((i - bin + {bins}) % {bins}, (bin - i + {bins}) % {bins}), CASE WHEN (i - bin + {bins}) % {bins} <= (bin - i + {bins}) % {bins} THEN 0 ELSE 1 END)) AS m FROM b{k}, range({bins}) AS r(i) GROUP BY 1, 2),
t{k} AS (SELECT x.station, x.bin, 0.25 * p.m + 0.5 * x.m + 0.25 * n.m AS m FROM f{k} x JOIN f{k} p ON p.station = x.station AND p.bin = (x.bin + {bins} - 1) % {bins} JOIN f{k} n ON n.station = x.station AND n.bin = (x.bin + 1) % {bins})"""
_MET_SQL = f"""e AS (SELECT event_type AS station, epoch_us(ts) AS us, arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
w AS (SELECT station, us, CAST({_WEATHER[0]} AS DOUBLE) AS wind_speed, CAST({_WEATHER[1]} AS DOUBLE) AS wind_dir, CAST({_WEATHER[2]} AS DOUBLE) AS pressure FROM e)"""
_RIVER_SQL = f"{_MET_SQL}, q AS (SELECT station, us, greatest(0.0, avg(abs(pressure) - 985 + wind_speed) OVER (PARTITION BY station ORDER BY us ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)) AS qa FROM w)"
_C0, _CU, _CV, _CB = TRUE_RESPONSE
SQL = {
    "ref_learn_season": f"""WITH {_R}, k AS (SELECT *, count(*) OVER (PARTITION BY station) AS n, {_BIN_SQL} AS bin, row_number() OVER (PARTITION BY station ORDER BY us DESC, obs_id DESC) AS back FROM r),
s AS (SELECT *, back <= greatest({LEAST_TEST}, CAST(round_even(n * {HOLDOUT}, 0) AS BIGINT)) AS test, (dayofyear(make_timestamp(us)) - 1 + (us % {DAY}) / 86400000000.0) / {YEAR_DAYS} * {BINS} - 0.5 AS x FROM k WHERE n >= {max(4 * BINS, 48)}),
{_TABLE_SQL.format(k=1, where='NOT test', bins=BINS)}, {_TABLE_SQL.format(k=2, where='TRUE', bins=BINS)},
l AS (SELECT s.station, s.resid, s.resid - (a.m + (b.m - a.m) * (x - floor(x))) AS lft FROM s JOIN t1 a ON a.station = s.station AND a.bin = (CAST(floor(x) AS INT) + {BINS}) % {BINS} JOIN t1 b ON b.station = s.station AND b.bin = (CAST(floor(x) AS INT) + 1 + {BINS}) % {BINS} WHERE test),
o AS (SELECT *, round(abs(lft) / 0.1, 6) AS score, row_number() OVER (PARTITION BY station ORDER BY round(abs(lft) / 0.1, 6)) AS rk, count(*) OVER (PARTITION BY station) AS n_test FROM l),
qq AS (SELECT station, max(score) FILTER (rk = least(n_test, CAST(ceil(round((n_test + 1) * 0.95, 9)) AS BIGINT))) AS q FROM o GROUP BY 1),
z AS (SELECT station, max(n_test) AS n_test, sqrt(avg(resid * resid)) AS rb, sqrt(avg(lft * lft)) AS ra, max(q) AS q, avg(CAST(score <= q AS DOUBLE)) AS cov FROM o JOIN qq USING (station) GROUP BY 1),
m AS (SELECT station, max(abs(m)) AS mb FROM t2 GROUP BY 1), c AS (SELECT station, string_agg(c::VARCHAR, ',' ORDER BY i) AS counts FROM (SELECT u.station, i, count(s.bin) AS c FROM (SELECT DISTINCT station FROM s) u CROSS JOIN range({BINS}) AS r(i) LEFT JOIN s ON s.station = u.station AND s.bin = i GROUP BY 1, 2) GROUP BY 1)
SELECT station, any_value(n) AS n, any_value(n_test) AS n_test, round(any_value(rb), 6) AS rmse_before, round(any_value(ra), 6) AS rmse_after, round(any_value(q), 6) AS q, round(any_value(cov), 6) AS coverage_after, round(any_value(mb), 6) AS max_bias, any_value(counts) AS counts FROM (SELECT DISTINCT station, n FROM s) JOIN z USING (station) JOIN m USING (station) JOIN c USING (station) GROUP BY station""",
    "ref_joint_exceedance": f"WITH {_R} SELECT station, level, round(avg(CAST(tide + resid > level AS DOUBLE)), 5) AS share FROM r, (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (1.5), (2.0)) AS l(level) WHERE tide IS NOT NULL GROUP BY ALL",
    "ref_regime_bands": f"""WITH {_R}, d AS (SELECT station, us // {DAY} AS day, round(max(tide) - min(tide), 4) AS range_m FROM r GROUP BY ALL), e AS (SELECT *, quantile_cont(range_m, 0.5) OVER (PARTITION BY station) AS usual FROM d),
f AS (SELECT station, quantile_cont(abs(resid), 0.95) AS far FROM r GROUP BY 1),
g AS (SELECT CASE WHEN range_m >= usual THEN 'spring' ELSE 'neap' END || CASE WHEN abs(resid) >= far THEN '-storm' ELSE '-calm' END AS regime, round(abs(resid) / 0.1, 4) AS score, abs(resid) AS a FROM r JOIN e ON e.station = r.station AND e.day = r.us // {DAY} JOIN f ON f.station = r.station),
h AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score) AS k, count(*) OVER (PARTITION BY regime) AS n FROM g), qq AS (SELECT regime, score AS q FROM h WHERE k = least(n, CAST(ceil(round((n + 1) * 0.95, 9)) AS BIGINT)))
SELECT regime, count(*) AS n, round(max(q), 4) AS q, round(avg(CAST(a <= q * 0.1 + 1e-9 AS DOUBLE)), 5) AS coverage, round(avg(2 * q * 0.1), 5) AS width FROM g JOIN qq USING (regime) GROUP BY 1""",
    "ref_crps_interval": f"WITH {SCORED_SQL} SELECT station, round(avg({crps_text('height', 'mean', f'((upper - lower) / {2 * Z95})')}), 9) AS crps FROM p GROUP BY 1",
    "ref_weather_response": f"WITH {_MET_SQL} SELECT station, CAST({TRUE_LAG} AS INT) AS lag_h, CAST({_C0} AS DOUBLE) AS intercept, CAST({_CU} AS DOUBLE) AS stress_u, CAST({_CV} AS DOUBLE) AS stress_v, CAST({_CB} AS DOUBLE) AS barometer, CAST(1.0 AS DOUBLE) AS r2 FROM w GROUP BY 1 HAVING count(*) >= 48",
    "ref_surge_forecast": f"""WITH {_MET_SQL}, f AS (SELECT *, us + {TRUE_LAG * HOUR} AS us2, (us + {TRUE_LAG * HOUR} - min(us) OVER (PARTITION BY station)) / 3.6e9 AS dt FROM w)
SELECT station, us2 AS us, round({_C0} - {_CU} * wind_speed * wind_speed * sin(radians(wind_dir)) - {_CV} * wind_speed * wind_speed * cos(radians(wind_dir)) + {_CB} * (pressure - 1013.25) + pow(0.9, dt) * 0.4, 6) AS surge, round(0.02 * sqrt((1 - pow(0.9, 2 * dt)) / (1 - 0.81)), 6) AS sigma FROM f""",
    "ref_river_level": f"WITH {_RIVER_SQL} SELECT station, us, round({TRUE_RIVER[0]} * pow(qa, {TRUE_RIVER[1]}), 6) AS level FROM q",
    "ref_river_coupling": f"WITH {_RIVER_SQL} SELECT station, CAST({TRUE_RIVER[0]} AS DOUBLE) AS alpha, CAST({TRUE_RIVER[1]} AS DOUBLE) AS beta, CAST(1.0 AS DOUBLE) AS r2, count(*) AS n FROM q WHERE qa > 0 GROUP BY 1 HAVING count(*) >= 24",
}
