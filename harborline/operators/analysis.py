"""Analyses on top of predictions and fits: exceedance, regimes, windows of low water, comparisons, attribution, forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import small, table
from harborline.functions import normal
from harborline.operators import series
from harborline.operators.fitting import CANDIDATES, choose, product_sums, solve_sums
from harborline.operators.network import both_parts, constants
from harborline.operators.scores import _P as SCORED_SQL
from harborline.operators.scores import persistence
from harborline.operators.series import _ISLANDS, _R, HOUR, _obs, _residuals, order_statistic, runs
from harborline.operators.tides import _HOURS, hours, predict, predict_sql, published_models


def exceedance_text(mean: str, sigma: str, level: str) -> str:
    """Probability that a normal level lies above `level`; the variance is at least 1e-12."""
    return f"(1.0 - {normal.cdf(f'(({level} - {mean}) / greatest({sigma}, 1e-6))')})"


def tail_survival(x: str, loc: str, scale: str, shape: str) -> str:
    """Probability that a peak over `loc` exceeds x under a generalised Pareto tail; 1 up to loc, 0 beyond a bounded tail."""
    y = f"(({x} - {loc}) / {scale})"
    return f"(CASE WHEN {x} <= {loc} THEN 1.0 WHEN abs({shape}) < 1e-8 THEN exp(-{y}) WHEN 1 + {shape} * {y} <= 0 THEN 0.0 ELSE pow(1 + {shape} * {y}, -1 / {shape}) END)"


def seasonal_correction(us: str, biases: str, bins: int = 12) -> str:
    """Circular linear interpolation, at the time's place in its year, between the bins' biases (an array column, bins centred)."""
    place = f"((dayofyear(timestamp_micros({us})) - 1 + ({us} - unix_micros(date_trunc('day', timestamp_micros({us})))) / 86400000000.0) / 365.25 * {bins} - 0.5)"
    at = lambda k: f"element_at({biases}, CAST(pmod(floor({place}) + {k}, {bins}) AS INT) + 1)"
    return f"({at(0)} + ({at(1)} - {at(0)}) * ({place} - floor({place})))"


def ar1_forecast(last: Column, phi: Column, sigma_eps: Column, steps: int) -> Column:
    """Array of (step, mean, variance) of an autoregression from its last value; a random walk where |phi| is 1 or more."""
    h = F.sequence(F.lit(1), F.lit(steps))
    fade = lambda k: F.when(F.abs(phi) < 1, F.pow(phi, k)).otherwise(F.lit(1.0))
    var = lambda k: F.when(F.abs(phi) < 1, sigma_eps**2 * (1 - F.pow(phi, 2 * k)) / (1 - phi**2)).otherwise(sigma_eps**2 * k)
    return F.transform(h, lambda k: F.struct(k.alias("step"), (fade(k) * last).alias("mean"), var(k).alias("variance")))


def attribution(obs: DataFrame, names: list[str] = CANDIDATES, min_obs: int = 48) -> DataFrame:
    """obs(station, us, height) -> (station, name, variance, share): how much the uncertainty of each constituent adds to that of the
    curve, averaged over the readings.

    The mean over the readings of the 2 x 2 blocks' quadratic forms is taken from the sums of products of the fit itself.
    """
    schema = "station string, name string, variance double, share double"

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for r in b.itertuples():
                g = np.asarray(r.sums, float).reshape(2 * len(names) + 2, -1)
                chosen = choose(g, int(r.n), names, (r.last_us - r.first_us) / 3.6e9, 0.05)
                if not (got := solve_sums(g, int(r.n), names, chosen)):
                    continue
                c = np.asarray(got["covariance"])
                parts = []
                for k, n in enumerate(chosen):
                    i, j = 1 + 2 * k, 1 + 2 * names.index(n)
                    parts.append(max(float((g[j : j + 2, j : j + 2] * c[i : i + 2, i : i + 2]).sum()) / r.n, 0.0))
                total = sum(parts) or 1.0
                out += [(r.station, n, v, v / total) for n, v in zip(chosen, parts, strict=True)]
            yield pd.DataFrame(out, columns=["station", "name", "variance", "share"])

    return product_sums(obs, names).where(F.col("n") >= min_obs).mapInPandas(run, schema)


def _day(spark, d: str) -> DataFrame:
    models = published_models(table(spark, d, "gauges"))
    return predict(hours(models, "2025-01-01", 1), models)


def ref_flood(spark, d: str) -> DataFrame:
    """Probability of a level above 1.5 m at each hour of a day, with a spread of 0.2 m."""
    return _day(spark, d).selectExpr("station", "us DIV 1000000 AS unix_s", f"round({exceedance_text('tide', '0.2', '1.5')}, 5) AS probability")


def ref_tide_rate(spark, d: str) -> DataFrame:
    """Rate of change of a day's hourly curve, its range, and the screening score of both."""
    w = Window.partitionBy("station").orderBy("us")
    step = F.coalesce(F.lead("us").over(w), F.col("us")) - F.coalesce(F.lag("us").over(w), F.col("us"))
    rise = F.coalesce(F.lead("tide").over(w), F.col("tide")) - F.coalesce(F.lag("tide").over(w), F.col("tide"))
    whole = Window.partitionBy("station")
    got = _day(spark, d).withColumns({"rate": F.abs(rise / (step / HOUR)), "span": F.max("tide").over(whole) - F.min("tide").over(whole)})
    part = F.least(F.lit(1.0), F.col("rate") / 0.5)
    return got.select("station", F.expr("us DIV 1000000").alias("unix_s"), F.round("rate", 4).alias("rate"), F.round(0.7 * part + 0.3 * F.least(F.lit(1.0), F.col("span") / 2.0) * part, 4).alias("score"))


def ref_regimes(spark, d: str) -> DataFrame:
    """Conformal 95 % half width of residuals by regime: days of large or small range, readings calm or storm."""
    rows = _residuals(spark, d).withColumn("day", F.expr("us DIV 86400000000"))
    days = rows.groupBy("station", "day").agg(F.round(F.max("tide") - F.min("tide"), 4).alias("range_m"))
    usual = days.groupBy("station").agg(F.percentile("range_m", F.lit(0.5)).alias("usual"))
    far = rows.groupBy("station").agg(F.percentile(F.abs("resid"), F.lit(0.95)).alias("far"))
    got = rows.join(days.join(usual, "station"), ["station", "day"]).join(small(far), "station")
    regime = F.concat(F.when(F.col("range_m") >= F.col("usual"), "spring").otherwise("neap"), F.when(F.abs("resid") >= F.col("far"), "-storm").otherwise("-calm"))
    return order_statistic(got.select(regime.alias("regime"), F.abs("resid").alias("score")), "regime", "score", 0.95).withColumnRenamed("q", "half_width")


GUARD_H, LOW_M = 24, 0.3


def ref_safe_windows(spark, d: str) -> DataFrame:
    """Stretches of low water without a surge (residual beyond three deviations) in them or in the day before."""
    rows = _residuals(spark, d).withColumns({"low": F.col("height") < LOW_M, "surge": F.abs("resid") > 3 * F.col("sigma")})
    wins = runs(rows, "upload_id", ["us", "obs_id"], lambda w: F.col("low") != F.lag("low").over(w), {"n": (F.count(F.lit(1)), F.sum), "low": (F.max("low"), F.max)}).where("low")
    # Windows and surges meet on upload and day: the guard reaches over at most the days it is split into.
    day = lambda c: F.expr(f"({c}) DIV 86400000000")
    cells = wins.withColumn("day", F.explode(F.sequence(day(f"start_us - {GUARD_H * HOUR}"), day("end_us"))))
    surges = rows.where("surge").select(F.col("upload_id").alias("u"), day("us").alias("d"), F.col("us").alias("at"))
    hit = cells.join(surges, (F.col("upload_id") == F.col("u")) & (F.col("day") == F.col("d")) & (F.col("at") >= F.col("start_us") - GUARD_H * HOUR) & (F.col("at") <= F.col("end_us")), "left_semi").select("upload_id", "start_us").distinct()
    return wins.join(hit, ["upload_id", "start_us"], "left_anti").select("upload_id", "start_us", "end_us", "n")


def ref_compare(spark, d: str) -> DataFrame:
    """RMSE of the published tide (less its mean error) and of persistence at each station, and which is lower; ties: tide."""
    tide = _residuals(spark, d).groupBy("station").agg(F.stddev_pop("resid").alias("tide_rmse"))
    last = persistence(spark, d).groupBy("station").agg(F.sqrt(F.avg((F.col("mean") - F.col("height")) ** 2)).alias("last_rmse"))
    got = tide.join(last, "station")
    return got.select("station", F.round("tide_rmse", 6).alias("tide_rmse"), F.round("last_rmse", 6).alias("last_rmse"), F.when(F.col("last_rmse") < F.col("tide_rmse"), "persistence").otherwise("tide").alias("winner"))


def ref_constituent_sets(spark, d: str) -> DataFrame:
    """Constituents of the register and of the grid: in both, or only in one."""
    a = table(spark, d, "gauges").select(F.explode("constituents.name").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("stations"))
    b = table(spark, d, "grid").where("constituent IS NOT NULL").groupBy(F.col("constituent").alias("name")).agg(F.countDistinct("point_id").alias("points"))
    got = a.join(b, "name", "full")
    return got.select("name", F.coalesce("stations", F.lit(0)).alias("stations"), F.coalesce("points", F.lit(0)).alias("points"), F.when(F.col("stations").isNull(), "grid").when(F.col("points").isNull(), "register").otherwise("both").alias("where"))


def ref_leave_one_out(spark, d: str) -> DataFrame:
    """How each source of stations moves the network's mean constants: the inverse-variance mean with and without it."""
    c = constants(table(spark, d, "gauges")).join(small(table(spark, d, "gauges").select("station", "source").dropDuplicates(["station"])), "station")
    part = c.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), "name").agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("var")).alias("w"), F.sum(F.col("a") / F.col("var")).alias("wa"))
    w = Window.partitionBy("name")  # sources are few
    got = part.withColumns({"tw": F.sum("w").over(w), "twa": F.sum("wa").over(w)})
    return got.select("source", "name", "k", F.round(F.col("twa") / F.col("tw"), 6).alias("with_it"), F.when(F.col("tw") > F.col("w"), F.round((F.col("twa") - F.col("wa")) / (F.col("tw") - F.col("w")), 6)).alias("without_it"))


def ref_leave_one_out_parts(spark, d: str) -> DataFrame:
    """As ref_leave_one_out, for the cosine (a) and the sine (b) part."""
    g = table(spark, d, "gauges")
    c = both_parts(constants(g)).join(small(g.select("station", "source").dropDuplicates(["station"])), "station")
    part = c.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), "name", "part").agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("var")).alias("w"), F.sum(F.col("z") / F.col("var")).alias("wz"))
    w = Window.partitionBy("name", "part")  # sources are few
    got = part.withColumns({"tw": F.sum("w").over(w), "twz": F.sum("wz").over(w)})
    return got.select("source", "name", "part", "k", F.round(F.col("twz") / F.col("tw"), 6).alias("with_it"), F.when(F.col("tw") > F.col("w"), F.round((F.col("twz") - F.col("wz")) / (F.col("tw") - F.col("w")), 6)).alias("without_it"))


def ref_ledger_once(spark, d: str) -> DataFrame:
    """Each decision once: of entries with the same station, time text, threshold and probability the last holds, with what any resolved."""
    rows = table(spark, d, "ledger")
    return rows.groupBy("station", "time", "threshold_m", "probability").agg(F.max("entry_id").alias("entry_id"), F.count(F.lit(1)).alias("logged"), F.max_by("realized_level", F.when(F.col("realized_level").isNotNull(), F.col("entry_id"))).alias("realized_level")).select("entry_id", "logged", "realized_level")


def ref_ar1_forecast(spark, d: str) -> DataFrame:
    """Six steps ahead of each upload's last residual by its station's autoregression."""
    rows = series.with_neighbours(_residuals(spark, d), "upload_id", ["us", "obs_id"], {"before": lambda w: F.lag("resid").over(w)}, 1)
    fit = rows.where("before IS NOT NULL").groupBy("station").agg(F.round(F.sum(F.col("resid") * F.col("before")) / F.sum(F.col("before") * F.col("before")), 6).alias("phi"), F.round(F.stddev_samp(F.col("resid") - F.col("before")), 6).alias("eps"))
    last = rows.groupBy("upload_id").agg(F.max_by("station", F.struct("us", "obs_id")).alias("station"), F.max_by("resid", F.struct("us", "obs_id")).alias("last"))
    got = last.join(small(fit), "station").select("upload_id", F.inline(ar1_forecast(F.col("last"), F.col("phi"), F.col("eps"), 6)))
    return got.select("upload_id", "step", F.round("mean", 4).alias("mean"), F.round("variance", 5).alias("variance"))


def ref_attribution(spark, d: str) -> DataFrame:
    """Share of each fitted constituent in the uncertainty of each station's curve."""
    return attribution(_obs(spark, d).where(F.abs("height") < 25)).select("station", "name", F.round("share", 4).alias("share"))


QUERIES = {f.__name__: f for f in (ref_flood, ref_tide_rate, ref_regimes, ref_safe_windows, ref_compare, ref_constituent_sets, ref_leave_one_out, ref_leave_one_out_parts, ref_ledger_once, ref_ar1_forecast, ref_attribution)}

_DAY = predict_sql(_HOURS.format(first="2025-01-01", n=24))
_LAG = f"{_R}, b AS (SELECT *, lag(resid) OVER (PARTITION BY upload_id ORDER BY us, obs_id) AS bf FROM r)"
SQL = {
    "ref_flood": f"SELECT station, us // 1000000 AS unix_s, round({exceedance_text('tide', '0.2', '1.5')}, 5) AS probability FROM {_DAY}",
    "ref_tide_rate": f"""WITH p AS (SELECT station, us, tide FROM {_DAY}), q AS (SELECT *, abs((coalesce(lead(tide) OVER w, tide) - coalesce(lag(tide) OVER w, tide)) / ((coalesce(lead(us) OVER w, us) - coalesce(lag(us) OVER w, us)) / {HOUR})) AS r,
max(tide) OVER (PARTITION BY station) - min(tide) OVER (PARTITION BY station) AS span FROM p WINDOW w AS (PARTITION BY station ORDER BY us))
SELECT station, us // 1000000 AS unix_s, round(r, 4) AS rate, round(0.7 * least(1.0, r / 0.5) + 0.3 * least(1.0, span / 2.0) * least(1.0, r / 0.5), 4) AS score FROM q""",
    "ref_regimes": f"""WITH {_R}, d AS (SELECT station, us // 86400000000 AS day, round(max(tide) - min(tide), 4) AS range_m FROM r GROUP BY ALL), e AS (SELECT *, quantile_cont(range_m, 0.5) OVER (PARTITION BY station) AS usual FROM d),
f AS (SELECT station, quantile_cont(abs(resid), 0.95) AS far FROM r GROUP BY 1),
g AS (SELECT CASE WHEN range_m >= usual THEN 'spring' ELSE 'neap' END || CASE WHEN abs(resid) >= far THEN '-storm' ELSE '-calm' END AS regime, abs(resid) AS score FROM r JOIN e ON e.station = r.station AND e.day = r.us // 86400000000 JOIN f ON f.station = r.station),
h AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score) AS k, count(*) OVER (PARTITION BY regime) AS n FROM g)
SELECT regime, n, score AS half_width FROM h WHERE k = least(n, CAST(ceil(round((n + 1) * 0.95, 9)) AS BIGINT))""",
    "ref_safe_windows": f"""WITH {_R}, f AS (SELECT *, height < {LOW_M} AS low, abs(resid) > 3 * sigma AS surge FROM r), i AS ({_ISLANDS.format(k='upload_id', new='low = lag(low) OVER w', t='f')}),
w AS (SELECT upload_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM i WHERE low GROUP BY upload_id, g)
SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.surge AND f.upload_id = w.upload_id AND f.us BETWEEN w.start_us - {GUARD_H * HOUR} AND w.end_us)""",
    "ref_compare": f"""WITH {_R}, t AS (SELECT station, stddev_pop(resid) AS a FROM r GROUP BY 1), l AS (WITH {SCORED_SQL} SELECT station, sqrt(avg((mean - height) * (mean - height))) AS b FROM p GROUP BY 1)
SELECT station, round(a, 6) AS tide_rmse, round(b, 6) AS last_rmse, CASE WHEN b < a THEN 'persistence' ELSE 'tide' END AS winner FROM t JOIN l USING (station)""",
    "ref_constituent_sets": """WITH a AS (SELECT name, count(*) AS stations FROM (SELECT unnest(constituents, recursive := true) FROM gauges) GROUP BY 1), b AS (SELECT constituent AS name, count(DISTINCT point_id) AS points FROM grid WHERE constituent IS NOT NULL GROUP BY 1)
SELECT name, coalesce(stations, 0) AS stations, coalesce(points, 0) AS points, CASE WHEN stations IS NULL THEN 'grid' WHEN points IS NULL THEN 'register' ELSE 'both' END AS "where" FROM a FULL JOIN b USING (name)""",
    "ref_leave_one_out": """WITH c AS (SELECT coalesce(source, 'unknown') AS source, c.name AS name, c.amplitude * cos(radians(c.phase)) AS a, greatest(coalesce(n, 1), 1) AS w FROM (SELECT *, unnest(constituents) AS c FROM gauges)),
p AS (SELECT source, name, count(*) AS k, sum(w) AS w, sum(a * w) AS wa FROM c GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY name) AS tw, sum(wa) OVER (PARTITION BY name) AS twa FROM p)
SELECT source, name, k, round(twa / tw, 6) AS with_it, CASE WHEN tw > w THEN round((twa - wa) / (tw - w), 6) END AS without_it FROM t""",
    "ref_leave_one_out_parts": """WITH c AS (SELECT coalesce(source, 'unknown') AS source, c.name AS name, part, c.amplitude * CASE part WHEN 'a' THEN cos(radians(c.phase)) ELSE sin(radians(c.phase)) END AS z, greatest(coalesce(n, 1), 1) AS w FROM (SELECT *, unnest(constituents) AS c FROM gauges), (VALUES ('a'), ('b')) AS y(part)),
p AS (SELECT source, name, part, count(*) AS k, sum(w) AS w, sum(z * w) AS wz FROM c GROUP BY 1, 2, 3), t AS (SELECT *, sum(w) OVER (PARTITION BY name, part) AS tw, sum(wz) OVER (PARTITION BY name, part) AS twz FROM p)
SELECT source, name, part, k, round(twz / tw, 6) AS with_it, CASE WHEN tw > w THEN round((twz - wz) / (tw - w), 6) END AS without_it FROM t""",
    "ref_ledger_once": "SELECT max(entry_id) AS entry_id, count(*) AS logged, arg_max(realized_level, entry_id) FILTER (realized_level IS NOT NULL) AS realized_level FROM ledger GROUP BY station, time, threshold_m, probability",
    "ref_ar1_forecast": f"""WITH {_LAG}, m AS (SELECT station, round(sum(resid * bf) / sum(bf * bf), 6) AS phi, round(stddev_samp(resid - bf), 6) AS eps FROM b WHERE bf IS NOT NULL GROUP BY 1),
l AS (SELECT upload_id, arg_max(station, (us, obs_id)) AS station, arg_max(resid, (us, obs_id)) AS last FROM r GROUP BY 1)
SELECT upload_id, CAST(k AS INT) AS step, round(CASE WHEN abs(phi) < 1 THEN pow(phi, k) ELSE 1.0 END * last, 4) AS mean, round(CASE WHEN abs(phi) < 1 THEN eps * eps * (1 - pow(phi, 2 * k)) / (1 - phi * phi) ELSE eps * eps * k END, 5) AS variance FROM l JOIN m USING (station), range(1, 7) AS s(k)""",
}
