"""Harmonic prediction: basis columns, predictions at any time, ranges, summaries by region.

Models come from published constants (gauges.constituents) or from fits. A prediction joins the readings with the small
table of models and adds up f A cos(V + u - g) over the constituents, all native.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import micros, small, table
from harborline.functions import astro
from harborline.plans.steps import sql_steps, with_steps

NAMES = [c.name for c in astro.CATALOG]


def published_models(gauges: DataFrame) -> DataFrame:
    """gauges -> (station, region_name, z0, amp_<name>, lag_<name>): one row a station; missing constituents are null.

    Of a constituent named twice the first holds. A missing mean is 0. Repeated stations keep one row.
    """
    one = lambda n, f: f"get(filter(constituents, x -> x.name = '{n}'), 0).{f}"
    cols = [c for n in NAMES for c in (f"{one(n, 'amplitude')} AS amp_{n}", f"{one(n, 'phase')} AS lag_{n}")]
    return gauges.where("station IS NOT NULL").dropDuplicates(["station"]).selectExpr("station", "region_name", "coalesce(mean, 0.0) AS z0", *cols)


_PUBLISHED_SQL = "SELECT station, region_name, coalesce(mean, 0.0) AS z0, " + ", ".join(
    f"list_filter(constituents, lambda x: x.name = '{n}')[1].{f} AS {k}_{n}" for n in NAMES for f, k in (("amplitude", "amp"), ("phase", "lag"))
) + " FROM gauges WHERE station IS NOT NULL"


def present(models: DataFrame) -> list[str]:
    """The constituents that any of the models has, in the catalogue's order: one small aggregate over the models."""
    has = models.agg(*(F.max(F.col(f"amp_{n}").isNotNull()).alias(n) for n in NAMES)).first()
    return [n for n in NAMES if has[n]]


def height_step(names: list[str]) -> dict[str, str]:
    """The predicted height from z0, the models' parts x_*, y_* and the basis columns."""
    return {"tide": " + ".join(["z0", *(f"(x_{n} * c_{n} + y_{n} * s_{n})" for n in names)])}


def parts(names: list[str]) -> dict[str, str]:
    """Cosine and sine parts of the constants; 0 where a model lacks the constituent."""
    return {k: v for n in names for k, v in ((f"x_{n}", f"coalesce(amp_{n} * cos(radians(lag_{n})), 0.0)"), (f"y_{n}", f"coalesce(amp_{n} * sin(radians(lag_{n})), 0.0)"))}


def predict(times: DataFrame, models: DataFrame) -> DataFrame:
    """times(station, us, ...) joined with models: the times' columns and `tide`. Stations without a model have no row.

    Only constituents that some model has are computed: a method of generated code must stay small enough to be compiled.
    """
    names = present(models)
    slim = models.selectExpr("station", "z0", *(f"{e} AS {n}" for n, e in parts(names).items()))
    joined = with_steps(times, astro.basis_steps([astro.BY_NAME[n] for n in names])).join(small(slim), "station")
    return with_steps(joined, [height_step(names)]).select(*times.columns, "tide")


def hours(models: DataFrame, first: str, days: int) -> DataFrame:
    """(station, us) for every whole hour of `days` days from `first` (UTC date) at each model's station."""
    start = f"unix_micros(CAST('{first} 00:00:00' AS TIMESTAMP))"
    return models.selectExpr("station", f"explode(sequence(CAST(0 AS BIGINT), CAST({24 * days - 1} AS BIGINT))) AS hour").selectExpr("station", f"{start} + hour * 3600000000 AS us")


def station_ranges(models: DataFrame, first: str = "2024-01-01", days: int = 30) -> DataFrame:
    """(region_name, station, range_m, dominant, constituents): the predicted range and the largest constituent."""
    named = [f"struct(coalesce(amp_{n}, -1.0) AS a, -{k} AS k, '{n}' AS name)" for k, n in enumerate(NAMES)]
    count = " + ".join(f"CAST(amp_{n} IS NOT NULL AS INT)" for n in NAMES)
    about = models.selectExpr("station", "region_name", f"greatest({', '.join(named)}).name AS dominant", f"{count} AS constituents")
    curve = predict(hours(models, first, days), models).groupBy("station").agg((F.max("tide") - F.min("tide")).alias("range_m"))
    return curve.join(small(about), "station").select("region_name", "station", "range_m", "dominant", "constituents")


def _obs(spark, d: str) -> DataFrame:
    obs = table(spark, d, "obs").where(F.col("height").isNotNull() & ~F.isnan("height") & F.col("t").isNotNull())
    return obs.select("obs_id", "upload_id", "station", micros(F.col("t")).alias("us"), "height")


def ref_constituents(spark, d: str) -> DataFrame:
    """The catalogue with its speeds in degrees an hour."""
    rows = [(k, c.name, c.species, float(round(astro.speed(c), 7)), c.phase0) for k, c in enumerate(astro.CATALOG)]
    return spark.createDataFrame(rows, "ord int, name string, species string, speed double, phase0 double")


def ref_astro(spark, d: str) -> DataFrame:
    """The astronomical state at each report's time."""
    times = table(spark, d, "qc_reports").where("reported_at IS NOT NULL").select("upload_id", micros(F.col("reported_at")).alias("us"))
    return with_steps(times, astro.state_steps()).selectExpr("upload_id", *(f"round({c}, 4) AS {c}" for c in _STATE))


_STATE = ["jd", "s", "h", "p", "n", "pp", "omega", "tau", "incl", "xi", "nu", "nup", "nupp"]


def _nodes() -> list[str]:
    return [f"struct('{c.name}' AS name, {astro.factor(c)} AS f, {astro.wrapped_correction(c)} AS u)" for c in astro.CATALOG]


def ref_node_factors(spark, d: str) -> DataFrame:
    """Node factor and correction of every constituent at each report's time."""
    times = table(spark, d, "qc_reports").where("reported_at IS NOT NULL").select("upload_id", micros(F.col("reported_at")).alias("us"))
    return with_steps(times, [*astro.state_steps(), *astro.node_steps()]).selectExpr("upload_id", f"inline(array({', '.join(_nodes())}))").selectExpr("upload_id", "name", "round(f, 4) AS f", "round(u, 3) AS u")


def ref_basis(spark, d: str) -> DataFrame:
    """The basis columns f cos(V + u), f sin(V + u) at each report's time, long form."""
    times = table(spark, d, "qc_reports").where("reported_at IS NOT NULL").select("upload_id", micros(F.col("reported_at")).alias("us"))
    each = [f"struct('{n}' AS name, c_{n} AS c, s_{n} AS s)" for n in NAMES]
    return with_steps(times, astro.basis_steps(astro.CATALOG)).selectExpr("upload_id", f"inline(array({', '.join(each)}))").selectExpr("upload_id", "name", "round(c, 4) AS c", "round(s, 4) AS s")


def ref_predict(spark, d: str) -> DataFrame:
    """The predicted tide at every reading with a height."""
    return predict(_obs(spark, d), published_models(table(spark, d, "gauges"))).selectExpr("obs_id", "round(tide, 4) AS tide")


def ref_forecast_day(spark, d: str) -> DataFrame:
    """The hourly curve of one day at every station."""
    models = published_models(table(spark, d, "gauges"))
    return predict(hours(models, "2025-01-01", 1), models).selectExpr("station", "CAST(us DIV 1000000 AS BIGINT) AS unix_s", "round(tide, 4) AS tide")


def ref_station_ranges(spark, d: str) -> DataFrame:
    """Predicted 30-day range and dominant constituent of each station."""
    return station_ranges(published_models(table(spark, d, "gauges"))).withColumn("range_m", F.round("range_m", 3))


def ref_regions(spark, d: str) -> DataFrame:
    """Stations with constants by region, null being 'unknown', with the total as 'all'."""
    g = table(spark, d, "gauges").where("size(constituents) > 0")
    got = g.rollup("region_name").agg(F.grouping("region_name").alias("all"), F.count(F.lit(1)).alias("stations"), F.countDistinct("tz").alias("zones"))
    return got.select(F.when(F.col("all") == 1, "all").otherwise(F.coalesce("region_name", F.lit("unknown"))).alias("region"), "stations", "zones")


def ref_station_constants(spark, d: str) -> DataFrame:
    """Harmonic constants as rows with their cosine and sine parts."""
    g = table(spark, d, "gauges").select("station", F.explode("constituents").alias("c")).select("station", "c.*")
    return g.selectExpr("station", "name", "amplitude", "phase", "round(amplitude * cos(radians(phase)), 6) AS a", "round(amplitude * sin(radians(phase)), 6) AS b")


QUERIES = {f.__name__: f for f in (ref_constituents, ref_astro, ref_node_factors, ref_basis, ref_predict, ref_forecast_day, ref_station_ranges, ref_regions, ref_station_constants)}

_REPORTS = "(SELECT upload_id, epoch_us(reported_at) AS us FROM qc_reports WHERE reported_at IS NOT NULL)"
_RATES = "VALUES (0, {}), (1, {}), (2, {}), (3, {}), (4, {}), (5, {})".format(*astro.rates())
OBS_SQL = "(SELECT obs_id, upload_id, station, epoch_us(t) AS us, height FROM obs WHERE height IS NOT NULL AND NOT isnan(height) AND t IS NOT NULL)"


def predict_sql(times: str) -> str:
    """`times` is a FROM item with station and us."""
    return sql_steps(f"(SELECT * FROM {times} JOIN ({_PUBLISHED_SQL}) USING (station))", [parts(NAMES), *astro.basis_steps(astro.CATALOG), height_step(NAMES)])


_HOURS = "(SELECT station, epoch_us(TIMESTAMPTZ '{first} 00:00:00+00') + hour * 3600000000 AS us FROM gauges, range({n}) AS r(hour))"
_LONG = lambda f: "[" + ", ".join(f"{{'name': '{n}', {f(n)}}}" for n in NAMES) + "]"
SQL = {
    "ref_constituents": f"WITH r(k, rate) AS ({_RATES}), c(ord, name, species, doodson, phase0) AS (VALUES "
    + ", ".join(f"({k}, '{c.name}', '{c.species}', {list(c.doodson)}, CAST({c.phase0} AS DOUBLE))" for k, c in enumerate(astro.CATALOG))
    + ") SELECT ord, name, species, round(sum(doodson[k + 1] * rate), 7) AS speed, phase0 FROM c, r GROUP BY ALL",
    "ref_astro": f"SELECT upload_id, {', '.join(f'round({c}, 4) AS {c}' for c in _STATE)} FROM {sql_steps(_REPORTS, astro.state_steps())}",
    "ref_node_factors": "SELECT upload_id, x.name AS name, round(x.f, 4) AS f, round(x.u, 3) AS u FROM (SELECT upload_id, unnest("
    + _LONG(lambda n: f"'f': {astro.factor(astro.BY_NAME[n])}, 'u': {astro.wrapped_correction(astro.BY_NAME[n])}")
    + f") AS x FROM {sql_steps(_REPORTS, [*astro.state_steps(), *astro.node_steps()])})",
    "ref_basis": "SELECT upload_id, x.name AS name, round(x.c, 4) AS c, round(x.s, 4) AS s FROM (SELECT upload_id, unnest("
    + _LONG(lambda n: f"'c': c_{n}, 's': s_{n}")
    + f") AS x FROM {sql_steps(_REPORTS, astro.basis_steps(astro.CATALOG))})",
    "ref_predict": f"SELECT obs_id, round(tide, 4) AS tide FROM {predict_sql(OBS_SQL)}",
    "ref_forecast_day": f"SELECT station, us // 1000000 AS unix_s, round(tide, 4) AS tide FROM {predict_sql(_HOURS.format(first='2025-01-01', n=24))}",
    "ref_station_ranges": f"""WITH p AS (SELECT station, region_name, round(max(tide) - min(tide), 3) AS range_m FROM {predict_sql(_HOURS.format(first='2024-01-01', n=720))} GROUP BY ALL),
c AS (SELECT station, unnest(constituents, recursive := true) FROM gauges), k AS (SELECT station, name AS dominant, count(*) OVER (PARTITION BY station) AS constituents, row_number() OVER (PARTITION BY station ORDER BY amplitude DESC) AS rn FROM c)
SELECT region_name, station, range_m, dominant, CAST(constituents AS INT) AS constituents FROM p JOIN k USING (station) WHERE rn = 1""",
    "ref_regions": "SELECT CASE WHEN grouping(region_name) = 1 THEN 'all' ELSE coalesce(region_name, 'unknown') END AS region, count(*) AS stations, count(DISTINCT tz) AS zones FROM gauges WHERE len(constituents) > 0 GROUP BY ROLLUP (region_name)",
    "ref_station_constants": "SELECT station, name, amplitude, phase, round(amplitude * cos(radians(phase)), 6) AS a, round(amplitude * sin(radians(phase)), 6) AS b FROM (SELECT station, unnest(constituents, recursive := true) FROM gauges)",
}
