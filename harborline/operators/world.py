"""Levels at any place from a network of stations, and networks of networks: kriged constants, altimetry, modes in space, short
records, pooled tails and surges, trust in peers.

Constants are kriged with one set of weights per place (they don't depend on the sill), so a place costs one row of a small system
whatever the number of constituents; curves are then native. Peers, sources and regions are few and known from the register.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.common import materialize, small, table
from harborline.functions import astro
from harborline.operators.corrections import tail_split
from harborline.operators.fitting import BASIC, product_sums, solve_sums
from harborline.operators.network import _PARTS, both_parts, clean_grid, constants, krige_columns, prior_of_parts, regional_modes
from harborline.operators.near import on_globe
from harborline.operators.series import _R, _obs, _residuals
from harborline.operators.tides import _HOURS, hours, predict, predict_sql, published_models
from harborline.plans.steps import sql_steps, with_steps

Z95 = 1.96


def union_constituents(parts: DataFrame) -> list[str]:
    """The constituents that at least two stations have, in the catalogue's order."""
    seen = {r["name"] for r in parts.groupBy("name").agg(F.countDistinct("station").alias("k")).where("k >= 2").collect()}  # at most the catalogue
    return [c.name for c in astro.CATALOG if c.name in seen]


def network_table(gauges: DataFrame) -> tuple[DataFrame, list[str]]:
    """gauges(station, lon, lat, mean, n, constituents) -> (grp, station, lon, lat, z) and the union's names; z: mean level, then a and b of each.

    A constituent that a station lacks takes the network's inverse-variance mean; a missing mean is 0. Stations off the globe are left out.
    """
    known = gauges.where(on_globe("lon", "lat") & F.col("station").isNotNull()).dropDuplicates(["station"])
    each = constants(known.withColumn("region_name", F.lit("network"))).dropDuplicates(["station", "name"])
    names = union_constituents(each)
    w = 1 / F.greatest(F.col("var"), F.lit(1e-12))
    prior = each.groupBy("name").agg((F.sum(w * F.col("a")) / F.sum(w)).alias("a"), (F.sum(w * F.col("b")) / F.sum(w)).alias("b"))
    usual = {r["name"]: (r["a"], r["b"]) for r in prior.collect()}  # at most the catalogue
    own = each.groupBy("station").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("a", "b")))).alias("m"))
    z = [F.coalesce("mean", F.lit(0.0)), *(F.coalesce(F.col("m")[n][c], F.lit(float(usual[n][k]))) for n in names for k, c in enumerate("ab"))]
    return known.join(own, "station", "left").select(F.lit(0).alias("grp"), "station", "lon", "lat", F.array(*z).alias("z")), names


def kriged_constants(points: DataFrame, network: DataFrame, names: list[str], range_km: float | None = None, nugget_part: float = 0.05) -> DataFrame:
    """points(pid, lon, lat) -> (pid, z0, v0, x_<name>, y_<name>, vx_<name>, vy_<name>): kriged constants and their variances."""
    got = krige_columns(points.withColumn("grp", F.lit(0)), network, range_km, nugget_part)
    pick = lambda c, k, n: F.col(c)[k].alias(n)
    return got.select("pid", pick("z", 0, "z0"), pick("var", 0, "v0"), *(pick(c, 1 + 2 * k + j, f"{p}{'xy'[j]}_{n}") for k, n in enumerate(names) for j in (0, 1) for c, p in (("z", ""), ("var", "v"))))


def world_levels(times: DataFrame, at: DataFrame, names: list[str], sigma2: float = 0.0, correction: DataFrame | None = None) -> DataFrame:
    """times(pid, us) with kriged_constants() -> (pid, us, mean, lower, upper, se): the tide, and the band of its variance with sigma2.

    correction(pid, corr, cvar) is added where a place has one. Places without constants have no row.
    """
    rows = with_steps(times, astro.basis_steps([astro.BY_NAME[n] for n in names])).join(at, "pid")
    if correction is not None:
        rows = rows.join(correction.select("pid", "corr", "cvar"), "pid", "left")
    extra = ("coalesce(corr, 0.0)", "coalesce(cvar, 0.0)") if correction is not None else ("0.0", "0.0")
    mean = " + ".join(["z0", extra[0], *(f"x_{n} * c_{n} + y_{n} * s_{n}" for n in names)])
    var = " + ".join(["v0", extra[1], *(f"vx_{n} * c_{n} * c_{n} + vy_{n} * s_{n} * s_{n}" for n in names)])
    rows = rows.selectExpr("pid", "us", f"{mean} AS mean", f"{var} AS var").withColumn("half", Z95 * F.sqrt(F.col("var") + sigma2))
    return rows.select("pid", "us", "mean", (F.col("mean") - F.col("half")).alias("lower"), (F.col("mean") + F.col("half")).alias("upper"), F.sqrt("var").alias("se"))


def altimetry_correction(points: DataFrame, altimetry: DataFrame, network: DataFrame, names: list[str], range_km: float | None = None, nugget_part: float = 0.05) -> DataFrame:
    """points(pid, lon, lat), altimetry(us, lon, lat, ssh) -> (pid, corr, cvar): mean surface height less the tide at each cell of a thousandth
    of a degree, kriged to the points."""
    rows = altimetry.dropna().where(on_globe("lon", "lat")).select("us", "ssh", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat")).withColumn("pid", F.concat_ws(",", "lon", "lat"))
    cells = rows.groupBy("pid").agg(F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    tide = world_levels(rows.select("pid", "us").distinct(), kriged_constants(cells, network, names, range_km, nugget_part), names)
    resid = rows.join(tide.select("pid", "us", "mean"), ["pid", "us"]).groupBy("pid").agg(F.avg(F.col("ssh") - F.col("mean")).alias("r"), F.first("lon").alias("lon"), F.first("lat").alias("lat"))
    got = krige_columns(points.withColumn("grp", F.lit(0)), resid.select(F.lit(0).alias("grp"), "lon", "lat", F.array("r").alias("z")), range_km, nugget_part)
    return got.select("pid", F.col("z")[0].alias("corr"), F.col("var")[0].alias("cvar"))


def modes_in_space(points: DataFrame, grid: DataFrame, stations: DataFrame, threshold: float = 0.95, range_km: float | None = None, nugget_part: float = 0.05) -> DataFrame:
    """points(pid, region_name, lon, lat), grid(region_name, station, unix_s, level), stations(station, lon, lat) -> (pid, unix_s, level): the
    field rebuilt from kriged means and mode loadings of the point's region and the modes' course in time."""
    modes = materialize(regional_modes(grid, threshold), "modes")
    means = grid.groupBy("region_name", "station").agg(F.avg("level").alias("m"))
    wide = modes.groupBy("region_name", "station").agg(F.array_sort(F.collect_list(F.struct("mode", "loading"))).alias("l")).join(small(means), ["region_name", "station"])
    network = wide.join(small(stations), "station").select(F.col("region_name").alias("grp"), "lon", "lat", F.concat(F.array("m"), F.col("l.loading")).alias("z"))
    course = grid.join(small(means), ["region_name", "station"]).join(small(modes.select("region_name", "station", "mode", "loading")), ["region_name", "station"]).groupBy("region_name", "unix_s", "mode").agg(F.sum((F.col("level") - F.col("m")) * F.col("loading")).alias("c"))
    at = krige_columns(points.select("pid", F.col("region_name").alias("grp"), "lon", "lat"), network, range_km, nugget_part)
    each = at.select("pid", F.col("grp").alias("region_name"), F.col("z")[0].alias("mean"), F.posexplode(F.slice("z", 2, 10_000)).alias("mode", "l"))
    return each.join(course, ["region_name", "mode"]).groupBy("pid", "unix_s").agg((F.first("mean") + F.sum(F.col("l") * F.col("c"))).alias("level"))


def seed_short(obs: DataFrame, prior: DataFrame, names: list[str], least: int | None = None) -> DataFrame:
    """obs(station, us, height) of short records, prior(station, name, part, k, mu, tau2) -> (station, name, part, own, var, pooled, shrinkage).

    Each record is fitted on all `names` without selection, then each part is drawn to its prior by var / (tau2 + var); a prior of one
    station doesn't draw. Records of fewer readings than unknowns, or that cannot tell the constituents apart, have no row.
    """
    least = least or 2 + 2 * len(names)
    kind = "station string, name string, part string, own double, var double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                g = np.asarray(r.sums, float).reshape(2 * len(names) + 2, -1)
                if got := solve_sums(g, int(r.n), names, names):
                    var = np.diag(np.asarray(got["covariance"]))
                    rows += [(r.station, n, p, got["coef"][1 + 2 * k + j], float(var[1 + 2 * k + j])) for k, n in enumerate(names) for j, p in enumerate("ab")]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in kind.split(", ")])

    own = product_sums(obs, names).where(F.col("n") >= least).mapInPandas(run, kind)
    got = own.join(small(prior), ["station", "name", "part"])
    w = F.when(F.col("k") == 1, 1.0).otherwise(F.col("tau2") / (F.col("tau2") + F.greatest(F.col("var"), F.lit(1e-24))))
    return got.select("station", "name", "part", "own", "var", (w * F.col("own") + (1 - w) * F.col("mu")).alias("pooled"), (1 - w).alias("shrinkage"))


def weighted(value: str, weight: str = "w") -> Column:
    """Weighted mean; the plain one if all weights are 0."""
    return F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0)), F.avg(value))


def pool_tails(tails: DataFrame, by: str) -> DataFrame:
    """tails(by, loc, scale, shape, n_peaks, rate) -> one tail per group: peaks summed, scale and shape weighted by peaks, the largest
    location, the mean rate."""
    w = tails.withColumn("w", F.col("n_peaks").cast("double"))
    return w.groupBy(by).agg(F.count(F.lit(1)).alias("tails"), F.max("loc").alias("loc"), weighted("scale").alias("scale"), weighted("shape").alias("shape"), F.sum("n_peaks").alias("n_peaks"), F.avg("rate").alias("rate"))


def blend_surges(responses: DataFrame, by: str) -> DataFrame:
    """responses(by, intercept, stress_u, stress_v, barometer, lag_h, sigma, r2, n, phi) -> one response per group, weighted by n; lag and n
    rounded half to even; phi only where every response has one."""
    w = responses.withColumn("w", F.col("n").cast("double")).withColumn("lag_h", F.col("lag_h").cast("double")).withColumn("_n", F.col("n").cast("double"))
    plain = [weighted(c).alias(c) for c in ("intercept", "stress_u", "stress_v", "barometer", "sigma", "r2")]
    return w.groupBy(by).agg(*plain, F.bround(weighted("lag_h")).cast("int").alias("lag_h"), F.bround(weighted("_n")).cast("long").alias("n"), F.when(F.count("phi") == F.count(F.lit(1)), weighted("phi")).alias("phi"))


def peer_trust(stations: DataFrame, obs: DataFrame, tol: float = 0.05) -> DataFrame:
    """stations(station, peer, region_name, z0, constituents, n), obs(obs_id, station, us, height) -> (peer, rmse_with, rmse_without, gain, duplicate, trust).

    The held-out tail of each station (its last quarter) is predicted from its own level and its region's inverse-variance mean
    constants, of all peers and of all but one. A peer whose absence lowers the error loses trust, half at `tol`; so does one whose
    constants others bring, too. Stations in regions that a peer's absence leaves empty don't count without it. Peers are few.
    """
    each = constants(stations.withColumnsRenamed({"z0": "mean"}).withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)})).join(small(stations.select("station", "peer")), "station")
    peers = [r[0] for r in stations.select("peer").distinct().orderBy("peer").collect()]
    sums = each.groupBy("region_name", "name", "peer").agg(F.sum(1 / F.col("var")).alias("w"), F.sum(F.col("a") / F.col("var")).alias("wa"), F.sum(F.col("b") / F.col("var")).alias("wb"))
    # A row per left-out peer (none first) and what the others say: peers are few, so this is a small table.
    left_out = sums.withColumn("without", F.explode(F.array(F.lit(""), *(F.lit(p) for p in peers)))).where("without <> peer")
    mean = left_out.groupBy("region_name", "name", "without").agg((F.sum("wa") / F.sum("w")).alias("a"), (F.sum("wb") / F.sum("w")).alias("b"))
    names = [c.name for c in astro.CATALOG if c.name in {r[0] for r in mean.select("name").distinct().collect()}]
    part = lambda n, c: F.coalesce(F.max(F.when(F.col("name") == n, F.col(c))), F.lit(0.0))
    models = mean.groupBy("region_name", "without").agg(*(part(n, c).alias(f"{p}_{n}") for n in names for c, p in (("a", "x"), ("b", "y"))))
    tail = tail_split(obs, "station", "obs_id").where("_test").join(small(stations.select("station", "region_name", "z0")), "station")
    rows = with_steps(tail, astro.basis_steps([astro.BY_NAME[n] for n in names])).join(small(models), "region_name")
    off = F.expr(" + ".join(["z0", *(f"(x_{n} * c_{n} + y_{n} * s_{n})" for n in names)]) + " - height")
    by = rows.groupBy("station", "without").agg(F.sqrt(F.avg(off * off)).alias("rmse")).groupBy("without").agg(F.avg("rmse").alias("rmse"))
    key = stations.select("peer", F.sha2(F.to_json(F.array_sort("constituents")), 256).alias("digest"))
    copies = key.groupBy("digest").agg(F.count(F.lit(1)).alias("c"))
    twice = key.join(small(copies), "digest").groupBy("peer").agg(F.avg((F.col("c") - 1) / F.col("c")).alias("duplicate"))
    with_ = by.where("without = ''").select(F.col("rmse").alias("rmse_with"))
    got = by.where("without <> ''").select(F.col("without").alias("peer"), F.col("rmse").alias("rmse_without")).join(F.broadcast(with_)).join(twice, "peer")  # one row
    gain = (F.col("rmse_without") - F.col("rmse_with")) / F.greatest("rmse_with", F.lit(1e-9))
    kept = F.when(F.col("gain") >= 0, 1.0).otherwise(F.exp(-math.log(2.0) * (F.least(-F.col("gain"), F.lit(1.0)) / tol) ** 2))
    return got.withColumn("gain", gain).select("peer", "rmse_with", "rmse_without", "gain", "duplicate", F.greatest(F.lit(0.05), kept * (1 - F.col("duplicate"))).alias("trust"))


def _stations(spark, d: str) -> DataFrame:
    return table(spark, d, "gauges").where(on_globe("lon", "lat"))


def _at_stations(spark, d: str, digits: int = 12) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    g = _stations(spark, d).withColumns({c: F.round(c, digits) for c in ("lon", "lat")})
    network, names = network_table(g)
    points = g.select(F.col("station").alias("pid"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    times = hours(published_models(g), "2025-01-01", 1).withColumnRenamed("station", "pid")
    return points, network, names, times


def ref_world_stations(spark, d: str) -> DataFrame:
    """The world model without a nugget at the stations themselves: each station's own curve comes back."""
    points, network, names, times = _at_stations(spark, d)
    got = world_levels(times, kriged_constants(points, network, names, 300.0, 0.0), names)
    return got.select(F.col("pid").alias("station"), F.expr("us DIV 1000000").alias("unix_s"), (F.round("mean", 3) + 0.0).alias("level"), F.round("se", 2).alias("se"))


def ref_world_field(spark, d: str) -> DataFrame:
    """Level and band at every wet grid point at three hours of a day."""
    points = clean_grid(table(spark, d, "grid")).select(F.col("point_id").alias("pid"), "lon", "lat").distinct()
    network, names = network_table(_stations(spark, d))
    times = points.select("pid", F.explode(F.array(*(F.expr(f"unix_micros(TIMESTAMP '2025-01-01 {h:02d}:00:00')") for h in (0, 6, 12)))).alias("us"))
    got = world_levels(times, kriged_constants(points, network, names, 300.0), names, 1e-3)
    return got.select(F.col("pid").alias("point_id"), F.expr("us DIV 1000000").alias("unix_s"), *(F.round(c, 4).alias(c) for c in ("mean", "lower", "upper", "se")))


def ref_world_altimetry(spark, d: str) -> DataFrame:
    """The world model with surface heights 0.1 m above the tide at every station: the correction comes back."""
    # Positions as the cells of surface heights have them.
    points, network, names, times = _at_stations(spark, d, 3)
    at = materialize(kriged_constants(points, network, names, 300.0, 0.0), "places")
    ssh = world_levels(times, at, names).join(small(points), "pid").select("us", "lon", "lat", (F.col("mean") + 0.1).alias("ssh"))
    corr = altimetry_correction(points, ssh, network, names, 300.0, 0.0)
    got = world_levels(times, at, names, 0.0, corr).groupBy("pid").agg(F.max("mean").alias("high"), F.min("mean").alias("low"))
    return got.select(F.col("pid").alias("station"), (F.round("high", 3) + 0.0).alias("high"), (F.round("low", 3) + 0.0).alias("low"))


def ref_modes_in_space(spark, d: str) -> DataFrame:
    """All modes of every region's curves, kriged without a nugget to the stations themselves: the curves come back."""
    g = _stations(spark, d).where("region_name IS NOT NULL")
    models = published_models(g)
    grid = predict(hours(models, "2025-01-01", 2), models).join(small(models.select("station", "region_name")), "station").selectExpr("region_name", "station", "us DIV 1000000 AS unix_s", "tide AS level")
    places = g.select("station", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), "region_name").dropDuplicates(["station"])
    got = modes_in_space(places.withColumnRenamed("station", "pid"), grid, places.drop("region_name"), 1.0, 300.0, 0.0)
    return got.select(F.col("pid").alias("station"), "unix_s", (F.round("level", 3) + 0.0).alias("level"))


def ref_seed_short(spark, d: str) -> DataFrame:
    """Every upload as a short record: the five largest constituents fitted without selection and drawn to the region's prior."""
    obs = _obs(spark, d).where(F.abs("height") < 25)
    prior = prior_of_parts(both_parts(constants(table(spark, d, "gauges")).where("region_name IS NOT NULL")))
    owner = obs.groupBy(F.col("upload_id").cast("string").alias("station")).agg(F.min("station").alias("gauge"))
    region = owner.join(small(table(spark, d, "gauges").select(F.col("station").alias("gauge"), "region_name").dropDuplicates(["gauge"])), "gauge").join(small(prior), "region_name")
    got = seed_short(obs.select(F.col("upload_id").cast("string").alias("station"), "us", "height"), region.select("station", "name", "part", "k", "mu", "tau2"), BASIC)
    return got.select(F.col("station").cast("long").alias("upload_id"), "name", "part", *(F.round(c, 5).alias(c) for c in ("own", "pooled", "shrinkage")))


def _tails(spark, d: str) -> DataFrame:
    """Grouped figures of the orders' lines as tails of many stations in groups."""
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("peer"), "l_suppkey").agg(F.max("l_quantity").cast("double").alias("loc"), F.avg(F.col("l_tax").cast("double")).alias("scale"), F.avg(F.col("l_discount").cast("double")).alias("shape"), F.count(F.lit(1)).alias("n_peaks"), F.avg(F.col("l_quantity").cast("double")).alias("rate"))


def ref_pool_tails(spark, d: str) -> DataFrame:
    """Tails of many stations pooled into one for each peer."""
    got = pool_tails(_tails(spark, d), "peer")
    return got.select("peer", "tails", "n_peaks", *(F.round(c, 6).alias(c) for c in ("loc", "scale", "shape", "rate")))


def ref_blend_surges(spark, d: str) -> DataFrame:
    """Surge responses of many stations blended into one for each peer."""
    t = _tails(spark, d).select("peer", F.col("scale").alias("intercept"), F.col("shape").alias("stress_u"), F.col("rate").alias("stress_v"), F.col("loc").alias("barometer"), F.expr("CAST(l_suppkey % 7 AS INT)").alias("lag_h"), F.col("scale").alias("sigma"), F.col("shape").alias("r2"), F.col("n_peaks").alias("n"), F.when(F.col("peer") != "A", F.col("shape")).alias("phi"))
    got = blend_surges(t, "peer")
    return got.select("peer", "lag_h", "n", *(F.round(c, 6).alias(c) for c in ("intercept", "stress_u", "stress_v", "barometer", "sigma", "r2", "phi")))


def ref_network_report(spark, d: str) -> DataFrame:
    """What each region knows of each constituent: stations and the spread between them of both parts."""
    prior = prior_of_parts(both_parts(constants(table(spark, d, "gauges")).where("region_name IS NOT NULL")))
    of = lambda p: F.sqrt(F.max(F.when(F.col("part") == p, F.col("tau2"))))
    return prior.groupBy("region_name", "name").agg(F.max("k").alias("stations"), F.round(of("a"), 5).alias("tau_a"), F.round(of("b"), 5).alias("tau_b"))


def ref_network_noise(spark, d: str) -> DataFrame:
    """Residual errors of each region's stations: number, mean and largest RMSE, and the variance that the world model adds for them."""
    each = _residuals(spark, d).groupBy("station").agg(F.sqrt(F.avg(F.col("resid") ** 2)).alias("rmse"))
    region = small(table(spark, d, "gauges").select("station", F.coalesce("region_name", F.lit("unknown")).alias("region")).dropDuplicates(["station"]))
    got = each.join(region, "station").groupBy("region").agg(F.count(F.lit(1)).alias("stations"), F.avg("rmse").alias("mean_rmse"), F.max("rmse").alias("max_rmse"), F.greatest(F.avg(F.col("rmse") ** 2), F.lit(1e-3)).alias("sigma2"))
    return got.select("region", "stations", *(F.round(c, 6).alias(c) for c in ("mean_rmse", "max_rmse", "sigma2")))


def ref_peer_trust(spark, d: str) -> DataFrame:
    """Trust in each source of stations by leaving it out of the regions' constants and predicting the held-out readings."""
    g = table(spark, d, "gauges").where("station IS NOT NULL AND region_name IS NOT NULL").dropDuplicates(["station"])
    stations = g.select("station", F.coalesce("source", F.lit("unknown")).alias("peer"), "region_name", F.coalesce("mean", F.lit(0.0)).alias("z0"), "constituents", "n")
    got = peer_trust(stations, _obs(spark, d).where(F.abs("height") < 25).select("obs_id", "station", "us", "height"))
    return got.select("peer", *(F.round(c, 5).alias(c) for c in ("rmse_with", "rmse_without", "gain", "duplicate", "trust")))


QUERIES = {
    f.__name__: f
    for f in (ref_world_stations, ref_world_field, ref_world_altimetry, ref_modes_in_space, ref_seed_short, ref_pool_tails, ref_blend_surges, ref_network_report, ref_network_noise, ref_peer_trust)
}

_NAMES = [c.name for c in astro.CATALOG]
_OWN_SQL = """k AS (SELECT station, c.name AS name, c.amplitude * cos(radians(c.phase)) AS a, c.amplitude * sin(radians(c.phase)) AS b, greatest(coalesce(n, 1), 1) AS w FROM (SELECT *, unnest(constituents) AS c FROM gauges WHERE {globe})),
pr AS (SELECT name, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM k GROUP BY 1 HAVING count(DISTINCT station) >= 2),
fu AS (SELECT s.station, any_value(coalesce(s.mean, 0.0)) AS z0, {cols} FROM gauges s, pr LEFT JOIN k ON k.station = s.station AND k.name = pr.name WHERE {globe2} GROUP BY 1)"""
_ON = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360"
_FULL = _OWN_SQL.format(globe=_ON, globe2=_ON.replace("lat ", "s.lat ").replace("lon ", "s.lon "), cols=", ".join(f"coalesce(max(CASE WHEN pr.name = '{n}' THEN coalesce(k.{c}, pr.{c}) END), 0.0) AS {p}_{n}" for n in _NAMES for c, p in (("a", "x"), ("b", "y"))))
_HEIGHT = {"tide": " + ".join(["z0", *(f"(x_{n} * c_{n} + y_{n} * s_{n})" for n in _NAMES)])}
_WORLD = f"WITH {_FULL} SELECT station, us, tide FROM " + sql_steps(f"(SELECT * FROM {_HOURS.format(first='2025-01-01', n=24)} JOIN fu USING (station))", [*astro.basis_steps(astro.CATALOG), _HEIGHT])
_TAILS_SQL = "t AS (SELECT l_returnflag AS peer, l_suppkey, CAST(max(l_quantity) AS DOUBLE) AS loc, avg(l_tax::DOUBLE) AS scale, avg(l_discount::DOUBLE) AS shape, count(*) AS n_peaks, avg(l_quantity::DOUBLE) AS rate FROM lineitem GROUP BY 1, 2)"
_BY_N = lambda c: f"round(sum({c} * n_peaks) / sum(n_peaks), 6)"
SQL = {
    "ref_world_stations": f"SELECT station, us // 1000000 AS unix_s, round(tide, 3) + 0.0 AS level, CAST(0.0 AS DOUBLE) AS se FROM ({_WORLD})",
    "ref_world_altimetry": f"SELECT station, round(max(tide) + 0.1, 3) + 0.0 AS high, round(min(tide) + 0.1, 3) + 0.0 AS low FROM ({_WORLD}) GROUP BY 1",
    "ref_modes_in_space": f"SELECT station, us // 1000000 AS unix_s, round(tide, 3) + 0.0 AS level FROM {predict_sql(_HOURS.format(first='2025-01-01', n=48))} JOIN (SELECT station AS s2 FROM gauges WHERE {_ON} AND region_name IS NOT NULL) ON s2 = station",
    "ref_pool_tails": f"WITH {_TAILS_SQL} SELECT peer, count(*) AS tails, CAST(sum(n_peaks) AS BIGINT) AS n_peaks, round(max(loc), 6) AS loc, {_BY_N('scale')} AS scale, {_BY_N('shape')} AS shape, round(avg(rate), 6) AS rate FROM t GROUP BY 1",
    "ref_blend_surges": f"""WITH {_TAILS_SQL} SELECT peer, CAST(round_even(sum((l_suppkey % 7) * n_peaks) / sum(n_peaks), 0) AS INT) AS lag_h, CAST(round_even(sum(n_peaks * n_peaks) / sum(n_peaks), 0) AS BIGINT) AS n, {_BY_N('scale')} AS intercept, {_BY_N('shape')} AS stress_u,
{_BY_N('rate')} AS stress_v, {_BY_N('loc')} AS barometer, {_BY_N('scale')} AS sigma, {_BY_N('shape')} AS r2, CASE WHEN peer <> 'A' THEN {_BY_N('shape')} END AS phi FROM t GROUP BY 1""",
    "ref_network_report": f"WITH {_PARTS} SELECT region_name, name, max(k) AS stations, round(sqrt(max(CASE part WHEN 'a' THEN tau2 END)), 5) AS tau_a, round(sqrt(max(CASE part WHEN 'b' THEN tau2 END)), 5) AS tau_b FROM t GROUP BY 1, 2",
    "ref_network_noise": f"WITH {_R}, e AS (SELECT station, sqrt(avg(resid * resid)) AS rmse FROM r GROUP BY 1) SELECT coalesce(region_name, 'unknown') AS region, count(*) AS stations, round(avg(rmse), 6) AS mean_rmse, round(max(rmse), 6) AS max_rmse, round(greatest(avg(rmse * rmse), 1e-3), 6) AS sigma2 FROM e JOIN gauges USING (station) GROUP BY 1",
    "ref_peer_trust": f"""WITH g AS (SELECT station, coalesce(source, 'unknown') AS peer, region_name, coalesce(mean, 0.0) AS z0, constituents, greatest(coalesce(n, 1), 1) AS w FROM gauges WHERE station IS NOT NULL AND region_name IS NOT NULL),
k AS (SELECT region_name, peer, c.name AS name, c.amplitude * cos(radians(c.phase)) AS a, c.amplitude * sin(radians(c.phase)) AS b, w FROM (SELECT *, unnest(constituents) AS c FROM g)),
x AS (SELECT '' AS without UNION ALL SELECT DISTINCT peer FROM g), q AS (SELECT region_name, without, name, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM k, x WHERE k.peer <> x.without GROUP BY 1, 2, 3),
md AS (SELECT region_name, without, {', '.join(f"coalesce(max(CASE WHEN name = '{n}' THEN {c} END), 0.0) AS {p}_{n}" for n in _NAMES for c, p in (("a", "x"), ("b", "y")))} FROM q GROUP BY 1, 2),
o AS (SELECT obs_id, station, epoch_us(t) AS us, height, row_number() OVER (PARTITION BY station ORDER BY epoch_us(t) DESC, obs_id DESC) AS back, count(*) OVER (PARTITION BY station) AS m FROM obs WHERE height IS NOT NULL AND NOT isnan(height) AND t IS NOT NULL AND upload_id IS NOT NULL AND abs(height) < 25),
tl AS (SELECT o.station, us, height, z0, md.* FROM o JOIN g USING (station) JOIN md USING (region_name) WHERE back <= greatest(24, CAST(round_even(m * 0.25, 0) AS BIGINT))),
e AS (SELECT without, avg(rmse) AS rmse FROM (SELECT station, without, sqrt(avg((tide - height) * (tide - height))) AS rmse FROM {sql_steps('tl', [*astro.basis_steps(astro.CATALOG), _HEIGHT])} GROUP BY 1, 2) GROUP BY 1),
dg AS (SELECT peer, list_sort(list_transform(constituents, lambda y: y::VARCHAR))::VARCHAR AS dig FROM g), cp AS (SELECT dig, count(*) AS c FROM dg GROUP BY 1), du AS (SELECT peer, avg((c - 1) / c) AS duplicate FROM dg JOIN cp USING (dig) GROUP BY 1),
f AS (SELECT e.without AS peer, b.rmse AS rw, e.rmse AS ro, (e.rmse - b.rmse) / greatest(b.rmse, 1e-9) AS gain, duplicate FROM e JOIN (SELECT rmse FROM e WHERE without = '') b ON e.without <> '' JOIN du ON du.peer = e.without)
SELECT peer, round(rw, 5) AS rmse_with, round(ro, 5) AS rmse_without, round(gain, 5) AS gain, round(duplicate, 5) AS duplicate, round(greatest(0.05, CASE WHEN gain >= 0 THEN 1.0 ELSE exp(-ln(2.0) * pow(least(-gain, 1.0) / 0.05, 2)) END * (1 - duplicate)), 5) AS trust FROM f""",
}
