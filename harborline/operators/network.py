"""Station networks: distances, harmonic grids, interpolation in space, kriging, common modes, transfer, pooling.

Pairs of places are found through near_points() (cells with halos), never by a cross join. Dense systems are between stations: up to
STATIONS they are solved as one in the tasks that apply them to points in Arrow batches; beyond, kriging solves for each point the
system of its nearest stations, and modes come from subspace iteration, which never forms the matrix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import materialize, small, table, take_bounded
from harborline.operators.near import EARTH_KM, great_circle_km, near_points, on_globe, unit

#: Stations of one network whose dense system is solved at once.
STATIONS = 3_000
#: Points solved for at once, and the nearest stations that count for each, in networks of more than STATIONS.
NEAR_POINTS, NEAR_STATIONS = 64, 64
#: Stations of all networks that one broadcast may hold.
BROADCAST_STATIONS = 200_000


def circular(x: str) -> str:
    return f"({x} - 360.0 * floor({x} / 360.0))"


def clean_grid(grid: DataFrame) -> DataFrame:
    """(point_id, lon, lat, constituent, amplitude, phase): one row per point and constituent, water only, lon in -180..180.

    Rows on land, off the globe or without constants are left out; unknown water counts as water. Of repeats the row with the
    largest amplitude, then phase, holds.
    """
    ok = grid.where(on_globe("lon", "lat") & F.col("constituent").isNotNull() & F.col("amplitude").isNotNull() & F.col("phase").isNotNull() & F.coalesce("water", F.lit(True)))
    one = ok.groupBy("point_id", "constituent").agg(F.max(F.struct("amplitude", "phase", "lon", "lat")).alias("m"))
    lon = F.col("m.lon") - F.when(F.col("m.lon") > 180, 360).otherwise(0)
    return one.select("point_id", F.round(lon, 6).alias("lon"), F.round("m.lat", 6).alias("lat"), "constituent", "m.amplitude", "m.phase")


def nearest_points(places: DataFrame, points: DataFrame, radius_km: float, k: int) -> DataFrame:
    """places(rid, lon, lat), points(pid, lon, lat) -> (rid, pid, km, place): the k nearest points within the radius.

    Equally far points go by id. The rank is cut before the shuffle, so a crowd around one place stays small.
    """
    pairs = near_points(points, places, radius_km)
    w = Window.partitionBy("rid").orderBy("km", "pid")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def krige(stations: np.ndarray, values: np.ndarray, range_km: float | None = None, nugget_part: float = 0.05) -> dict:
    """Ordinary kriging of values at (lon, lat) with exponential covariance: what evaluate() needs. At least 3 stations.

    Weights don't depend on the sill, so several values (columns) share one system; each has its own sill.
    """
    n = len(stations)
    lon, lat = stations[:, 0], stations[:, 1]
    km = great_circle_km(lon[:, None], lat[:, None], lon[None, :], lat[None, :])
    reach = range_km or 0.6 * float(km.max())
    a = np.ones((n + 1, n + 1))
    a[:n, :n] = np.exp(-km / max(reach, 1e-9)) + nugget_part * np.eye(n)
    a[n, n] = 0
    try:
        inverse = np.linalg.inv(a)
    except np.linalg.LinAlgError:  # stations at one place without a nugget
        inverse = np.linalg.pinv(a)
    return {"inverse": inverse, "stations": stations, "values": values, "reach": reach, "sill": np.maximum(values.var(axis=0), 1e-6), "nugget_part": nugget_part}


def evaluate(system: dict, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kriged mean and variance C(0) - w'k - m (m: the multiplier of the unbiasedness constraint)."""
    s = system["stations"]
    k = np.exp(-great_circle_km(lon[:, None], lat[:, None], s[None, :, 0], s[None, :, 1]) / max(system["reach"], 1e-9))
    right = np.column_stack([k, np.ones(len(lon))])
    w = right @ system["inverse"]
    part = np.maximum(1 + system["nugget_part"] - (w * right).sum(axis=1), 0)
    return w[:, :-1] @ system["values"], np.multiply.outer(part, system["sill"]) if system["values"].ndim > 1 else part * system["sill"]


def field(stations: np.ndarray, values: np.ndarray, range_km: float | None = None, nugget_part: float = 0.05) -> Callable:
    """(lon, lat) -> kriged means and variances. Fewer than 3 stations: inverse squared distances and variance 0; none: NaN.

    More than STATIONS: the NEAR_STATIONS nearest stations of each point make its own system; a range not given is 0.6 of the
    widest such neighbourhood among the points solved for at once.
    """
    n = len(stations)
    if n < 3:

        def few(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            shape = (len(lon), *values.shape[1:])
            if not n:
                return np.full(shape, np.nan), np.full(shape, np.nan)
            w = 1 / (great_circle_km(lon[:, None], lat[:, None], stations[None, :, 0], stations[None, :, 1]) + 1e-6) ** 2
            return (w / w.sum(axis=1, keepdims=True)) @ values, np.zeros(shape)

        return few
    if n <= STATIONS:
        system = krige(stations, values, range_km, nugget_part)
        return lambda lon, lat: evaluate(system, lon, lat)
    places = unit(stations[:, 0], stations[:, 1])
    columns = values if values.ndim > 1 else values[:, None]
    sill = np.maximum(columns.var(axis=0), 1e-6)

    def local(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, var = np.empty((len(lon), columns.shape[1])), np.empty((len(lon), columns.shape[1]))
        k = NEAR_STATIONS
        for low in range(0, len(lon), NEAR_POINTS):
            x, y = lon[low : low + NEAR_POINTS], lat[low : low + NEAR_POINTS]
            near = np.argpartition(((unit(x, y)[:, None, :] - places[None, :, :]) ** 2).sum(axis=2), k, axis=1)[:, :k]
            sx, sy = stations[near, 0], stations[near, 1]
            km = great_circle_km(sx[:, :, None], sy[:, :, None], sx[:, None, :], sy[:, None, :])
            reach = max(range_km or 0.6 * float(km.max()), 1e-9)
            a = np.ones((len(x), k + 1, k + 1))
            a[:, :k, :k] = np.exp(-km / reach) + nugget_part * np.eye(k)
            a[:, k, k] = 0
            right = np.ones((len(x), k + 1))
            right[:, :k] = np.exp(-great_circle_km(x[:, None], y[:, None], sx, sy) / reach)
            w = np.linalg.solve(a, right[:, :, None])[:, :, 0]
            mean[low : low + len(x)] = (w[:, :k, None] * columns[near]).sum(axis=1)
            var[low : low + len(x)] = np.maximum(1 + nugget_part - (w * right).sum(axis=1), 0)[:, None] * sill
        return (mean, var) if values.ndim > 1 else (mean[:, 0], var[:, 0])

    return local


_FIELDS: dict[str, Callable] = {}


def _once(token: str, build: Callable) -> Callable:
    """What `build` makes, once in each Python worker: dense systems are solved in tasks, never in the driver beside a running JVM."""
    if token not in _FIELDS:
        if len(_FIELDS) >= 64:
            _FIELDS.clear()
        _FIELDS[token] = build()
    return _FIELDS[token]


def krige_points(points: DataFrame, stations: DataFrame, value: str, range_km: float | None = None) -> DataFrame:
    """points(pid, lon, lat), stations(lon, lat, value) -> (pid, mean, variance) as of field()."""
    rows = take_bounded(stations.where(on_globe("lon", "lat") & F.col(value).isNotNull()).select("lon", "lat", value).orderBy("lon", "lat"), BROADCAST_STATIONS, "a network")
    xy, z, token = np.array([(r[0], r[1]) for r in rows], float).reshape(-1, 2), np.array([r[2] for r in rows], float), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _once(token, lambda: field(xy, z, range_km))
        for b in batches:
            mean, var = at(*(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lon", "lat")))
            yield pa.RecordBatch.from_arrays([b.column("pid"), pa.array(mean), pa.array(var)], ["pid", "mean", "variance"])

    use = points.where(on_globe("lon", "lat")).select("pid", "lon", "lat")
    return use.mapInArrow(run, f"pid {use.schema['pid'].dataType.simpleString()}, mean double, variance double")


def krige_columns(points: DataFrame, stations: DataFrame, range_km: float | None = None, nugget_part: float = 0.05) -> DataFrame:
    """points(pid, grp, lon, lat), stations(grp, lon, lat, z array<double>) -> (pid, grp, z, var arrays): every column of z kriged in
    each group's own network. Points of a group without stations have no row; all z of a group are equally long and without nulls.
    """
    systems: dict = {}
    for r in take_bounded(stations.where(on_globe("lon", "lat")).select("grp", "lon", "lat", "z").orderBy("grp", "lon", "lat"), BROADCAST_STATIONS, "all networks"):
        systems.setdefault(r["grp"], []).append((r["lon"], r["lat"], *r["z"]))
    tables = {g: np.array(v, float) for g, v in systems.items()}
    token = uuid.uuid4().hex
    use = points.where(on_globe("lon", "lat")).select("pid", "grp", F.col("lon").cast("double"), F.col("lat").cast("double"))
    kind = f"pid {use.schema['pid'].dataType.simpleString()}, grp {use.schema['grp'].dataType.simpleString()}, z array<double>, var array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = np.array(b.column("grp").to_pylist(), object)
            lon, lat = (b.column(c).to_numpy() for c in ("lon", "lat"))
            for g in dict.fromkeys(groups.tolist()):
                rows = np.flatnonzero(np.array([x == g for x in groups]))
                if g in tables and len(rows):
                    mean, var = _once(f"{token} {g!r}", lambda g=g: field(tables[g][:, :2], tables[g][:, 2:], range_km, nugget_part))(lon[rows], lat[rows])
                    each = pa.array(np.arange(len(rows) + 1) * mean.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("pid").take(pa.array(rows)), b.column("grp").take(pa.array(rows)), *(pa.ListArray.from_arrays(each, pa.array(np.ascontiguousarray(x).ravel())) for x in (mean, var))], ["pid", "grp", "z", "var"])

    return use.mapInArrow(run, kind)


def modes(c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(explained shares, loadings) of as many modes of a matrix of products as explain `threshold` of the variance."""
    value, vector = np.linalg.eigh(c)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    part = value / max(value.sum(), 1e-300)
    kept = max(1, int(np.searchsorted(np.cumsum(part), threshold) + 1))
    return part[:kept], vector[:, :kept]


def common_modes(grid: DataFrame, threshold: float = 0.95) -> dict:
    """grid(station, unix_s, level) -> empirical orthogonal functions of the stations over their shared steps.

    {stations, means, loadings, explained}: as many modes as explain `threshold` of the variance; a loading's sign is free. Only steps
    that all stations have count; without one, or with a single station, ValueError. The levels of a step are set side by side and the
    partitions add up products with a few directions, so neither a series nor the matrix of stations is collected.
    """
    count = grid.select("station").distinct().count()
    if count < 2:
        raise ValueError("need two stations with shared steps")
    steps = grid.groupBy("unix_s").agg(F.array_sort(F.collect_list(F.struct("station", "level"))).alias("x")).where(F.size("x") == count)
    got = subspace_modes(materialize(steps.select(F.col("x.station").alias("stations"), F.col("x.level").alias("levels")), "steps"), threshold)
    if got is None:
        raise ValueError("need two stations with shared steps")
    return got


def _times(a: np.ndarray, b: np.ndarray, by: str) -> np.ndarray:
    """Products of tall matrices without the threads of a linear algebra library, which don't go with a JVM started by the driver."""
    return np.einsum(by, a, b)


def _orthonormal(z: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, from their small matrix of products, twice for accuracy."""
    for _ in range(2):
        value, vector = np.linalg.eigh(_times(z, z, "ij,ik->jk"))
        z = _times(z, vector / np.sqrt(np.maximum(value, value.max() * 1e-15)), "ij,jk->ik")
    return z


def subspace_modes(steps: DataFrame, threshold: float, rounds: int = 60) -> dict | None:
    """steps(stations, levels), all of the same stations in order -> as common_modes(), by subspace iteration; None without steps.

    Each round is one pass: with directions q the partitions add up x (x'q) of the centred levels x, a row a station. The number of
    directions doubles until they explain `threshold`.
    """
    first = steps.select("stations").limit(1).collect()
    if not first:
        return None
    names = list(first[0][0])
    n = len(names)

    def levels(b: pa.RecordBatch) -> np.ndarray:
        return b.column("levels").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, count = np.zeros(n), 0
        for b in batches:
            s, count = s + levels(b).sum(axis=0), count + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(s), pa.array(np.full(n, count))], ["k", "s", "n"])

    means = np.array([r["s"] / r["n"] for r in steps.mapInArrow(sums, "k long, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("k").collect()])

    def products(q: np.ndarray) -> tuple[np.ndarray, float]:
        r = q.shape[1]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, square = np.zeros((n, r)), np.zeros(n)
            for b in batches:
                x = levels(b) - means
                z, square = z + x.T @ (x @ q), square + (x * x).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(square), *(pa.array(z[:, j]) for j in range(r))], ["k", "square", *(f"z{j}" for j in range(r))])

        got = steps.mapInArrow(add, "k long, square double, " + ", ".join(f"z{j} double" for j in range(r))).groupBy("k").agg(F.sum("square").alias("square"), *(F.sum(f"z{j}").alias(f"z{j}") for j in range(r))).orderBy("k").toPandas()
        return got[[f"z{j}" for j in range(r)]].to_numpy(float), float(got["square"].sum())

    q, last = _orthonormal(np.random.default_rng(0).normal(size=(n, min(n, 8)))), None
    for _ in range(rounds):
        z, total = products(q)
        value, turn = np.linalg.eigh(_times(q, z, "ij,ik->jk"))
        order = np.argsort(-value)
        value, vector = np.maximum(value[order], 0), _times(q, turn[:, order], "ij,jk->ik")
        part = value / max(total, 1e-300)
        kept = int(np.searchsorted(np.cumsum(part), threshold - 1e-12) + 1)
        steady = last is not None and len(last) == len(value) and np.abs(last - value).max() <= 1e-11 * max(value.max(), 1e-300)
        if steady and (kept <= len(value) or len(value) == n):
            break
        q, last = _orthonormal(_times(z, turn[:, order], "ij,jk->ik")) if value.min() > 1e-12 * value.max() else vector, value
        if steady or (kept > len(value) and len(value) < n):
            more = np.random.default_rng(len(value)).normal(size=(n, min(n, 2 * len(value)) - len(value)))
            q, last = _orthonormal(np.column_stack([q, more])), None
    kept = max(1, min(kept, len(value)))
    return {"stations": names, "means": means.tolist(), "loadings": vector[:, :kept], "explained": part[:kept]}


def regional_modes(grid: DataFrame, threshold: float = 0.95) -> DataFrame:
    """grid(region_name, station, unix_s, level) -> (region_name, station, mode, loading, explained): the modes of every region.

    As common_modes(), for each region by itself, null being one of them. Each step's readings are set side by side and the
    partitions add up products of stations, so no series meets in one task; a region's matrix is decomposed in one. Regions of more
    than STATIONS go through subspace_modes(), one after the other. A region of one station has that station as its mode; a
    region without shared steps has no row.
    """
    same = F.col("region_name").eqNullSafe(F.col("_r"))
    counts = grid.select(F.col("region_name").alias("_r"), "station").distinct().groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    steps = grid.groupBy("region_name", "unix_s").agg(F.array_sort(F.collect_list(F.struct("station", "level"))).alias("x")).join(small(counts), same).where(F.size("x") == F.col("_n"))
    steps = steps.select("region_name", F.col("x.station").alias("stations"), F.col("x.level").alias("levels"))
    schema = "region_name string, station string, mode int, loading double, explained double"
    great = []
    if wide := [r["_r"] for r in counts.where(F.col("_n") > STATIONS).select("_r").collect()]:  # few, as each has more than STATIONS stations
        steps = materialize(steps, "steps")
        for region in wide:
            if got := subspace_modes(steps.where(F.col("region_name").eqNullSafe(F.lit(region))), threshold):
                great += [(region, s, k, float(got["loadings"][j, k]), float(got["explained"][k])) for j, s in enumerate(got["stations"]) for k in range(len(got["explained"]))]
        steps = steps.where(F.size("stations") <= STATIONS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for region, names, levels in zip(*(b.column(c).to_pylist() for c in ("region_name", "stations", "levels")), strict=True):
                x = np.asarray(levels, float)
                # About the first step of the partition: sums of squares of the levels themselves would lose digits.
                one = held.setdefault(region, [names, x, np.zeros(len(x)), np.zeros((len(x), len(x))), 0])
                one[2] += x - one[1]
                one[3] += np.outer(x - one[1], x - one[1])
                one[4] += 1
        rows = list(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.list_(pa.string())), *(pa.array([v[j].ravel().tolist() for _, v in rows], pa.list_(pa.float64())) for j in (1, 2, 3)), pa.array([v[4] for _, v in rows], pa.int64())], ["region_name", "stations", "origin", "sums", "products", "n"])

    def decompose(part: pd.DataFrame) -> pd.DataFrame:
        names = list(part["stations"].iloc[0])
        n, mean, c = 0, np.zeros(len(names)), np.zeros((len(names), len(names)))
        for r in part.itertuples():
            sums, own = np.asarray(r.sums) / r.n, np.asarray(r.products).reshape(c.shape)
            d = np.asarray(r.origin) + sums - mean
            c += own - r.n * np.outer(sums, sums) + np.outer(d, d) * n * r.n / (n + r.n)
            mean, n = mean + d * r.n / (n + r.n), n + r.n
        share, vector = modes(c, threshold)
        return pd.DataFrame([(part["region_name"].iloc[0], s, k, vector[j, k], share[k]) for j, s in enumerate(names) for k in range(len(share))], columns=[x.split(" ")[0] for x in schema.split(", ")])

    parts = steps.mapInArrow(add, "region_name string, stations array<string>, origin array<double>, sums array<double>, products array<double>, n long")
    out = parts.groupBy("region_name").applyInPandas(decompose, schema)
    return out.unionByName(grid.sparkSession.createDataFrame(great, schema)) if great else out


def constants(gauges: DataFrame) -> DataFrame:
    """(station, region_name, lon, lat, name, amplitude, phase, a, b, var): constants with their parts; var: 1 / readings."""
    each = gauges.select("station", "region_name", "lon", "lat", "n", F.explode("constituents").alias("c")).select("station", "region_name", "lon", "lat", "n", "c.*")
    return each.selectExpr("station", "region_name", "lon", "lat", "name", "amplitude", "phase", "amplitude * cos(radians(phase)) AS a", "amplitude * sin(radians(phase)) AS b", "1.0 / greatest(coalesce(n, 1), 1) AS var")


def regional_prior(parts: DataFrame) -> DataFrame:
    """parts(region_name, name, z, var) -> (region_name, name, k, mu, tau2): inverse-variance mean and the between-station
    variance by moments, tau2 = max(0, (Q - (k - 1)) / (W - sum w^2 / W)); Q is taken about the mean in a second pass."""
    w = F.lit(1.0) / F.greatest(F.col("var"), F.lit(1e-24))
    first = parts.withColumn("w", w).groupBy("region_name", "name").agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("mu"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"))
    q = parts.withColumn("w", w).join(first, ["region_name", "name"]).groupBy("region_name", "name").agg(F.sum(F.col("w") * (F.col("z") - F.col("mu")) ** 2).alias("q"), *(F.first(c).alias(c) for c in ("k", "mu", "sw", "sw2")))
    den = F.col("sw") - F.col("sw2") / F.col("sw")
    tau2 = F.when((F.col("k") > 1) & (den > 0), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / den)).otherwise(0.0)
    return q.select("region_name", "name", "k", "mu", tau2.alias("tau2"))


def ref_grid(spark, d: str) -> DataFrame:
    """The harmonic grid with one row per wet point and constituent."""
    return clean_grid(table(spark, d, "grid"))


def _gauges(spark, d: str) -> DataFrame:
    return table(spark, d, "gauges").where(on_globe("lon", "lat")).select("station", "lon", "lat", "mean", "region_name", "constituents", "n")


def ref_station_pairs(spark, d: str) -> DataFrame:
    """Pairs of stations at most 150 km apart, with the distance."""
    g = _gauges(spark, d)
    pairs = near_points(g.select(F.col("station").alias("pid"), "lon", "lat"), g.select(F.col("station").alias("rid"), "lon", "lat"), 150.0)
    return pairs.where("pid < rid").select(F.col("pid").alias("station"), F.col("rid").alias("other"), F.round("km", 4).alias("km"))


def _nearest(spark, d: str, k: int) -> DataFrame:
    points = clean_grid(table(spark, d, "grid")).select(F.col("point_id").alias("pid"), "lon", "lat").distinct()
    return nearest_points(_gauges(spark, d).select(F.col("station").alias("rid"), "lon", "lat"), points, 30.0, k)


def ref_grid_nearest(spark, d: str) -> DataFrame:
    """The constants of the nearest wet grid point within 30 km of each station."""
    near = _nearest(spark, d, 1)
    got = clean_grid(table(spark, d, "grid")).join(small(near), F.col("point_id") == F.col("pid"))
    return got.select(F.col("rid").alias("station"), "point_id", F.round("km", 4).alias("km"), "constituent", "amplitude", "phase")


def ref_grid_blend(spark, d: str) -> DataFrame:
    """Constants at each station blended from the four nearest wet points by inverse squared distance; circular phases."""
    near = _nearest(spark, d, 4).withColumn("w", 1 / F.pow(F.col("km") + 1e-3, 2))
    near = near.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("rid")))
    got = clean_grid(table(spark, d, "grid")).join(small(near), F.col("point_id") == F.col("pid"))
    aw = F.col("amplitude") * F.col("w")
    out = got.groupBy(F.col("rid").alias("station"), "constituent").agg(F.sum(aw).alias("amplitude"), F.sum(aw * F.cos(F.radians("phase"))).alias("x"), F.sum(aw * F.sin(F.radians("phase"))).alias("y"))
    return out.selectExpr("station", "constituent", "round(amplitude, 5) AS amplitude", "round(x, 5) AS x", "round(y, 5) AS y")


def ref_grid_check(spark, d: str) -> DataFrame:
    """Published against nearest grid constants: differences of amplitude and phase, and whether both are within tolerance."""
    pub = constants(_gauges(spark, d)).select("station", F.col("name").alias("constituent"), F.col("amplitude").alias("a0"), F.col("phase").alias("p0"))
    got = pub.join(ref_grid_nearest(spark, d), ["station", "constituent"], "left")
    turn = f"abs({circular('(phase - p0 + 180.0)')} - 180.0)"
    return got.selectExpr("station", "constituent", "round(abs(amplitude - a0), 4) AS d_amp", f"round({turn}, 3) AS d_phase", f"coalesce(round(abs(amplitude - a0), 4) <= 0.05 AND round({turn}, 3) <= 5.0, false) AS ok")


def ref_prior(spark, d: str) -> DataFrame:
    """Regional prior of the cosine part of each constituent."""
    parts = constants(table(spark, d, "gauges")).where("region_name IS NOT NULL").select("region_name", "name", F.col("a").alias("z"), "var")
    return regional_prior(parts).select("region_name", "name", "k", F.round("mu", 6).alias("mu"), F.round("tau2", 6).alias("tau2"))


def ref_pool(spark, d: str) -> DataFrame:
    """Each station's cosine parts shrunk towards the regional prior; the shrinkage says how far."""
    own = constants(table(spark, d, "gauges")).where("region_name IS NOT NULL").select("station", "region_name", "name", F.col("a").alias("z"), "var")
    got = own.join(small(regional_prior(own)), ["region_name", "name"])
    w = F.when(F.col("k") == 1, 1.0).otherwise(F.col("tau2") / (F.col("tau2") + F.greatest(F.col("var"), F.lit(1e-24))))
    return got.select("station", "name", F.round(w * F.col("z") + (1 - w) * F.col("mu"), 5).alias("pooled"), F.round(1 - w, 5).alias("shrinkage"))


def both_parts(rows: DataFrame) -> DataFrame:
    """constants() -> a row for each of the parts a (cosine) and b (sine): (station, region_name, name, part, z, var)."""
    return rows.select("station", "region_name", "name", "var", F.inline(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).alias("z")) for c in "ab")))).select("station", "region_name", "name", "part", "z", "var")


def prior_of_parts(parts: DataFrame) -> DataFrame:
    """regional_prior() for each part by itself: (region_name, name, part, k, mu, tau2)."""
    keyed = parts.withColumn("name", F.struct("name", "part"))
    return regional_prior(keyed).select("region_name", "name.name", "name.part", "k", "mu", "tau2")


def pool_constants(parts: DataFrame) -> DataFrame:
    """(station, name, a, b, amplitude, phase, shrinkage_a, shrinkage_b): both parts shrunk towards the regional prior of each."""
    got = parts.join(small(prior_of_parts(parts)), ["region_name", "name", "part"])
    w = F.when(F.col("k") == 1, 1.0).otherwise(F.col("tau2") / (F.col("tau2") + F.greatest(F.col("var"), F.lit(1e-24))))
    pooled = got.select("station", "name", "part", (w * F.col("z") + (1 - w) * F.col("mu")).alias("x"), (1 - w).alias("s"))
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    each = pooled.groupBy("station", "name").agg(of("a", "x").alias("a"), of("b", "x").alias("b"), of("a", "s").alias("shrinkage_a"), of("b", "s").alias("shrinkage_b"))
    return each.select("station", "name", "a", "b", F.hypot("a", "b").alias("amplitude"), F.expr(circular("degrees(atan2(b, a))")).alias("phase"), "shrinkage_a", "shrinkage_b")


def ref_prior_parts(spark, d: str) -> DataFrame:
    """Regional prior of the cosine and the sine part of each constituent."""
    got = prior_of_parts(both_parts(constants(table(spark, d, "gauges")).where("region_name IS NOT NULL")))
    return got.select("region_name", "name", "part", "k", F.round("mu", 6).alias("mu"), F.round("tau2", 6).alias("tau2"))


def ref_pool_constants(spark, d: str) -> DataFrame:
    """Each station's constants with both parts pooled: parts, amplitude and phase, and how far each part was shrunk."""
    got = pool_constants(both_parts(constants(table(spark, d, "gauges")).where("region_name IS NOT NULL")))
    return got.select("station", "name", *(F.round(c, 5).alias(c) for c in ("a", "b", "amplitude")), F.round("phase", 3).alias("phase"), *(F.round(c, 5).alias(c) for c in ("shrinkage_a", "shrinkage_b")))


def ref_transfer(spark, d: str) -> DataFrame:
    """Gain and phase shift of each constituent from the neighbours within 100 km to each station's nearest neighbour."""
    g = _gauges(spark, d)
    pairs = near_points(g.select(F.col("station").alias("pid"), "lon", "lat"), g.select(F.col("station").alias("rid"), "lon", "lat"), 100.0).where("pid <> rid")
    c = constants(g).select("station", "name", "amplitude", "phase")
    # The reference port is the nearest neighbour; the others say how the response varies.
    first = pairs.groupBy("rid").agg(F.min_by("pid", F.struct("km", "pid")).alias("ref"))
    near = pairs.join(small(first), "rid").join(small(c.withColumnsRenamed({"station": "pid"})), "pid")
    got = near.join(small(c.select(F.col("station").alias("ref"), "name", F.col("amplitude").alias("a0"), F.col("phase").alias("p0"))), ["ref", "name"])
    w = 1 / F.pow(F.col("km") + 1e-3, 2)
    shift = F.expr(f"{circular('(phase - p0 + 180.0)')} - 180.0")
    out = got.groupBy(F.col("rid").alias("station"), "ref", "name").agg((F.sum(w * F.col("amplitude") / F.greatest(F.col("a0"), F.lit(1e-9))) / F.sum(w)).alias("gain"), (F.sum(w * shift) / F.sum(w)).alias("shift"))
    return out.select("station", "ref", "name", F.round("gain", 5).alias("gain"), F.round("shift", 3).alias("shift"))


def ref_idw(spark, d: str) -> DataFrame:
    """Mean level at every grid point by inverse squared distance from the stations within 100 km."""
    g = _gauges(spark, d).where("mean IS NOT NULL")
    points = clean_grid(table(spark, d, "grid")).select(F.col("point_id").alias("pid"), "lon", "lat").distinct()
    pairs = near_points(points, g.select(F.col("station").alias("rid"), "lon", "lat"), 100.0).join(small(g.select(F.col("station").alias("rid"), "mean")), "rid")
    w = 1 / F.pow(F.col("km") + 1e-3, 2)
    return pairs.groupBy(F.col("pid").alias("point_id")).agg(F.round(F.sum(w * F.col("mean")) / F.sum(w), 5).alias("mean"), F.count(F.lit(1)).alias("stations"))


def ref_krige(spark, d: str) -> DataFrame:
    """Mean level kriged to every grid point, with its variance."""
    points = clean_grid(table(spark, d, "grid")).select(F.col("point_id").alias("pid"), "lon", "lat").distinct()
    got = krige_points(points, _gauges(spark, d), "mean", 300.0)
    return got.select(F.col("pid").alias("point_id"), F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"))


def ref_modes(spark, d: str) -> DataFrame:
    """Common modes of the predicted hourly curves of every region's stations: loadings and explained share."""
    from harborline.operators.tides import hours, predict, published_models

    models = published_models(table(spark, d, "gauges"))
    grid = predict(hours(models, "2025-01-01", 15), models).join(small(models.select("station", "region_name")), "station").selectExpr("region_name", "station", "us DIV 1000000 AS unix_s", "tide AS level")
    return regional_modes(grid).select("region_name", "station", "mode", F.round(F.abs("loading"), 4).alias("loading"), F.round("explained", 4).alias("explained"))


QUERIES = {f.__name__: f for f in (ref_grid, ref_station_pairs, ref_grid_nearest, ref_grid_blend, ref_grid_check, ref_prior, ref_pool, ref_prior_parts, ref_pool_constants, ref_transfer, ref_idw, ref_krige, ref_modes)}

_ON = "{t}.lat BETWEEN -90 AND 90 AND {t}.lon BETWEEN -180 AND 360"
_KM = f"(2 * {EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))))"
_GRID = f"""w AS (SELECT point_id, constituent, max({{'amplitude': amplitude, 'phase': phase, 'lon': lon, 'lat': lat}}) AS m FROM grid g WHERE {_ON.format(t='g')} AND constituent IS NOT NULL AND amplitude IS NOT NULL AND phase IS NOT NULL AND coalesce(water, TRUE) GROUP BY ALL),
c AS (SELECT point_id, round(m.lon - CASE WHEN m.lon > 180 THEN 360 ELSE 0 END, 6) AS lon, round(m.lat, 6) AS lat, constituent, m.amplitude AS amplitude, m.phase AS phase FROM w),
u AS (SELECT DISTINCT point_id, lon, lat FROM c), s AS (SELECT * FROM gauges g WHERE {_ON.format(t='g')})"""
_NEAR = f"{_GRID}, n AS (SELECT q.station, p.point_id, {_KM} AS km FROM s q JOIN u p ON abs(q.lat - p.lat) < 0.3 WHERE {_KM} <= 30.0), k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY km, point_id) AS r FROM n)"
_CONST = "cc AS (SELECT station, region_name, c.name AS name, c.amplitude AS amplitude, c.phase AS phase, c.amplitude * cos(radians(c.phase)) AS z, 1.0 / greatest(coalesce(n, 1), 1) AS var FROM (SELECT *, unnest(constituents) AS c FROM gauges))"
_PRIOR = f"""{_CONST}, v AS (SELECT *, 1.0 / greatest(var, 1e-24) AS w FROM cc WHERE region_name IS NOT NULL), f AS (SELECT region_name, name, count(*) AS k, sum(w * z) / sum(w) AS mu, sum(w) AS sw, sum(w * w) AS sw2 FROM v GROUP BY 1, 2),
t AS (SELECT region_name, name, k, mu, CASE WHEN k > 1 AND sw - sw2 / sw > 0 THEN greatest(0.0, (q - (k - 1)) / (sw - sw2 / sw)) ELSE 0 END AS tau2
  FROM (SELECT f.*, (SELECT sum(w * pow(z - f.mu, 2)) FROM v WHERE v.region_name = f.region_name AND v.name = f.name) AS q FROM f))"""
_PARTS = """cc AS (SELECT station, region_name, c.name AS name, part, c.amplitude * CASE part WHEN 'a' THEN cos(radians(c.phase)) ELSE sin(radians(c.phase)) END AS z, 1.0 / greatest(coalesce(n, 1), 1) AS var
FROM (SELECT *, unnest(constituents) AS c FROM gauges), (VALUES ('a'), ('b')) AS y(part) WHERE region_name IS NOT NULL),
v AS (SELECT *, 1.0 / greatest(var, 1e-24) AS w FROM cc), f AS (SELECT region_name, name, part, count(*) AS k, sum(w * z) / sum(w) AS mu, sum(w) - sum(w * w) / sum(w) AS den FROM v GROUP BY 1, 2, 3),
e AS (SELECT region_name, name, part, sum(w * pow(z - mu, 2)) AS q FROM v JOIN f USING (region_name, name, part) GROUP BY 1, 2, 3),
t AS (SELECT region_name, name, part, k, mu, CASE WHEN k > 1 AND den > 0 THEN greatest(0.0, (q - (k - 1)) / den) ELSE 0 END AS tau2 FROM f JOIN e USING (region_name, name, part))"""
SQL = {
    "ref_prior_parts": f"WITH {_PARTS} SELECT region_name, name, part, k, round(mu, 6) AS mu, round(tau2, 6) AS tau2 FROM t",
    "ref_pool_constants": f"""WITH {_PARTS}, x AS (SELECT *, CASE WHEN k = 1 THEN 1.0 ELSE tau2 / (tau2 + greatest(var, 1e-24)) END AS wt FROM cc JOIN t USING (region_name, name, part)),
y AS (SELECT station, name, max(CASE part WHEN 'a' THEN wt * z + (1 - wt) * mu END) AS a, max(CASE part WHEN 'b' THEN wt * z + (1 - wt) * mu END) AS b, max(CASE part WHEN 'a' THEN 1 - wt END) AS sa, max(CASE part WHEN 'b' THEN 1 - wt END) AS sb FROM x GROUP BY 1, 2)
SELECT station, name, round(a, 5) AS a, round(b, 5) AS b, round(sqrt(a * a + b * b), 5) AS amplitude, round({circular('degrees(atan2(b, a))')}, 3) AS phase, round(sa, 5) AS shrinkage_a, round(sb, 5) AS shrinkage_b FROM y""",
    "ref_grid": f"WITH {_GRID} SELECT * FROM c",
    "ref_station_pairs": f"WITH {_GRID} SELECT p.station, q.station AS other, round({_KM}, 4) AS km FROM s p JOIN s q ON p.station < q.station WHERE {_KM} <= 150.0",
    "ref_grid_nearest": f"WITH {_NEAR} SELECT station, point_id, round(km, 4) AS km, constituent, amplitude, phase FROM k JOIN c USING (point_id) WHERE r = 1",
    "ref_grid_blend": f"""WITH {_NEAR}, b AS (SELECT *, 1 / pow(km + 1e-3, 2) AS w0 FROM k WHERE r <= 4), d AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY station) AS w FROM b)
SELECT station, constituent, round(sum(amplitude * w), 5) AS amplitude, round(sum(amplitude * w * cos(radians(phase))), 5) AS x, round(sum(amplitude * w * sin(radians(phase))), 5) AS y FROM d JOIN c USING (point_id) GROUP BY 1, 2""",
    "ref_grid_check": f"""WITH {_NEAR}, {_CONST}, j AS (SELECT station, constituent, amplitude, phase FROM k JOIN c USING (point_id) WHERE r = 1),
d AS (SELECT s.station, cc.name AS constituent, round(abs(j.amplitude - cc.amplitude), 4) AS d_amp, round(abs({circular('(j.phase - cc.phase + 180.0)')} - 180.0), 3) AS d_phase FROM s JOIN cc USING (station) LEFT JOIN j ON j.station = s.station AND j.constituent = cc.name)
SELECT *, coalesce(d_amp <= 0.05 AND d_phase <= 5.0, FALSE) AS ok FROM d""",
    "ref_prior": f"WITH {_PRIOR} SELECT region_name, name, k, round(mu, 6) AS mu, round(tau2, 6) AS tau2 FROM t",
    "ref_pool": f"""WITH {_PRIOR}, x AS (SELECT *, CASE WHEN k = 1 THEN 1.0 ELSE tau2 / (tau2 + greatest(var, 1e-24)) END AS wt FROM cc JOIN t USING (region_name, name))
SELECT station, name, round(wt * z + (1 - wt) * mu, 5) AS pooled, round(1 - wt, 5) AS shrinkage FROM x""",
    "ref_transfer": f"""WITH {_GRID}, {_CONST}, n AS (SELECT q.station, p.station AS nb, {_KM} AS km FROM s q JOIN s p ON p.station <> q.station WHERE {_KM} <= 100.0),
r AS (SELECT station, first(nb ORDER BY km, nb) AS ref FROM n GROUP BY 1), g AS (SELECT n.station, r.ref, x.name, 1 / pow(km + 1e-3, 2) AS w, x.amplitude / greatest(y.amplitude, 1e-9) AS gn, {circular('(x.phase - y.phase + 180.0)')} - 180.0 AS sh
  FROM n JOIN r USING (station) JOIN cc x ON x.station = n.nb JOIN cc y ON y.station = r.ref AND y.name = x.name)
SELECT station, ref, name, round(sum(w * gn) / sum(w), 5) AS gain, round(sum(w * sh) / sum(w), 3) AS shift FROM g GROUP BY ALL""",
    "ref_idw": f"WITH {_GRID}, n AS (SELECT p.point_id, q.mean, {_KM} AS km FROM u p JOIN s q ON abs(q.lat - p.lat) < 1.0 AND q.mean IS NOT NULL WHERE {_KM} <= 100.0) SELECT point_id, round(sum(mean / pow(km + 1e-3, 2)) / sum(1 / pow(km + 1e-3, 2)), 5) AS mean, count(*) AS stations FROM n GROUP BY 1",
}
