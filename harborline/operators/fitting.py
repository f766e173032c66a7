"""Fits: harmonic least squares with selection, generalised Pareto tails, weather response, river coupling, state-space smoothing.

A harmonic fit needs only sums of products of the basis columns, so every partition adds up small matrices and the sums are
merged by station: no station's readings meet in one task, and the selection by F-test works on the sums alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import materialize, small, table, take_bounded
from harborline.functions import astro
from harborline.operators.blocks import ordered_blocks
from harborline.operators.series import _P, OBS_SQL, _obs, _predicted, with_neighbours
from harborline.plans.steps import with_steps

BASIC = ["M2", "S2", "N2", "K1", "O1"]
#: Candidates of the queries and jobs: the whole catalogue, dominant first.
CANDIDATES = [c.name for c in astro.CATALOG]
#: Readings of a series smoothed at once, and the most blocks of longer series.
SMOOTHED, BLOCKS = 200_000, 100_000
#: Stations whose sums one partition holds before it hands them on.
HELD = 2_000
FIT = (
    "station string, names array<string>, coef array<double>, covariance array<array<double>>, sigma2 double, rmse double, n_obs long, span_h double, "
    "amplitude array<double>, phase_deg array<double>, sigma_amp array<double>, excluded array<string>"
)


ARGUMENTS = ("tau", "s", "h", "p", "n", "pp")


def with_astronomy(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """df(us) with what basis_columns() needs, and the columns' names.

    The sines and cosines of the whole catalogue would make generated code too large to be compiled; arguments and factors do not.
    """
    families = sorted({astro.BY_NAME[n].family for n in names})
    nodes = {k: v for k, v in astro.node_steps()[0].items() if k[2:] in families}
    return with_steps(df, [*astro.state_steps(), nodes]), [*ARGUMENTS, *nodes]


def basis_columns(x: Mapping, names: list[str]) -> list[np.ndarray]:
    """f cos(V + u) and f sin(V + u) of each constituent, from arrays of the columns of with_astronomy()."""
    out = []
    for c in (astro.BY_NAME[n] for n in names):
        angle = np.radians(sum(d * x[a] for d, a in zip(c.doodson, ARGUMENTS, strict=True) if d) + c.phase0 + c.power * x[f"u_{c.family}"])
        f = x[f"f_{c.family}"] ** c.power
        out += [f * np.cos(angle), f * np.sin(angle)]
    return out


def product_sums(obs: DataFrame, names: list[str]) -> DataFrame:
    """obs(station, us, height) -> (station, sums, n, first_us, last_us); sums: of products of [1, c, s, ..., height], flat.

    Null stations, times or heights, NaN and infinite heights take no part.
    """
    basis, columns = with_astronomy(obs.where("station IS NOT NULL AND us IS NOT NULL AND abs(height) < 1e300"), names)
    size = 2 * len(names) + 2
    upper = np.triu_indices(size)  # only these leave the partitions
    full = np.zeros((size, size), int)
    full[upper] = full.T[upper] = np.arange(len(upper[0]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v[0][upper].tolist() for _, v in rows], pa.list_(pa.float64())), *(pa.array([v[j] for _, v in rows], pa.int64()) for j in (1, 2, 3))], ["station", "sums", "n", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([np.ones(b.num_rows), *basis_columns({c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}, names), b.column("height").to_numpy(zero_copy_only=False)])
            us = b.column("us").to_numpy(zero_copy_only=False)
            who, at = np.unique(np.asarray(b.column("station").to_pylist(), dtype=str), return_inverse=True)
            order = np.argsort(at, kind="stable")
            x, us = x[order], us[order]
            ends = np.searchsorted(at[order], np.arange(len(who) + 1))
            for name, low, high in zip(who.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                mine, when = x[low:high], us[low:high]
                one = held.setdefault(name, [np.zeros((size, size)), 0, when[0], when[0]])
                one[0] += mine.T @ mine
                one[1] += high - low
                one[2], one[3] = min(one[2], when.min()), max(one[3], when.max())
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    part = basis.select("station", "us", "height", *columns).mapInArrow(add, "station string, sums array<double>, n long, a long, b long")
    merged = part.select("station", "n", "a", "b", F.posexplode("sums").alias("k", "x")).groupBy("station", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("kx"), F.max("n").alias("n"), F.min("a").alias("first_us"), F.max("b").alias("last_us")).select("station", F.expr(f"transform(array({', '.join(map(str, full.ravel()))}), i -> kx[i].x)").alias("sums"), "n", "first_us", "last_us")


def f_tail(f: float, d2: float) -> float:
    """P(F > f) with 2 and d2 degrees of freedom."""
    return (1 + 2 * f / d2) ** (-d2 / 2) if f > 0 else 1.0


def resolvable(names: list[str], span_h: float, cycles: float = 1.0) -> list[str]:
    """In order, those that complete so many cycles of their own and of beats with each one kept before."""
    kept: list[str] = []
    for n in names:
        speed = astro.speed(astro.BY_NAME[n])
        if all(abs(speed - other) * span_h / 360.0 >= cycles for other in [0.0, *(astro.speed(astro.BY_NAME[k]) for k in kept)]):
            kept.append(n)
    return kept


def _rss(g: np.ndarray, cols: list[int]) -> float | None:
    """Residual sum of squares with these columns; None if they are collinear."""
    a, b = g[np.ix_(cols, cols)], g[cols, -1]
    scale = np.sqrt(np.diag(a))
    if (scale <= 0).any():
        return None
    r = a / np.outer(scale, scale)
    if np.linalg.eigvalsh(r)[0] < 1e-10:
        return None
    return float(g[-1, -1] - (b / scale) @ np.linalg.solve(r, b / scale))


def choose(g: np.ndarray, n: int, names: list[str], span_h: float, alpha: float) -> list[str]:
    """Forward selection by F-test (two columns at a time) from M2, among those that the record resolves."""
    cols = lambda chosen: [0, *(c for x in chosen for c in (1 + 2 * names.index(x), 2 + 2 * names.index(x)))]
    able = resolvable(names, span_h)
    chosen = ["M2"] if "M2" in able else []
    rss = _rss(g, cols(chosen))
    while rest := [x for x in able if x not in chosen]:
        tried = [(r, x) for x in rest if (r := _rss(g, cols([*chosen, x]))) is not None and 0 <= r < rss]
        if not tried:
            break
        new, best = min(tried, key=lambda t: t[0])
        d2 = n - 1 - 2 * (len(chosen) + 1)
        if d2 <= 0 or f_tail((rss - new) / 2 / max(new / d2, 1e-300), d2) >= alpha:
            break
        chosen, rss = [*chosen, best], new
    return chosen


def solve_sums(g: np.ndarray, n: int, names: list[str], chosen: list[str]) -> dict | None:
    """Coefficients, covariance and errors from sums of products; None if there are too few readings or collinear columns."""
    cols = [0, *(c for x in chosen for c in (1 + 2 * names.index(x), 2 + 2 * names.index(x)))]
    p = len(cols)
    rss = _rss(g, cols)
    if n <= p or rss is None:
        return None
    a = g[np.ix_(cols, cols)]
    scale = np.sqrt(np.diag(a))
    inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
    x = inverse @ g[cols, -1]
    rss = max(rss, 0.0)
    sigma2 = rss / (n - p)
    c = sigma2 * inverse
    u, v = x[1::2], x[2::2]
    va, vb, vab = np.diag(c)[1::2], np.diag(c)[2::2], np.array([c[1 + 2 * k, 2 + 2 * k] for k in range(len(u))])
    amp = np.hypot(u, v)
    var = np.where(amp > 0, (u * u * va + v * v * vb + 2 * u * v * vab) / np.maximum(amp, 1e-300) ** 2, (va + vb) / 2)
    return {"coef": x.tolist(), "covariance": c.tolist(), "sigma2": sigma2, "rmse": math.sqrt(rss / n), "amplitude": amp.tolist(), "phase_deg": (np.degrees(np.arctan2(v, u)) % 360).tolist(), "sigma_amp": np.sqrt(np.maximum(var, 0)).tolist()}


def fit(obs: DataFrame, names: list[str] = BASIC, select: bool = True, alpha: float = 0.05, min_obs: int = 48) -> DataFrame:
    """obs(station, us, height) -> one model per station with at least `min_obs` readings and a solvable system.

    Queries and jobs select among CANDIDATES; without `names` only the five largest are tried.
    """
    sums = product_sums(obs, names).where(F.col("n") >= min_obs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                g = np.asarray(r.sums, float).reshape(2 * len(names) + 2, -1)
                span = (r.last_us - r.first_us) / 3.6e9
                chosen = choose(g, r.n, names, span, alpha) if select else list(names)
                if got := solve_sums(g, int(r.n), names, chosen):
                    rows.append({"station": r.station, "names": chosen, **got, "n_obs": int(r.n), "span_h": span, "excluded": [x for x in names if x not in resolvable(names, span)]})
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FIT.split(", ")])

    return sums.mapInPandas(run, FIT)


def predict_bands(times: DataFrame, models: DataFrame, names: list[str] = CANDIDATES, z: float = 1.96) -> DataFrame:
    """times(station, us) with fitted models -> mean, lower, upper, se: the band adds the coefficients' and readings' variance."""
    basis, columns = with_astronomy(times.select("station", "us"), names)
    joined = basis.select("station", "us", *columns).join(small(models.select("station", F.col("names").alias("_names"), "coef", "covariance", "sigma2")), "station")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for station, part in b.groupby("station", sort=False):
                one = part.iloc[0]
                g = np.column_stack([np.ones(len(part)), *basis_columns({c: part[c].to_numpy() for c in columns}, list(one["_names"]))])
                mean = g @ np.asarray(one["coef"])
                var = np.maximum(np.einsum("ij,jk,ik->i", g, np.stack([np.asarray(x) for x in one["covariance"]]), g), 0)
                half = z * np.sqrt(var + one["sigma2"])
                parts.append(pd.DataFrame({"station": station, "us": part["us"], "mean": mean, "lower": mean - half, "upper": mean + half, "se": np.sqrt(var)}))
            if parts:
                yield pd.concat(parts)

    return joined.mapInPandas(run, "station string, us long, mean double, lower double, upper double, se double")


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.1, tol: float = 1e-8, most: int = 2000) -> np.ndarray:
    """Downhill simplex for a few variables."""
    n = len(start)
    points = np.vstack([start, start + step * np.eye(n)])
    values = np.array([f(x) for x in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(points - points[0]).max() < tol:
            break
        middle = points[:-1].mean(axis=0)
        along = lambda k: middle + k * (points[-1] - middle)  # noqa: B023, E731
        x, y = along(-1.0), f(along(-1.0))
        if y < values[0] and (y2 := f(along(-2.0))) < y:
            x, y = along(-2.0), y2
        elif y >= values[-2]:
            x = along(0.5) if y >= values[-1] else along(-0.5)
            y = f(x)
            if y >= values[-1]:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = x, y
    return points[np.argmin(values)]


def fit_tail(excess: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (scale, shape) of a generalised Pareto distribution."""

    def cost(x: np.ndarray) -> float:
        scale, shape = math.exp(x[0]), x[1]
        inside = 1 + shape * excess / scale
        if (inside <= 0).any():
            return math.inf
        return len(excess) * x[0] + (excess.sum() / scale if abs(shape) < 1e-8 else (1 + 1 / shape) * np.log(inside).sum())

    x = minimise(cost, np.array([math.log(max(excess.mean(), 1e-6)), 0.1]))
    return math.exp(x[0]), float(x[1])


def return_level(loc: float, scale: float, shape: float, rate: float, years: float) -> float:
    m = rate * years
    return loc + (scale * math.log(m) if abs(shape) < 1e-8 else scale / shape * (m**shape - 1))


def fit_tails(peaks: DataFrame, years: DataFrame, min_peaks: int = 10) -> DataFrame:
    """peaks(station, peak), years(station, years) -> GPD over the median peak and return levels of 2, 10 and 100 years.

    Peaks are declustered, so a station's are few; stations with fewer than `min_peaks` above the median have no row.
    """
    schema = "station string, loc double, scale double, shape double, n_peaks long, rate double, level_2 double, level_10 double, level_100 double"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        v = part["peak"].to_numpy(float)
        loc, span = float(np.median(v)), float(part["years"].iloc[0])
        over = v[v > loc] - loc
        if len(over) < min_peaks or not span > 0:
            return pd.DataFrame(columns=[c.split(" ")[0] for c in schema.split(", ")])
        scale, shape = fit_tail(over)
        rate = len(over) / span
        return pd.DataFrame([[part["station"].iloc[0], loc, scale, shape, len(over), rate, *(return_level(loc, scale, shape, rate, y) if rate * y > 1 else math.nan for y in (2, 10, 100))]], columns=[c.split(" ")[0] for c in schema.split(", ")])

    return peaks.join(small(years), "station").groupBy("station").applyInPandas(one, schema)


def stress(speed: str, direction: str) -> tuple[str, str]:
    """Wind stress features east and north of a wind from `direction` (degrees)."""
    return f"(-({speed}) * ({speed}) * sin(radians({direction})))", f"(-({speed}) * ({speed}) * cos(radians({direction})))"


def weather_response(surge: DataFrame, met: DataFrame, max_lag_h: int = 6, p_ref: float = 1013.25, min_coverage: float = 0.9, min_obs: int = 48) -> DataFrame:
    """surge(station, us, surge), met(station, us, wind_speed, wind_dir, pressure) -> the best-lagged linear response by station.

    Forcing is interpolated to each reading's time less the lag; per lag only sums of products leave the executors.
    (station, lag_h, intercept, stress_u, stress_v, barometer, r2, sigma, n); of equal fits the shortest lag holds.
    """
    hour = 3_600_000_000
    e, n = stress("wind_speed", "wind_dir")
    forcing = met.dropna().selectExpr("station", "us", f"{e} AS u", f"{n} AS v", f"pressure - {p_ref} AS p")
    pairs = with_neighbours(forcing, "station", ["us"], {f"{c}2": (lambda w, c=c: F.lead(c).over(w)) for c in ("us", "u", "v", "p")}, 1).where("us2 > us")
    # Each pair of forcing readings serves the whole hours it covers: the join is an equi-join on station and hour.
    pairs = pairs.withColumn("cell", F.explode(F.sequence(F.expr(f"us DIV {hour}"), F.expr(f"us2 DIV {hour}")))).withColumnRenamed("us", "us1")
    asked = surge.dropna().select("station", "us", "surge", F.explode(F.sequence(F.lit(0), F.lit(max_lag_h))).alias("lag")).withColumn("q", F.col("us") - F.col("lag") * hour).withColumn("cell", F.expr(f"q DIV {hour}"))
    met_at = asked.join(pairs, ["station", "cell"]).where("q >= us1 AND q < us2").withColumn("w", (F.col("q") - F.col("us1")) / (F.col("us2") - F.col("us1")))
    mix = lambda c: F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.col("w")
    x = [F.lit(1.0), mix("u"), mix("v"), mix("p"), F.col("surge")]
    sums = met_at.groupBy("station", "lag").agg(F.array(*(F.sum(x[i] * x[j]) for i in range(5) for j in range(5))).alias("g"), F.count(F.lit(1)).alias("n"))
    total = surge.dropna().groupBy("station").agg(F.count(F.lit(1)).alias("asked"))
    schema = "station string, lag_h int, intercept double, stress_u double, stress_v double, barometer double, r2 double, sigma double, n long"

    def best(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in part.sort_values("lag").itertuples():
            if r.n < max(min_obs, min_coverage * r.asked):
                continue
            g = np.asarray(r.g, float).reshape(5, 5)
            coef = np.linalg.lstsq(g[:4, :4], g[:4, 4], rcond=None)[0]
            rss = max(g[4, 4] - coef @ g[:4, 4], 0.0)
            spread = g[4, 4] - g[0, 4] ** 2 / g[0, 0]
            rows.append([r.station, r.lag, *coef, max(1 - rss / max(spread, 1e-300), 0.0), math.sqrt(rss / max(r.n - 4, 1)), r.n])
        out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])
        return out.loc[[out["r2"].idxmax()]] if len(out) else out

    return sums.join(total, "station").groupBy("station").applyInPandas(best, schema)


def golden(f: Callable[[float], float], low: float, high: float, tol: float = 1e-7) -> float:
    """Minimum of a one-humped function by golden sections."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tol:
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
    return (low + high) / 2


def river_coupling(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(alpha, beta) of y = alpha * q^beta with alpha >= 0 and 0.05 <= beta <= 2, by least squares over positive q."""
    ok = q > 0
    qp, yp = q[ok], y[ok]

    def at(beta: float) -> tuple[float, float]:
        x = qp**beta
        alpha = max(float(x @ yp / max(x @ x, 1e-300)), 0.0)
        return float(((yp - alpha * x) ** 2).sum()), alpha

    beta = golden(lambda b: at(b)[0], 0.05, 2.0)
    return at(beta)[1], beta


def kalman(y: np.ndarray, f: np.ndarray, h: np.ndarray, q: np.ndarray, r: float, x0: np.ndarray, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed states (n, k) and covariances of x' = f x + q, y = h_t x + r; NaN in y is missing. f and q per step or fixed."""
    n, k = len(y), len(x0)
    fs, qs = (np.broadcast_to(a, (n, k, k)) for a in (f, q))
    xp, pp, xs, ps = np.zeros((n, k)), np.zeros((n, k, k)), np.zeros((n, k)), np.zeros((n, k, k))
    x, p = x0, p0
    for t in range(n):
        if t:
            x, p = fs[t] @ x, fs[t] @ p @ fs[t].T + qs[t]
        xp[t], pp[t] = x, p
        if np.isfinite(y[t]):
            g = p @ h[t]
            s = float(h[t] @ g + r)
            x, p = x + g * (y[t] - h[t] @ x) / s, p - np.outer(g, g) / s
        xs[t], ps[t] = x, p
    for t in range(n - 2, -1, -1):
        gain = np.linalg.solve(pp[t + 1].T, fs[t + 1] @ ps[t].T).T
        xs[t] = xs[t] + gain @ (xs[t + 1] - xp[t + 1])
        ps[t] = ps[t] + gain @ (ps[t + 1] - pp[t + 1]) @ gain.T
    return xs, ps


def block_filter(y: np.ndarray, f: np.ndarray, h: np.ndarray, q: np.ndarray, r: float) -> tuple[np.ndarray, ...]:
    """What a block of readings does to any state x before it, as (a, b, c, eta, j): its readings tell of x as much as the
    information j with the vector eta, and given x the state after it has mean a x + b and covariance c. As kalman()."""
    k = len(h)
    a, b, c, eta, j = np.eye(k), np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros((k, k))
    for t in range(len(y)):
        a, b, c = f[t] @ a, f[t] @ b, f[t] @ c @ f[t].T + q[t]
        if np.isfinite(y[t]):
            g, seen, off = c @ h, h @ a, y[t] - h @ b
            s = float(h @ g + r)
            eta, j = eta + seen * off / s, j + np.outer(seen, seen) / s
            a, b, c = a - np.outer(g, seen) / s, b + g * off / s, c - np.outer(g, g) / s
    return a, b, c, eta, j


def after_block(x: np.ndarray, p: np.ndarray, block: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state and covariance after a block from those before it."""
    a, b, c, eta, j = block
    known = np.linalg.solve(np.eye(len(x)) + p @ j, np.column_stack([x + p @ eta, p]))
    return a @ known[:, 0] + b, a @ known[:, 1:] @ a.T + c


def smooth(series: DataFrame, phi: float = 0.95, q_surge: float = 1e-3, q_level: float = 1e-9, r: float = 4e-4) -> DataFrame:
    """series(key, us, height, tide) -> level, trend and AR(1) surge of height less tide, smoothed over the record.

    phi holds for an hour and is raised to the hours between readings. Series of more than SMOOTHED readings are smoothed in
    blocks, exactly as if they were whole: a first pass says what each block does to any state before it, a second, from the
    true filtered state at its start, what it makes of any smoothed state after it, and a third smooths. Only these few
    numbers a block (at most BLOCKS) meet on the driver.
    """
    schema, h = "key long, us long, level double, trend double, surge double", np.array([1.0, 0.0, 1.0])
    p0 = np.diag([0.1, 1e-8, q_surge / (1 - phi * phi)])

    def system(part: pd.DataFrame, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dt = np.diff(part["us"].to_numpy(), prepend=before) / 3.6e9
        a = phi**dt
        f, q = np.zeros((len(part), 3, 3)), np.zeros((len(part), 3, 3))
        f[:, 0, 0] = f[:, 1, 1] = 1
        f[:, 0, 1], f[:, 2, 2] = dt, a
        q[:, 0, 0], q[:, 1, 1], q[:, 2, 2] = q_level * dt, 1e-14 * dt, q_surge * (1 - a * a) / (1 - phi * phi)
        return (part["height"] - part["tide"]).to_numpy(float), f, q

    def result(part: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"key": part["key"], "us": part["us"], "level": x[:, 0], "trend": x[:, 1], "surge": x[:, 2]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("us", kind="stable")
        y, f, q = system(part, part["us"].iloc[0])
        first = np.nanmean(y) if np.isfinite(y).any() else 0.0
        return result(part, kalman(y, f, np.tile(h, (len(part), 1)), q, r, np.array([first, 0, 0]), p0)[0])

    counts = series.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMOOTHED).select(F.col("key").alias("_hot"))
    if not counts.limit(1).count():
        return series.groupBy("key").applyInPandas(whole, schema)
    same = F.col("key").eqNullSafe(F.col("_hot"))
    cold = series.join(counts, same, "left_anti").groupBy("key").applyInPandas(whole, schema)
    # Equal times go by value, so that every pass sees the same blocks; the readings beside a block give the steps into and out of it.
    order = ["us", "height", "tide"]
    cut = materialize(ordered_blocks(series.join(counts, same, "left_semi").select("key", *order), "key", order, F.floor(F.col("us") / (30 * 86_400_000_000)), 1, SMOOTHED), "smooth")
    off = F.col("height") - F.col("tide")
    means = {x["key"]: x["m"] or 0.0 for x in take_bounded(cut.where("_core").groupBy("key").agg(F.avg(F.when(~F.isnan(off), off)).alias("m")), BLOCKS, "smoothing")}

    def block(part: pd.DataFrame) -> tuple[tuple, pd.DataFrame, int, int | None]:
        """(key, block), its readings in order, the time before it and the time after it."""
        part = part.sort_values(order, kind="stable")
        core = np.flatnonzero(part["_core"].to_numpy())
        us, low, high = part["us"].to_numpy(), core[0], core[-1]
        key = part["key"].iloc[0]
        return (None if pd.isna(key) else int(key), int(part["_blk"].iloc[0])), part.iloc[core], int(us[max(low - 1, 0)]), int(us[high + 1]) if high + 1 < len(us) else None

    def filters(part: pd.DataFrame) -> pd.DataFrame:
        (key, n), own, before, _ = block(part)
        y, f, q = system(own, before)
        return pd.DataFrame({"key": pd.array([key], "Int64"), "blk": [n], "x": [np.concatenate([x.ravel() for x in block_filter(y, f, h, q, r)]).tolist()]})

    def filtered(part: pd.DataFrame, starts: dict) -> tuple[tuple, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """The block's filtered states, and gains and offsets of each smoothed state from the one after it."""
        at, own, before, after = block(part)
        y, f, q = system(own, before)
        x, p = starts[at]
        xs, ps, n = np.zeros((len(y), 3)), np.zeros((len(y), 3, 3)), len(y)
        for t in range(n):
            x, p = f[t] @ x, f[t] @ p @ f[t].T + q[t]
            if np.isfinite(y[t]):
                g = p @ h
                s = float(h @ g + r)
                x, p = x + g * (y[t] - h @ x) / s, p - np.outer(g, g) / s
            xs[t], ps[t] = x, p
        if after is not None:
            _, f2, q2 = system(own.iloc[-1:].assign(us=after), int(own["us"].iloc[-1]))
            f, q = np.concatenate([f, f2]), np.concatenate([q, q2])
        gain, rest = np.zeros((n, 3, 3)), xs.copy()
        for t in range(len(f) - 1):
            gain[t] = np.linalg.solve((f[t + 1] @ ps[t] @ f[t + 1].T + q[t + 1]).T, f[t + 1] @ ps[t].T).T
            rest[t] = xs[t] - gain[t] @ f[t + 1] @ xs[t]
        return at, own, xs, gain, rest

    parts = lambda run, kind: take_bounded(cut.groupBy("key", "_blk").applyInPandas(run, kind).orderBy("key", "blk"), BLOCKS, "smoothing")
    starts: dict = {}
    for row in parts(filters, "key long, blk long, x array<double>"):
        if row["blk"] == 0:
            x, p = np.array([means[row["key"]], 0, 0]), p0
        starts[row["key"], row["blk"]] = x, p
        v = np.asarray(row["x"])
        x, p = after_block(x, p, (v[:9].reshape(3, 3), v[9:12], v[12:21].reshape(3, 3), v[21:24], v[24:].reshape(3, 3)))

    def smoothers(part: pd.DataFrame) -> pd.DataFrame:
        (key, n), _, _, gain, rest = filtered(part, starts)
        e, g = np.eye(3), np.zeros(3)
        for t in range(len(gain) - 1, -1, -1):
            e, g = gain[t] @ e, gain[t] @ g + rest[t]
        return pd.DataFrame({"key": pd.array([key], "Int64"), "blk": [n], "x": [[*e.ravel().tolist(), *g.tolist()]]})

    ends, last, x = {}, None, np.zeros(3)
    for row in reversed(parts(smoothers, "key long, blk long, x array<double>")):
        if last is None or row["key"] != last[0]:
            x, last = np.zeros(3), (row["key"],)
        ends[row["key"], row["blk"]] = x
        x = np.asarray(row["x"][:9]).reshape(3, 3) @ x + np.asarray(row["x"][9:])

    def smoothed(part: pd.DataFrame) -> pd.DataFrame:
        at, own, xs, gain, rest = filtered(part, starts)
        x = ends[at]
        for t in range(len(xs) - 1, -1, -1):
            xs[t] = x = gain[t] @ x + rest[t]
        return result(own, xs)

    return cold.unionByName(cut.groupBy("key", "_blk").applyInPandas(smoothed, schema))


def ref_fit(spark, d: str) -> DataFrame:
    """Amplitude and phase of each station's fitted constituents."""
    models = fit(_obs(spark, d).where(F.abs("height") < 25), CANDIDATES)
    each = models.select("station", "n_obs", F.round("rmse", 4).alias("rmse"), F.explode(F.arrays_zip("names", "amplitude", "phase_deg", "sigma_amp")).alias("c"))
    return each.select("station", "n_obs", "rmse", F.col("c.names").alias("name"), F.round("c.amplitude", 4).alias("amplitude"), F.round("c.phase_deg", 2).alias("phase_deg"), F.round("c.sigma_amp", 5).alias("sigma_amp"))


def ref_fit_normal(spark, d: str) -> DataFrame:
    """The fit of the five largest constituents satisfies the normal equations: mean residual times each basis column, the largest, is 0. Records of 30 days or more."""
    obs = _obs(spark, d).where(F.abs("height") < 25).select("station", "us", "height")
    models = fit(obs, BASIC, select=False).where("span_h >= 720").select("station", F.col("names").alias("_names"), "coef")
    basis = with_steps(obs, astro.basis_steps([astro.BY_NAME[n] for n in BASIC])).join(small(models), "station")
    columns = ["1D", *(f"{k}_{n}" for n in BASIC for k in "cs")]
    resid = " + ".join(f"coef[{j}] * {c}" for j, c in enumerate(columns))
    means = basis.withColumn("r", F.expr(f"height - ({resid})")).groupBy("station").agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.expr(f"r * {c}")).alias(f"m{j}") for j, c in enumerate(columns)))
    return means.select("station", "n", (F.round(F.greatest(*(F.abs(f"m{j}") for j in range(len(columns)))), 6) + 0.0).alias("worst"))


def ref_fit_bands(spark, d: str) -> DataFrame:
    """Coverage and width of the fitted models' 95 % bands over the readings."""
    obs = _obs(spark, d).where(F.abs("height") < 25)
    bands = predict_bands(obs, materialize(fit(obs, CANDIDATES), "models")).join(obs.select("station", "us", "height"), ["station", "us"])
    return bands.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("height").between(F.col("lower"), F.col("upper")).cast("double")), 4).alias("coverage"), F.round(F.avg(F.col("upper") - F.col("lower")), 3).alias("width"))


def ref_tails(spark, d: str) -> DataFrame:
    """Pareto tails and return levels of the daily highest heights of each station."""
    obs = _obs(spark, d).where(F.abs("height") < 25)
    peaks = obs.groupBy("station", F.expr("us DIV 86400000000").alias("day")).agg(F.max("height").alias("peak"))
    years = obs.groupBy("station").agg(((F.max("us") - F.min("us")) / 3.6e9 / 24 / 365.25).alias("years"))
    got = fit_tails(peaks.select("station", "peak"), years)
    return got.select("station", "n_peaks", *(F.round(c, 3).alias(c) for c in ("loc", "scale", "shape", "rate", "level_10", "level_100")))


def ref_smooth(spark, d: str) -> DataFrame:
    """The smoothed level and surge of each upload of at least 48 readings: end level and highest surge."""
    rows = _predicted(spark, d).where(F.abs("height") < 25)
    enough = rows.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 48").select("upload_id")
    got = smooth(rows.join(enough, "upload_id").select(F.col("upload_id").alias("key"), "us", "height", "tide"))
    return got.groupBy("key").agg(F.round(F.max_by("level", "us"), 3).alias("end_level"), F.round(F.max("surge"), 3).alias("top_surge"), F.count(F.lit(1)).alias("n")).withColumnRenamed("key", "upload_id")


def ref_season(spark, d: str) -> DataFrame:
    """Median residual of each station by twelfth of the year, as the seasonal correction's table."""
    rows = _predicted(spark, d).where(F.abs("height") < 25).withColumn("resid", F.round(F.col("height") - F.col("tide"), 3))
    day = F.dayofyear(F.timestamp_micros("us")) - 1
    return rows.groupBy("station", F.floor(day * 12 / 366).cast("int").alias("bin")).agg(F.round(F.percentile("resid", F.lit(0.5)), 4).alias("bias"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (ref_fit, ref_fit_normal, ref_fit_bands, ref_tails, ref_smooth, ref_season)}
SQL = {
    "ref_fit_normal": f"SELECT station, count(*) AS n, CAST(0.0 AS DOUBLE) AS worst FROM {OBS_SQL} WHERE upload_id IS NOT NULL AND abs(height) < 25 AND station IS NOT NULL GROUP BY 1 HAVING count(*) >= 48 AND max(us) - min(us) >= 720 * 3600000000",
    "ref_season": f"SELECT station, CAST(floor((dayofyear(make_timestamp(us)) - 1) * 12 / 366) AS INT) AS bin, round(quantile_cont(round(height - tide, 3), 0.5), 4) AS bias, count(*) AS n FROM ({_P}) WHERE abs(height) < 25 GROUP BY 1, 2",
}
