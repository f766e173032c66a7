"""Implausible measurements relative to a source's normal behaviour (problem 6).

Phase-space thresholding: for each series the value (about the median of the ten readings around it), its first and its second
difference span a space in which usual readings fill an ellipsoid. Its half-axes are robust scales (of the series, drawn
towards its station's) times the universal threshold sqrt(2 ln n); it is rotated by the robust correlation of value and
second difference. A group of one to three readings is a spike if each of them lies outside and the readings beside it, once
the group is bridged, lie inside: that is how the sides are known to agree. An exact check follows: every reading of the group
stands off the level between the sides by more than `TIMES` times the station's scatter. Of groups in each other's way the
one that stands out most is taken out first; then the ellipsoids of its series are estimated anew, until nothing changes.
Runs without any difference and bounds catch stuck and impossible values; stuck readings say nothing of the level.

Both passes read one layout (series in time order; hot series in blocks with halos), which is shuffled once: the first sums
log-scale histograms per station, so scales need no group in one task; the second flags. Both stream Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import BROADCAST_ROWS, materialize, micros, small, table
from harborline.operators.blocks import BLOCK_ROWS, ordered_blocks

BOUND = 25.0
RUN = 8
TIMES = 10.0
#: Sides agree if their difference, less the slope, is below this part of the deviation.
AGREE = 0.55
#: Each side lies on the curve of the other readings beside the group to this part of the deviation, or to the usual scatter.
FITS = 0.4
#: A neighbour further away than so many usual intervals of its series, or than LONGEST_S, lies across a gap.
GAP_STEPS, LONGEST_S = 4.0, 5400.0
HALO = 32
#: Bins per factor of two in the histograms of scales.
FINE = 16
#: Readings for which a station's usual scales count beside those of a series.
PRIOR = 50.0
#: The universal threshold is that of at least so many readings.
LEAST = 30


def _seq(a: np.ndarray, seg: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """a shifted by k within segments, and where that exists."""
    n = len(a)
    i = np.arange(n) + k
    j = np.clip(i, 0, max(n - 1, 0))
    return a[j], (i == j) & (seg[j] == seg)


def _through(t: list[np.ndarray], h: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value at x of the polynomial through the points, and the sum of squared weights."""
    value, power = np.zeros(len(x)), np.zeros(len(x))
    for j in range(len(t)):
        w = np.ones(len(x))
        for k in range(len(t)):
            if k != j:
                gap = t[j] - t[k]
                w *= (x - t[k]) / np.where(gap == 0, 1e-6, gap)
        value += w * h[j]
        power += w * w
    return value, power


def _medians(x: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The median of each segment, at each of its rows."""
    if not len(x):
        return x
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    size = np.diff(np.r_[first, len(x)])
    y = x[np.lexsort((x, seg))]
    return np.repeat((y[first + (size - 1) // 2] + y[first + size // 2]) / 2, size)


def _intervals(t: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The usual interval of each series, at each of its rows; 0 for series of one reading."""
    before, ok = _seq(t, seg, -1)
    _, number = np.unique(seg, return_inverse=True)
    usual = np.zeros(number.max(initial=-1) + 1)
    usual[number[ok]] = _medians((t - before)[ok], seg[ok])
    return usual[number]


def phase_space(t: np.ndarray, h: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """(3, n): value about the median of up to five readings on each side, half the rise between the neighbours, and twice the
    departure from the chord between them (the second difference, whatever the intervals); 0 where neighbours lack."""
    if not len(h):
        return np.zeros((3, 0))
    around = [_seq(h, seg, k) for k in (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)]
    window = np.sort(np.stack([np.where(ok, x, np.nan) for x, ok in around], axis=1), axis=1)  # NaN comes last
    size = np.sum([ok for _, ok in around], axis=0)
    row, at = np.arange(len(h)), np.maximum(size, 1)
    u = np.where(size > 0, h - (window[row, (at - 1) // 2] + window[row, at // 2]) / 2, 0.0)
    (a, both), (b, ok_b) = around[4], around[5]
    both = both & ok_b
    (ta, _), (tb, _) = _seq(t, seg, -1), _seq(t, seg, 1)
    chord = a + (b - a) * (t - ta) / np.maximum(tb - ta, 1e-6)
    return np.stack([u, np.where(both, (b - a) / 2, 0.0), np.where(both, 2 * (chord - h), 0.0)])


class Ellipsoids:
    """The ellipsoid of each series, at each of its rows, from its points and its station's usual scales (3, n)."""

    def __init__(self, points: np.ndarray, seg: np.ndarray, usual: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[first, len(seg)])
        n = np.repeat(size, size).astype(float)
        own = np.stack([1.4826 * _medians(np.abs(x), seg) for x in points])
        self.scale = np.sqrt((n * own**2 + PRIOR * usual**2) / (n + PRIOR))
        x, _, y = points / self.scale
        same, counter = _medians(np.abs(x + y), seg) ** 2, _medians(np.abs(x - y), seg) ** 2
        self.rho = np.clip((same - counter) / np.maximum(same + counter, 1e-12), -0.95, 0.95)
        self.reach = np.sqrt(2 * np.log(np.maximum(n, LEAST)))

    def outside(self, points: np.ndarray) -> np.ndarray:
        x, z, y = points / self.scale
        return (x * x - 2 * self.rho * x * y + y * y) / (1 - self.rho**2) + z * z > self.reach**2

    def shadow_holds(self, rise: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """Whether the ellipsoid has a point with these differences, whatever its value."""
        return (rise / self.scale[1]) ** 2 + (bend / self.scale[2]) ** 2 <= self.reach**2


def scatter(t: np.ndarray, h: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Each reading's distance from the cubic through its four neighbours, scaled to one reading's noise; NaN if unfit."""
    near = [(_seq(t, seg, k), _seq(h, seg, k)) for k in (-2, -1, 1, 2)]
    ok = np.logical_and.reduce([x[0][1] for x in near])
    value, power = _through([x[0][0] for x in near], [x[1][0] for x in near], t)
    with np.errstate(invalid="ignore"):
        return np.where(ok & (power < 8), np.abs(h - value) / np.sqrt(1 + power), np.nan)


def standing_out(t: np.ndarray, h: np.ndarray, seg: np.ndarray, sigma: np.ndarray, usual: np.ndarray, value: np.ndarray, outside: np.ndarray, shape: Ellipsoids, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of `width` begin that are spikes, and how far each stands out beside how far its sides disagree."""
    n = len(h)
    (tb, okb), (ta, oka) = _seq(t, seg, -1), _seq(t, seg, width)
    (hb, _), (ha, _) = _seq(h, seg, -1), _seq(h, seg, width)
    (tb2, okb2), (ta2, oka2) = _seq(t, seg, -2), _seq(t, seg, width + 1)
    (hb2, _), (ha2, _) = _seq(h, seg, -2), _seq(h, seg, width + 1)
    span, rise = np.maximum(ta - tb, 1e-6), ha - hb
    limit = np.minimum(GAP_STEPS * usual, LONGEST_S)
    # Every member lies outside and, exactly, off the level by line and by curve; no gap inside or beside the group.
    ok, least, far, previous = okb & oka, np.full(n, np.inf), np.full(n, np.inf), tb
    for k in range(width):
        (x, okx), (y, _), (out, _), (u, _) = _seq(t, seg, k), _seq(h, seg, k), _seq(outside, seg, k), _seq(value, seg, k)
        ok &= okx & out & (x - previous <= limit)
        previous, far = x, np.minimum(far, np.abs(u))
        off = np.abs(y - (hb + rise * (x - tb) / span))
        curve, _ = _through([tb2, tb, ta, ta2], [hb2, hb, ha, ha2], x)
        least = np.minimum(least, np.where(okb2 & oka2, np.minimum(off, np.abs(y - curve)), off))
    ok &= (ta - previous <= limit) & (least > TIMES * sigma)
    if not ok.any():
        return ok, np.zeros(n)
    # A second reading across a gap says nothing of a side, nor one that may be a spike itself and is off its surroundings as far.
    doubtful = np.zeros(n, bool)
    for k in range(width):
        i = np.flatnonzero(ok) + k
        doubtful[i] |= np.abs(value[i]) > AGREE * least[i - k]
    (doubt_b, _), (doubt_a, _) = _seq(doubtful, seg, -2), _seq(doubtful, seg, width + 1)
    use_b, use_a = okb2 & (tb - tb2 <= limit) & ~doubt_b, oka2 & (ta2 - ta <= limit) & ~doubt_a
    # The sides in the phase space of the bridged series, differences by usual intervals.
    steps = lambda gap: np.maximum(gap / np.maximum(usual, 1e-6), 1.0)
    bend = lambda t1, h1, t2, h2, t3, h3: 2 * (h1 + (h3 - h1) * (t2 - t1) / np.maximum(t3 - t1, 1e-6) - h2) / steps(t2 - t1) / steps(t3 - t2)
    slope = rise / np.maximum(steps(span), 2.0)
    inside = shape.shadow_holds(slope, np.where(use_b, bend(tb2, hb2, tb, hb, ta, ha), 0.0)) & shape.shadow_holds(slope, np.where(use_a, bend(tb, hb, ta, ha, ta2, ha2), 0.0))
    # Where both sides have two readings, each lies on the curve of the others as usual for the station, or well beside how far the group is.
    fits = np.ones(n, bool)
    for x, y, ts, hs in ((tb, hb, [tb2, ta, ta2], [hb2, ha, ha2]), (ta, ha, [tb2, tb, ta2], [hb2, hb, ha2])):
        curve, power = _through(ts, hs, x)
        fits &= np.abs(y - curve) <= np.maximum(shape.reach * sigma * np.sqrt(1 + power), FITS * least)
    ok &= np.where(use_b & use_a, fits, inside)
    before = np.where(use_b, (hb - hb2) / np.maximum(tb - tb2, 1e-6), 0.0)
    after = np.where(use_a, (ha2 - ha) / np.maximum(ta2 - ta, 1e-6), 0.0)
    apart = np.min([np.abs(rise - q * span) for q in (before, after, (before + after) / 2, 0 * span)], axis=0)
    # A reading between two spikes is off their level, but not off its surroundings.
    return ok & (apart < AGREE * least), np.minimum(least, far) / (apart + shape.reach * sigma)


def find_spikes(t: np.ndarray, h: np.ndarray, seg: np.ndarray, sigma: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Flags of (c). t in seconds, in order within segments; sigma: the station's scatter; scales (3, n): its phase space's."""
    flags, kept = np.zeros(len(h), bool), np.flatnonzero(~find_runs(h, seg))
    usual = np.zeros(len(h))
    usual[kept] = _intervals(t[kept], seg[kept])
    while len(kept):
        tk, hk, sk, noise = t[kept], h[kept], seg[kept], sigma[kept]
        points = phase_space(tk, hk, sk)
        shape = Ellipsoids(points, sk, scales[:, kept])
        outside = shape.outside(points)
        best, groups = np.zeros(len(kept)), []
        for width in (1, 2, 3):
            start, score = standing_out(tk, hk, sk, noise, usual[kept], points[0], outside, shape, width)
            at = np.flatnonzero(start)
            for k in range(width):
                np.maximum.at(best, at + k, score[at])
            groups.append((width, at, score[at]))
        hit = np.zeros(len(kept), bool)
        for width, at, score in groups:
            # A group waits while one that stands out more holds its members or its sides.
            first = np.logical_and.reduce([score >= best[at + k] for k in range(-1, width + 1)]) if len(at) else np.zeros(0, bool)
            for k in range(width):
                hit[at[first] + k] = True
        flags[kept[hit]] = True
        # Series without a hit stay as they are; the others are searched again without what was found.
        kept = kept[~hit & np.isin(sk, sk[hit])]
    return flags


def find_runs(h: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Flags of (b): readings in runs of at least RUN equal values."""
    if not len(h):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (h[1:] != h[:-1])])
    size = np.diff(np.r_[start, len(h)])
    return np.repeat(size >= RUN, size)


def _whole(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays holding whole blocks of series; a block's rows follow one another."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        held += b.num_rows
        if held >= rows:
            x = pa.Table.from_batches(kept)
            key = np.stack([x["key"].to_numpy(), x["_blk"].to_numpy()])
            last = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if len(last):
                cut = int(last[-1]) + 1
                yield {c: x[c].to_numpy() for c in x.column_names} if cut == held else {c: x[c].slice(0, cut).to_numpy() for c in x.column_names}
                kept, held = x.slice(cut).to_batches(), held - cut
    if held:
        x = pa.Table.from_batches(kept)
        yield {c: x[c].to_numpy() for c in x.column_names}


def _series(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row among the distinct readings (equal series, block, time and value count once), and their first rows."""
    new = np.r_[True, (x["key"][1:] != x["key"][:-1]) | (x["_blk"][1:] != x["_blk"][:-1]) | (x["us"][1:] != x["us"][:-1]) | (x["v"][1:] != x["v"][:-1])]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _segments(x: dict[str, np.ndarray], first: np.ndarray) -> np.ndarray:
    k, b = x["key"][first], x["_blk"][first]
    return np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (b[1:] != b[:-1])])


def _bins(x: np.ndarray) -> np.ndarray:
    """Log-scale bin of non-negative numbers; those below a micrometre share the lowest."""
    return np.floor(np.log2(np.maximum(x, 1e-6)) * FINE).astype(np.int32)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, int] = {}
    for x in _whole(batches):
        _, first = _series(x)
        first = first[np.abs(x["v"][first]) <= BOUND]
        if not len(first):
            continue
        t, h, seg = x["us"][first] / 1e6, x["v"][first], _segments(x, first)
        names, who = np.unique(x["source"][first].astype(str), return_inverse=True)
        core = x["_core"][first].astype(bool)
        for what, y in enumerate((scatter(t, h, seg), *np.abs(phase_space(t, h, seg)))):
            ok = core & np.isfinite(y)
            pair, n = np.unique(who[ok].astype(np.int64) * 100_000 + _bins(y[ok]) + 50_000, return_counts=True)
            for p, c in zip(pair.tolist(), n.tolist(), strict=True):
                at = (names[p // 100_000], what, p % 100_000 - 50_000)
                total[at] = total.get(at, 0) + c
    keys = list(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], ["source", "what", "bin", "n"]
    )


def scales(laid: DataFrame) -> DataFrame:
    """(source, s0..s3): scatter and the three robust scales of the phase space."""
    # In another order, so that constant columns are added above the shuffle here as in the second pass, and it is the same.
    part = laid.select(*reversed(laid.columns)).mapInArrow(_histograms, "source string, what int, bin int, n long").groupBy("source", "what", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source", "what").orderBy("bin")
    ranked = part.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy("source", "what"))})
    # The median's bin, entered in proportion; a median in the lowest bin stands for resolution coarser than the noise.
    inside = (F.col("total") / 2 - (F.col("upto") - F.col("n"))) / F.col("n")
    middle = ranked.where((F.col("upto") >= F.col("total") / 2) & (F.col("upto") - F.col("n") < F.col("total") / 2))
    value = F.pow(F.lit(2.0), (F.col("bin") + inside) / FINE) * 1.4826
    one = [F.max(F.when(F.col("what") == k, F.greatest(value, F.lit(0.001)))).alias(f"s{k}") for k in range(4)]
    return middle.groupBy("source").agg(*one)


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _whole(batches):
        place, first = _series(x)
        h = x["v"][first]
        bad = np.abs(h) > BOUND
        bad |= find_runs(h, _segments(x, first))
        sound = first[np.abs(h) <= BOUND]
        scale = np.stack([x[f"s{k}"][sound].astype(float) for k in range(4)])
        known = np.isfinite(scale).all(axis=0)
        sound, scale = sound[known], scale[:, known]
        spike = find_spikes(x["us"][sound] / 1e6, x["v"][sound], _segments(x, sound), scale[0], scale[1:])
        bad[place[sound[spike]]] = True
        yield pa.RecordBatch.from_arrays([pa.array(x["id"][bad[place] & x["_core"].astype(bool)], pa.int64())], ["id"])


def implausible(df: DataFrame, series: str, time: str, value: str, source: str, rid: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id) of the rows whose value is impossible (a), stuck (b) or a spike (c) for its source.

    Null and NaN values are missing and never flagged. Repeated rows count once and share the verdict. Rows without a series
    or time can only be impossible. A null source is a source of its own. Rows of an unknown scale are never spikes.
    """
    have = df.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(rid).isNotNull())
    use = have.select(F.col(series).cast("long").alias("key"), micros(F.col(time)).alias("us"), F.col(value).cast("double").alias("v"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(rid).alias("id"))
    placed = use.where(F.col("key").isNotNull() & F.col("us").isNotNull())
    loose = use.where((F.col("key").isNull() | F.col("us").isNull()) & (F.abs("v") > BOUND)).select("id")
    cut = ordered_blocks(placed, "key", ["us", "v", "id"], F.floor(F.col("us") / 86_400_000_000), HALO, block_rows)
    laid = cut.repartition("key", "_blk")
    if placed.select("source").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Few sources: their scales are broadcast above the one shuffle, which both passes share.
        both = laid.join(F.broadcast(scales(_sorted(laid))), "source", "left")
    else:
        both = cut.join(materialize(scales(_sorted(laid)), "scales"), "source", "left").repartition("key", "_blk")
    return _sorted(both).mapInArrow(_flags, "id long").unionByName(loose)


def _sorted(laid: DataFrame) -> DataFrame:
    """Whole blocks in order of time. Nothing may be joined above: the optimizer drops sorts below joins."""
    return laid.sortWithinPartitions("key", "_blk", "us", "v")


def odd_rates(df: DataFrame, value: str, kind: str, rid: str) -> DataFrame:
    """(id) of the rows whose rate is infinite or more than TIMES times the spread (MAD about the median) of its kind.

    Null and NaN rates are missing. Medians come from sketches of 1/10000 in rank. A kind whose spread is 0 flags only rates
    that differ from its median.
    """
    use = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(rid).alias("id"), F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(value).alias("v"))
    finite = use.where(F.abs("v") < float("inf"))
    middle = small(finite.groupBy("kind").agg(F.percentile_approx("v", 0.5, 10_000).alias("m")))
    spread = small(finite.join(middle, "kind").groupBy("kind").agg(F.first("m").alias("m"), (1.4826 * F.percentile_approx(F.abs(F.col("v") - F.col("m")), 0.5, 10_000)).alias("s")))
    odd = (F.abs("v") == float("inf")) | (F.abs(F.col("v") - F.col("m")) > TIMES * F.col("s"))
    return use.join(spread, "kind", "left").where(odd).select("id")


def p6_found(spark, d: str) -> DataFrame:
    """Rows of obs with impossible, stuck or spiking heights, and reports of qc_reports with incredible slopes."""
    obs = implausible(table(spark, d, "obs"), "upload_id", "t", "height", "station", "obs_id")
    return obs.select(F.lit("obs").alias("origin"), F.col("id").alias("row_id")).unionByName(_reports(spark, d))


def _reports(spark, d: str) -> DataFrame:
    return odd_rates(table(spark, d, "qc_reports"), "drift_slope_m_per_day", "sensor", "upload_id").select(F.lit("qc_reports").alias("origin"), F.col("id").alias("row_id"))


QUERIES = {"p6_found": p6_found, "p6_reports": _reports}
SQL = {
    "p6_reports": """WITH f AS (SELECT upload_id, coalesce(sensor, '') AS k, drift_slope_m_per_day AS v FROM qc_reports WHERE drift_slope_m_per_day IS NOT NULL AND NOT isnan(drift_slope_m_per_day)),
m AS (SELECT k, median(v) AS m FROM f WHERE NOT isinf(v) GROUP BY k),
s AS (SELECT k, m, 1.4826 * median(abs(v - m)) AS s FROM f JOIN m USING (k) WHERE NOT isinf(v) GROUP BY k, m)
SELECT 'qc_reports' AS origin, upload_id AS row_id FROM f LEFT JOIN s USING (k) WHERE isinf(v) OR abs(v - m) > 10 * s""",
}
