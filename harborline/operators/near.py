"""Points near other points or regions (problem 2).

Positions become unit vectors, so no convention or seam of the longitudes matters. A bounded sample of both sides is cut into
k-d cells; each point goes to its cell, each reference to every cell its ball touches (halo copies). A cell with many points
is salted, its references copied to each salt; one with many references is parted, its points copied to each part. A task
builds a local k-d tree of its references and streams its points past it by chord radius; the great-circle distance decides.
Regions are cut by k-d splits of the lon/lat plane: an edge descends only to the cells it touches, and what lies above a cell
is drawn together to one edge a stretch, which counts as often. In a cell the edges are swept in order of longitude: points
between two successive edge ends are counted against the edges active there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import table

EARTH_KM = 6371.0088
#: Rows of each side that the cells are fitted on; every row is then placed.
SAMPLE = 20_000
#: Points, and references, that one task should hold.
CELL_ROWS = 50_000
#: Pairs, or points times edges, worked on at once.
CHUNK = 2_000_000
LEAF = 32


def on_globe(lon: str, lat: str) -> F.Column:
    """lat within ±90, lon within -180..360; false for null and NaN."""
    return F.coalesce(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 360), F.lit(False))


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)


def great_circle_km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.radians(x) for x in (lon1, lat1, lon2, lat2))
    s = np.sin((d - b) / 2) ** 2 + np.cos(b) * np.cos(d) * np.sin((c - a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(s, 0, 1)))


class Splits:
    """k-d splits of a sample: inner nodes in arrays; a cell is a leaf's number."""

    def __init__(self, xs: np.ndarray, cells: int) -> None:
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.cells = 0
        self.share: list[float] = []
        self.root = self._build(xs, max(1, cells), max(1, len(xs)))

    def _build(self, xs: np.ndarray, cells: int, total: int) -> int:
        spread = np.ptp(xs, axis=0) if len(xs) else np.zeros(1)
        axis = int(np.argmax(spread))
        if cells > 1 and spread[axis] > 0:
            cut = float(np.median(xs[:, axis]))
            left = xs[:, axis] < cut
            if not left.any():  # the median is the smallest value: cut above it
                cut = float(xs[xs[:, axis] > cut, axis].min())
                left = xs[:, axis] < cut
            k = len(self.axis)
            self.axis.append(axis)
            self.cut.append(cut)
            self.child.append((0, 0))
            self.child[k] = (self._build(xs[left], cells // 2, total), self._build(xs[~left], cells - cells // 2, total))
            return k
        self.cells += 1
        self.share.append(len(xs) / total)
        return -self.cells

    def place(self, xs: np.ndarray, reach: np.ndarray | float = 0.0, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the cells that each row's box xs-reach .. (high or xs)+reach touches; one cell without reach."""
        rows, cells = [], []
        high = xs if high is None else high
        reach = np.broadcast_to(np.asarray(reach, float), (len(xs),))
        todo = [(self.root, np.arange(len(xs)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                cells.append(np.full(len(at), -node - 1))
                continue
            a, c = self.axis[node], self.cut[node]
            todo.append((self.child[node][0], at[xs[at, a] - reach[at] < c]))
            todo.append((self.child[node][1], at[high[at, a] + reach[at] >= c]))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


class Tree:
    """A local k-d tree over unit vectors, searched by chord radius for many points at once."""

    def __init__(self, xs: np.ndarray) -> None:
        self.xs = xs
        self.root = self._build(np.arange(len(xs)))

    def _build(self, at: np.ndarray):  # noqa: ANN202 - a leaf's rows or (axis, cut, left, right)
        spread = np.ptp(self.xs[at], axis=0) if len(at) else np.zeros(3)
        axis = int(np.argmax(spread))
        if len(at) <= LEAF or spread[axis] == 0:
            return at
        order = at[np.argsort(self.xs[at, axis], kind="stable")]
        half = len(order) // 2
        return axis, float(self.xs[order[half], axis]), self._build(order[:half]), self._build(order[half:])

    def within(self, qs: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs at most `chord` apart."""
        out_q, out_r = [np.zeros(0, int)], [np.zeros(0, int)]
        todo = [(self.root, np.arange(len(qs)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, tuple):
                axis, cut, left, right = node
                todo.append((left, at[qs[at, axis] <= cut + chord]))
                todo.append((right, at[qs[at, axis] >= cut - chord]))
                continue
            for part in range(0, len(at), 4096):
                some = at[part : part + 4096]
                for low in range(0, len(node), 1024):  # equal positions make leaves of any size
                    refs = node[low : low + 1024]
                    d2 = ((qs[some][:, None, :] - self.xs[refs][None, :, :]) ** 2).sum(axis=2)
                    q, r = np.nonzero(d2 <= chord * chord)
                    out_q.append(some[q])
                    out_r.append(refs[r])
        return np.concatenate(out_q), np.concatenate(out_r)


def _sample(df: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """At most about n (lon, lat) rows spread over the table, and its row count."""
    total = df.count()
    part = df.select("lon", "lat") if total <= n else df.select("lon", "lat").sample(fraction=min(1.0, n / total), seed=7)
    got = part.limit(2 * n).toPandas()
    return got[["lon", "lat"]].to_numpy(float), total


def _spread(points: DataFrame, splits: Splits, flat: bool, salts: np.ndarray, parts: np.ndarray) -> DataFrame:
    """points(pid, lon, lat) with their cell and salt, once for each part of the cell's references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lon, lat = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
            at, cell = splits.place(np.stack([_west(lon), lat], axis=1) if flat else unit(lon, lat))
            cells = np.empty(len(lon), int)
            cells[at] = cell
            salt = np.arange(len(lon)) % salts[cells]
            row, part = _copies(parts[cells])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in ("pid", "lon", "lat")), pa.array(cells[row]), pa.array(salt[row]), pa.array(part)], ["pid", "lon", "lat", *TASK])

    kind = points.schema["pid"].dataType.simpleString()
    return points.select("pid", "lon", "lat").mapInArrow(run, f"pid {kind}, lon double, lat double, cell long, salt long, part long")


TASK = ("cell", "salt", "part")


def _copies(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row so many times, and the number of each copy."""
    return np.repeat(np.arange(len(times)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def _meet(points: DataFrame, refs: DataFrame, build: Callable, search: Callable, schema: str) -> DataFrame:
    """What `search` finds of the points (pid, lon, lat and TASK) in what `build` makes of the same task's references.

    A task's references come first and are held; its points are streamed, so neither they nor the pairs are gathered.
    """
    here, there = ({f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (refs, points))
    lack = lambda have, of: [F.lit(None).cast(t).alias(c) for c, t in of.items() if c not in have]
    both = refs.select("*", *lack(here, there), F.lit(0).alias("side")).unionByName(points.select("*", *lack(there, here), F.lit(1).alias("side")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, found = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in (*TASK, "side")])
            starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, b.num_rows]
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if task != (now := tuple(keys[:3, low].tolist())):
                    task, held, found = now, [], None
                if keys[3, low] == 0:
                    held.append(b.slice(low, high - low))
                elif held:
                    found = build(pa.Table.from_batches(held)) if found is None else found
                    yield from search(found, b.slice(low, high - low))

    return both.repartition(*TASK).sortWithinPartitions(*TASK, "side").mapInArrow(run, schema)


def _west(lon: np.ndarray) -> np.ndarray:
    """Longitudes as -180 <= lon < 180."""
    return (lon + 180.0) % 360.0 - 180.0


def _shares(share: np.ndarray, rows: float, cell_rows: int) -> np.ndarray:
    return np.maximum(1, np.ceil(share * rows / cell_rows)).astype(int)


def near_points(points: DataFrame, refs: DataFrame, radius_km: float, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """points(pid, lon, lat), refs(rid, lon, lat) -> (pid, rid, km) for all pairs at most `radius_km` apart.

    Rows without a position on the globe (on_globe) or id have no pair. Repeated rows of a side pair repeatedly.
    """
    points, refs = (df.where(on_globe("lon", "lat") & F.col(c).isNotNull()).select(c, F.col("lon").cast("double"), F.col("lat").cast("double")) for df, c in ((points, "pid"), (refs, "rid")))
    places = refs.groupBy("lon", "lat").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("_n"))
    if not places.where("_n > 1").isEmpty():
        # References at one position are searched once and expanded afterwards: a cell never holds copies of a position.
        pairs = _near_places(points, places.drop("_n"), radius_km, sample, cell_rows)
        members = refs.join(places.select("lon", "lat", F.col("rid").alias("_first")), ["lon", "lat"]).select("_first", F.col("rid").alias("_rid"))
        return pairs.join(members, F.col("rid") == F.col("_first")).select("pid", F.col("_rid").alias("rid"), "km")
    return _near_places(points, refs, radius_km, sample, cell_rows)


def _near_places(points: DataFrame, refs: DataFrame, radius_km: float, sample: int, cell_rows: int) -> DataFrame:
    """near_points() of clean rows, references at distinct positions."""
    chord = 2 * np.sin(min(radius_km / (2 * EARTH_KM), np.pi / 2)) * (1 + 1e-9) + 1e-12
    (ps, n), (rs, m) = _sample(points, sample), _sample(refs, sample)
    splits = Splits(unit(*np.concatenate([ps, rs]).T), min(4096, -(-(n + m) // cell_rows)))
    share = lambda cells, of: np.bincount(cells, minlength=splits.cells) / max(of, 1)
    salts = _shares(share(splits.place(unit(*ps.T))[1], len(ps)), n, cell_rows)
    parts = _shares(share(splits.place(unit(*rs.T), chord)[1], len(rs)), m, cell_rows)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lon, lat = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
            at, cell = splits.place(unit(lon, lat), chord)
            part = at % parts[cell]
            row, salt = _copies(salts[cell])
            take = pa.array(at[row])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("rid", "lon", "lat")), pa.array(cell[row]), pa.array(salt), pa.array(part[row])], ["rid", "lon", "lat", *TASK])

    pk, rk = points.schema["pid"].dataType.simpleString(), refs.schema["rid"].dataType.simpleString()
    halo = refs.mapInArrow(copies, f"rid {rk}, lon double, lat double, cell long, salt long, part long")

    def build(t: pa.Table) -> tuple:
        lon, lat = t["lon"].to_numpy(), t["lat"].to_numpy()
        return Tree(unit(lon, lat)), lon, lat, t["rid"].combine_chunks()

    def search(found: tuple, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tree, rlon, rlat, rid = found
        lon, lat, pid = b.column("lon").to_numpy(), b.column("lat").to_numpy(), b.column("pid")
        low, size = 0, 256
        while low < len(lon):
            x, y = lon[low : low + size], lat[low : low + size]
            q, r = tree.within(unit(x, y), chord)
            km = great_circle_km(x[q], y[q], rlon[r], rlat[r])
            ok = km <= radius_km
            yield pa.RecordBatch.from_arrays([pid.take(pa.array(low + q[ok])), rid.take(pa.array(r[ok])), pa.array(km[ok])], ["pid", "rid", "km"])
            low += size
            size = int(np.clip(CHUNK * len(x) / max(len(q), 1), 1, 8192))  # so that the next pairs stay few

    return _meet(_spread(points, splits, False, salts, parts), halo, build, search, f"pid {pk}, rid {rk}, km double")


def sweep(lon: np.ndarray, lat: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, owner) of all polygons around each point. Edges x1 < x2 by owner; even-odd rule, ends half open in x."""
    order = np.argsort(lon, kind="stable")
    px = lon[order]
    stops = np.unique(np.concatenate([x1, x2]))
    first = np.searchsorted(px, stops, "left")
    entering = np.argsort(x1, kind="stable")
    starts = np.searchsorted(x1[entering], stops, "right")
    active, upto = np.zeros(0, int), 0
    out_p, out_o = [np.zeros(0, int)], [np.zeros(0, int)]
    for k in np.flatnonzero(first[1:] > first[:-1]).tolist():  # only where there are points
        active = np.concatenate([active, entering[upto : starts[k]]])
        active, upto = active[x2[active] > stops[k]], starts[k]
        if not len(active):
            continue
        edges = active[np.argsort(owner[active], kind="stable")]
        who, begin = np.unique(owner[edges], return_index=True)
        rows = max(1, CHUNK // len(edges))
        for low in range(first[k], first[k + 1], rows):
            at = order[low : min(first[k + 1], low + rows)]
            w = (lon[at][:, None] - x1[edges]) / (x2[edges] - x1[edges])
            above = y1[edges] + w * (y2[edges] - y1[edges]) > lat[at][:, None]
            p, o = np.nonzero(np.logical_xor.reduceat(above, begin, axis=1))
            out_p.append(at[p])
            out_o.append(who[o])
    return np.concatenate(out_p), np.concatenate(out_o)


def ring_edges(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """(n, 4) edges xa, ya, xb, yb of a ring along its way, closed or not; vertices that are no numbers are left out."""
    xy = np.stack([lon, lat], axis=1).astype(float)
    xy = xy[np.isfinite(xy).all(axis=1)]
    return np.concatenate([xy, np.roll(xy, -1, axis=0)], axis=1) if len(xy) >= 3 else np.zeros((0, 4))


#: Where edges above a cell are drawn: higher than any latitude.
ABOVE = 1_000.0


def lower(e: np.ndarray, cut: float) -> np.ndarray:
    """The edges as points below `cut` see them: stretches of successive edges above become one, which each longitude crosses
    as often (odd or even), and stretches that come back to their longitude vanish."""
    high = np.minimum(e[:, 1], e[:, 3]) >= cut
    if not high.any():
        return e
    joins = np.r_[False, high[1:] & high[:-1] & (e[1:, 0] == e[:-1, 2])]
    begin = np.flatnonzero(~joins)
    end = np.r_[begin[1:], len(e)] - 1
    out = np.stack([e[begin, 0], np.where(high[begin], ABOVE, e[begin, 1]), e[end, 2], np.where(high[begin], ABOVE, e[end, 3])], axis=1)
    return out[out[:, 0] != out[:, 2]]


def descend(splits: Splits, e: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, edges) of each cell of lon/lat splits that a ring's edges matter in, clipped on the way down."""
    todo = [(splits.root, e[e[:, 0] != e[:, 2]])]
    while todo:
        node, e = todo.pop()
        if not len(e):
            continue
        if node < 0:
            yield -node - 1, np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
            continue
        axis, cut, (left, right) = splits.axis[node], splits.cut[node], splits.child[node]
        if axis == 0:
            todo.append((left, e[np.minimum(e[:, 0], e[:, 2]) < cut]))
            todo.append((right, e[np.maximum(e[:, 0], e[:, 2]) > cut]))
        else:
            todo.append((left, lower(e, cut)))
            todo.append((right, e[np.maximum(e[:, 1], e[:, 3]) >= cut]))


def in_regions(points: DataFrame, regions: DataFrame, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """points(pid, lon, lat), regions(rid, ring array<struct<lon, lat>>) -> (pid, rid): the regions around each point.

    Rings are polygons with straight edges in the lon/lat plane, in either direction, closed or not, and may run past ±180.
    Rings of fewer than three vertices and null rings hold nothing. Positions off the globe lie in no region.
    """
    points = points.where(on_globe("lon", "lat") & F.col("pid").isNotNull()).select("pid", F.col("lon").cast("double"), F.col("lat").cast("double"))
    ps, n = _sample(points, sample)
    splits = Splits(np.stack([_west(ps[:, 0]), ps[:, 1]], axis=1) if len(ps) else np.zeros((0, 2)), min(4096, -(-n // cell_rows)))
    salts = _shares(np.array(splits.share), n, cell_rows)
    rk, pk = regions.schema["rid"].dataType.simpleString(), points.schema["pid"].dataType.simpleString()

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rings, rid = b.column("ring"), b.column("rid")
            for k in range(b.num_rows):
                if not (rid[k].is_valid and rings[k].is_valid):
                    continue
                vertices = rings[k].values
                e = ring_edges(*(vertices.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")))
                if not len(e):
                    continue
                low, high = e[:, [0, 2]].min(), e[:, [0, 2]].max()
                # The ring as seen from -180 <= lon < 180: every turn of the globe that reaches into it.
                for turn in range(int(np.floor((low + 180) / 360)), int(np.floor((high + 180) / 360)) + 1):
                    for cell, own in descend(splits, e - np.array([360.0 * turn, 0, 360.0 * turn, 0])):
                        times = int(salts[cell])
                        flat = pa.array(np.tile(own.ravel(), times))
                        edges = pa.ListArray.from_arrays(pa.array(np.arange(times + 1) * own.size, pa.int32()), flat)
                        yield pa.RecordBatch.from_arrays([rid.take(pa.array([k] * times)), edges, pa.array([cell] * times, pa.int64()), pa.array(np.arange(times)), pa.array([0] * times, pa.int64())], ["rid", "edges", *TASK])

    halo = regions.select("rid", "ring").mapInArrow(copies, f"rid {rk}, edges array<double>, cell long, salt long, part long")

    def build(t: pa.Table) -> tuple:
        lists = t["edges"].combine_chunks()
        e = lists.flatten().to_numpy().reshape(-1, 4)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) // 4)
        return e, owner, t["rid"].combine_chunks()

    def search(found: tuple, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e, owner, rid = found
        number = rid.dictionary_encode().indices.to_numpy()
        lon, lat, pid = _west(b.column("lon").to_numpy()), b.column("lat").to_numpy(), b.column("pid")
        size = max(1, CHUNK // max(len(rid), 1))
        for low in range(0, len(lon), size):
            p, o = sweep(lon[low : low + size], lat[low : low + size], e[:, 0], e[:, 1], e[:, 2], e[:, 3], owner)
            # A ring that circles the globe comes once per turn, each turn a polygon of its own.
            _, one = np.unique(np.stack([p, number[o]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pid.take(pa.array(low + p[one])), rid.take(pa.array(o[one]))], ["pid", "rid"])

    return _meet(_spread(points, splits, True, salts, np.ones(splits.cells, int)), halo, build, search, f"pid {pk}, rid {rk}")


RADIUS_KM = 20.0


def _grid(spark, d: str) -> DataFrame:
    # A point's rows share its coordinates; repeats differ in nothing that matters here.
    return table(spark, d, "grid").select(F.col("point_id").alias("pid"), "lon", "lat").distinct()


def p2_found(spark, d: str) -> DataFrame:
    """The stations within 20 km of each grid point and the zones around it."""
    points = _grid(spark, d)
    gauges = table(spark, d, "gauges").select(F.col("station").alias("rid"), "lon", "lat")
    zones = table(spark, d, "zones").select(F.col("zone_id").alias("rid"), "ring")
    near = near_points(points, gauges, RADIUS_KM).select(F.col("pid").alias("point_id"), F.lit("station").alias("ref_kind"), F.col("rid").alias("ref_id"))
    inside = in_regions(points, zones).select(F.col("pid").alias("point_id"), F.lit("zone").alias("ref_kind"), F.col("rid").alias("ref_id"))
    return near.unionByName(inside)


QUERIES = {"p2_found": p2_found}
_GLOBE = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 360"
SQL = {
    "p2_found": f"""WITH p AS (SELECT DISTINCT point_id, lon, lat FROM grid WHERE point_id IS NOT NULL AND {_GLOBE}),
e AS (SELECT zone_id, r[i].lon AS x1, r[i].lat AS y1, r[i % len(r) + 1].lon AS x2, r[i % len(r) + 1].lat AS y2 FROM (SELECT zone_id, ring AS r, unnest(range(1, len(ring) + 1)) AS i FROM zones)),
q AS (SELECT p.*, lon + 360 * unnest([-2, -1, 0, 1, 2]) AS x FROM p),
b AS (SELECT zone_id, min(x1) AS lo, max(x1) AS hi, min(y1) AS south, max(y1) AS north FROM e GROUP BY 1),
z AS (SELECT DISTINCT point_id, zone_id FROM (SELECT q.point_id, b.zone_id, q.x FROM q JOIN b ON q.x BETWEEN lo AND hi AND q.lat BETWEEN south AND north JOIN e ON e.zone_id = b.zone_id
  AND (e.x1 > q.x) <> (e.x2 > q.x) AND q.lat < (e.y2 - e.y1) * (q.x - e.x1) / (e.x2 - e.x1) + e.y1 GROUP BY ALL HAVING count(*) % 2 = 1))
SELECT p.point_id, 'station' AS ref_kind, g.station AS ref_id FROM p JOIN gauges g ON g.{_GLOBE.replace('AND lon', 'AND g.lon')} AND abs(p.lat - g.lat) < 0.2
  WHERE 2 * {EARTH_KM} * asin(sqrt(least(1, pow(sin(radians(p.lat - g.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(p.lon - g.lon) / 2), 2)))) <= {RADIUS_KM}
UNION ALL SELECT point_id, 'zone', zone_id FROM z"""
}
