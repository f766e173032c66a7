"""The general problems' operators against brute force and on the edge cases their docstrings define."""

import math
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harborline.operators import bad_rows, blocks, near, regular_grid, spikes, time_texts

GRID = "series long, t timestamp, v double, step int, extra string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def at(s):
    return datetime.fromtimestamp(s, timezone.utc)


# -- blocks -------------------------------------------------------------------


@pytest.mark.parametrize("size", [7, 10_000])
def test_blocks_keep_every_row_once_and_copy_halos(spark, size):
    data = [(k % 3 if k % 3 else None, int(t)) for k, t in enumerate(random.Random(1).sample(range(10**6), 60))]
    df = spark.createDataFrame(data, "k long, us long")
    from pyspark.sql import functions as F

    cut = blocks.ordered_blocks(df, "k", ["us"], F.floor(F.col("us") / 50_000), 2, size).collect()
    assert sorted((str(r.k), r.us) for r in cut if r._core) == sorted((str(k), t) for k, t in data)
    for key in {r.k for r in cut}:
        order = sorted(r.us for r in cut if r.k == key and r._core)
        for b in {r._blk for r in cut if r.k == key}:
            mine = sorted(order.index(r.us) for r in cut if r.k == key and r._blk == b)
            core = sorted(order.index(r.us) for r in cut if r.k == key and r._blk == b and r._core)
            assert mine == list(range(max(0, core[0] - 2), min(len(order), core[-1] + 3)))


# -- regular grid ---------------------------------------------------------------


def slots_by_hand(data):
    out = set()
    for s in {r[0] for r in data if r[0] is not None}:
        have = {int(r[1].timestamp()) // r[3] for r in data if r[0] == s and r[1] is not None and r[2] is not None and not math.isnan(r[2])}
        step = next(r[3] for r in data if r[0] == s)
        out |= {(s, k * step) for k in range(min(have, default=0), max(have, default=0)) if k not in have}
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_uncovered_slots_match_brute_force(spark, block):
    rnd = random.Random(5)
    data = [(s, at(1_700_000_000 + rnd.randrange(200_000) + rnd.random()), rnd.choice([1.0, 2.5, None, float("nan")]), 600 * (s + 1), "x") for s in range(4) for _ in range(30)]
    data += data[:5] + [(None, at(0), 1.0, 600, ""), (9, None, 1.0, 600, ""), (8, at(5), None, 600, "")]
    df = spark.createDataFrame(data, GRID)
    pairs = regular_grid.increments(regular_grid.readings(df, "series", "t", "v", "step"), block_rows=block)
    got = [(r.series, r.slot_us // 10**6) for r in regular_grid.uncovered(pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == slots_by_hand(data)


def test_counter_resets_and_shares(spark):
    data = [(1, at(0), 10.0, 10, ""), (1, at(25), 35.0, 10, ""), (1, at(31), 5.0, 10, "")]
    pairs = regular_grid.increments(regular_grid.readings(spark.createDataFrame(data, GRID), "series", "t", "v", "step"), counter=True)
    got = {r.slot_us // 10**6: (round(r.amount, 6), r.status, r.resets) for r in regular_grid.regular_series(pairs).collect()}
    # 25 over 25 s: 10, 10, 5; then a reset to 5 over 6 s: 5/6 of it before second 30.
    assert got == {0: (10.0, "observed", 0), 10: (10.0, "uncovered", 0), 20: (round(5 + 5 * 5 / 6, 6), "observed", 1), 30: (round(5 / 6, 6), "observed", 0)}
    levels = {r.slot_us // 10**6: r.level for r in regular_grid.fill_levels(pairs).collect()}
    assert levels == {10: 20.0}
    assert regular_grid.increments(regular_grid.readings(spark.createDataFrame([], GRID), "series", "t", "v", "step")).count() == 0


def test_steps_of_a_long_gap_come_in_chunks(spark):
    from pyspark.sql import functions as F

    from harborline.common import explode_steps

    df = spark.createDataFrame([(1, 0, 1000), (2, 7, 7), (3, 9, 8), (4, None, 3)], "k int, a long, b long")
    got = explode_steps(df, F.col("a"), F.col("b"), F.lit(7), "x", chunk=10).select("k", "x").collect()
    assert sorted(map(tuple, got)) == [(1, x) for x in range(0, 1001, 7)] + [(2, 7)]


# -- time texts -------------------------------------------------------------------


def us(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-07-01T12:00:00Z", None, None, us(2024, 7, 1, 12)),
        ("2024-07-01 12:00", "Europe/Paris", "dmy", us(2024, 7, 1, 10)),
        ("2024-07-01 12:00", None, None, None),
        ("2024-07-01T12:00:00.123456789+02:00", "UTC", "dmy", us(2024, 7, 1, 10) + 123456),
        ("03/04/2024 1:05:06 PM", "UTC", "mdy", us(2024, 3, 4, 13, 5, 6)),
        ("03/04/2024 1:05:06 p.m.", "UTC", "dmy", us(2024, 4, 3, 13, 5, 6)),
        ("03/04/2024 12:30 AM", "UTC", "dmy", us(2024, 4, 3, 0, 30)),
        ("03/04/2024 13:30 AM", "UTC", "dmy", None),
        ("31.12.2023 24:00", "UTC", "mdy", us(2024, 1, 1)),
        ("31.12.2023 24:01", "UTC", "mdy", None),
        ("2023-02-29 10:00", "UTC", "dmy", None),
        ("2024-060T10:00Z", "UTC", "dmy", us(2024, 2, 29, 10)),
        ("2023-366T10:00Z", "UTC", "dmy", None),
        ("20240229T101112", "Asia/Tokyo", "dmy", us(2024, 2, 29, 1, 11, 12)),
        ("20240229101112", "UTC", "dmy", us(2024, 2, 29, 10, 11, 12)),
        ("1700000000", None, None, 1_700_000_000_000_000),
        ("1700000000.250", None, None, 1_700_000_000_250_000),
        ("1700000000123", None, None, 1_700_000_000_123_000),
        ("1700000000123456", None, None, 1_700_000_000_123_456),
        ("2024-03-31 02:30", "Europe/Paris", "dmy", None),  # skipped
        ("2024-10-27 02:30", "Europe/Paris", "dmy", None),  # repeated
        ("2024-10-27 02:30 CET", "Europe/Paris", "dmy", us(2024, 10, 27, 1, 30)),
        ("2024-10-27 02:30 CEST", "Europe/Paris", "dmy", us(2024, 10, 27, 0, 30)),
        ("2024-10-27 02:30 PST", "Europe/Paris", "dmy", None),
        ("2024-01-01 10:00 IST", "Asia/Kolkata", "dmy", us(2024, 1, 1, 4, 30)),
        ("2024-01-01 10:00 America/New_York", "Asia/Tokyo", "dmy", us(2024, 1, 1, 15)),
        ("2024-01-01T10:00[Europe/London]", "Asia/Tokyo", "dmy", us(2024, 1, 1, 10)),
        ("2024-01-01 10:00 (GMT-03:30)", "Asia/Tokyo", "dmy", us(2024, 1, 1, 13, 30)),
        ("2024-01-01T10:00+18:00", "UTC", "dmy", us(2023, 12, 31, 16)),
        ("2024-01-01T10:00+18:01", "UTC", "dmy", None),
        ("2024-01-01T10:00−05:00", "UTC", "dmy", us(2024, 1, 1, 15)),
        ("Mon, 01 Jan 2024 10:00:00 +0000", "UTC", "dmy", us(2024, 1, 1, 10)),
        ("Tue, 01 Jan 2024 10:00:00 +0000", "UTC", "dmy", None),
        ("January 1, 2024 10:00:30", "UTC", "dmy", us(2024, 1, 1, 10, 0, 30)),
        ("1 Jxn 2024 10:00", "UTC", "dmy", None),
        ("  2024-01-01 10:00\u00a0", "UTC", "dmy", us(2024, 1, 1, 10)),
        ("n/a", "UTC", "dmy", None), ("", "UTC", "dmy", None), (None, "UTC", "dmy", None), ("9" * 5000, "UTC", "dmy", None), ("2024-01-01T", "UTC", "dmy", None),
        ("2024-01-01 10:00", "No/Where", "dmy", None),
    ],
)
def test_time_texts(text, zone, order, want):
    assert time_texts.parse_time(text, zone, order) == want


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(2001, 1, 1), datetime(2030, 1, 1)), st.sampled_from(["Europe/Paris", "Australia/Lord_Howe", "America/St_Johns", "Pacific/Chatham"]))
def test_wall_clock_is_read_only_if_it_is_one_instant(wall, name):
    wall, tz = wall.replace(microsecond=0), ZoneInfo(name)
    instants = {u for fold in (0, 1) if (u := wall.replace(tzinfo=tz, fold=fold).astimezone(timezone.utc)).astimezone(tz).replace(tzinfo=None) == wall}
    want = int(next(iter(instants)).timestamp()) * 10**6 if len(instants) == 1 else None
    assert time_texts.parse_time(wall.strftime("%Y-%m-%d %H:%M:%S"), name, "dmy") == want


def test_dictionary_grows_and_hot_texts_keep_their_rows(spark, tmp_path):
    data = [(k, "2024-01-01 10:00" if k % 2 else None if k % 6 == 0 else f"2024-01-01 10:{k % 60:02d}", "UTC" if k % 5 else None, "dmy", "x") for k in range(120)]
    df = spark.createDataFrame(data, "row_id long, text string, zone string, date_order string, utc_us string")
    store = f"file://{tmp_path}/dict"
    want = [(r[0], time_texts.parse_time(r[1], r[2], r[3])) for r in data]
    for hot in (10, 10**6):
        got = time_texts.normalise_times(df.limit(60) if hot == 10 else df, store, hot).select("row_id", "utc_us")
        assert rows(got) == sorted((w for w in want if hot != 10 or w[0] < 60), key=str)
    assert rows(time_texts.normalise_times(df, None, 10).select("row_id", "utc_us")) == sorted(want, key=str)
    n = spark.read.parquet(store).count()
    time_texts.time_dictionary(df, store)
    assert spark.read.parquet(store).count() == n
    assert time_texts.normalise_times(df.limit(0)).count() == 0


# -- rows that fail to parse ----------------------------------------------------------

SCHEMA = bad_rows.gauge_schema(["aa-1", "aa-10", "b.2"])


def reason_by_hand(record):
    """A character-by-character reading of the rules."""
    if record is None:
        return "width"
    fields, quoted, k = [], [], 0
    while True:
        if record[k : k + 1] == '"':
            k += 1
            text = ""
            while True:
                j = record.find('"', k)
                if j < 0:
                    return "quote"
                text += record[k:j]
                if record[j + 1 : j + 2] == '"':
                    text += '"'
                    k = j + 2
                    continue
                k = j + 1
                break
            if k < len(record) and record[k] != ",":
                return "quote"
            fields.append(text)
            quoted.append(True)
        else:
            j = record.find(",", k)
            j = len(record) if j < 0 else j
            if '"' in record[k:j]:
                return "quote"
            fields.append(record[k:j].strip(" "))
            quoted.append(False)
            k = j
        if k >= len(record):
            break
        k += 1
    if len(fields) != 5:
        return "width"
    if fields[0] not in ("aa-1", "aa-10", "b.2"):
        return "station"
    import re

    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d)(:\d\d(\.\d{1,6})?)?(Z|[+-](\d\d):(\d\d))?", fields[1], re.ASCII)
    try:
        datetime.strptime(m[1] + " " + m[2] + (m[3] or ":00")[:3], "%Y-%m-%d %H:%M:%S")
        if m[6] and (int(m[7]) > 59 or int(m[6]) * 60 + int(m[7]) > 14 * 60) or (m[3] or "")[:3] == ":60" or m[1][:4] == "0000":
            return "time"
    except (TypeError, ValueError):
        return "time"
    if fields[2] and (not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", fields[2], re.ASCII) or not -20 <= float(fields[2]) <= 20):
        return "height"
    return None


GOOD = ["aa-1", "2024-02-29T10:00", "1.5", "", "note"]
PARTS = st.sampled_from(["aa-1", " aa-10 ", '"b.2"', "bX2", "2024-02-29T10:00:59.5+14:00", "2023-02-29 10:00", "2024-01-01T24:00", '"2024-01-01T10:00Z"', "1e1", "2.1e1", ".5", "1.", "", '""', "-20", "20.0001", "nan", '"a ""b"", c\nd"', '"open', 'x"y', '"a"b', "\n", " "])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=7))
def test_reasons_match_a_plain_reading(parts):
    for record in (",".join(parts), ",".join(GOOD[:2] + parts[:3])):
        assert bad_rows.Diagnosis(SCHEMA).reason(record) == reason_by_hand(record)


def test_bad_rows_on_spark_agree_and_valid_rows_load(spark):
    rnd = random.Random(2)
    pool = ["aa-1", " aa-10 ", '"b.2"', "zz", "2024-02-29T10:00", "2023-02-29 10:00", "1e1", "21", "", '""', '"a ""b"", c\nd"', '"open', 'x"y', "note", "x" * 50_000, '"' + '""' * 5000 + '"']
    records = [None, "", ",".join(GOOD), ",".join(GOOD)] + [",".join(GOOD[:k] + [rnd.choice(pool) for _ in range(5 - k)]) for k in (0, 1, 2, 3, 4) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(records)), "row_id long, line string")
    want = {k: reason_by_hand(r) for k, r in enumerate(records)}
    got = {r.id: r.reason for r in bad_rows.faulty_rows(df, "line", "row_id", SCHEMA).collect()}
    assert got == {k: v for k, v in want.items() if v}
    valid = {r.row_id: r for r in bad_rows.valid_rows(df, "line", ["row_id"], SCHEMA).collect()}
    assert set(valid) == {k for k, v in want.items() if v is None}
    assert tuple(valid[2])[1:] == tuple(GOOD)
    long = next(k for k in valid if '""' * 5000 in records[k])
    assert '"' * 5000 in tuple(valid[long])
    assert bad_rows.faulty_rows(df.limit(0), "line", "row_id", SCHEMA).count() == 0
    # A register too long for a pattern is joined, with the same result.
    register = spark.createDataFrame([("aa-1",), ("aa-10",), ("b.2",), ("b.2",), (None,)], "station string")
    rules = bad_rows.gauge_rules(register, names=2)
    assert rules[1] is not None and bad_rows.gauge_rules(register)[1] is None
    joined = bad_rows.faulty_rows(df, "line", "row_id", *rules).collect()
    assert {r.id: r.reason for r in joined} == got and len(joined) == len(got)
    assert rows(bad_rows.valid_rows(df, "line", ["row_id"], *rules).select("row_id", "station", "note")) == rows(bad_rows.valid_rows(df, "line", ["row_id"], SCHEMA).select("row_id", "station", "note"))


# -- points near points and regions ------------------------------------------------------


def test_near_points_and_regions_match_brute_force(spark):
    rnd = np.random.default_rng(3)
    lon = np.concatenate([rnd.uniform(-180, 360, 300), 179.95 + rnd.normal(0, 0.1, 100), np.full(80, 10.0)])
    lat = np.concatenate([rnd.uniform(-90, 90, 300), rnd.normal(50, 0.1, 100), np.full(80, 89.99)])
    points = [(k, float(a), float(b), "e") for k, (a, b) in enumerate(zip(lon, lat))] + [(900, None, 1.0, ""), (901, 1.0, float("nan"), ""), (902, 400.0, 1.0, ""), (None, 1.0, 1.0, "")]
    refs = [(f"r{k}", float(lon[k * 3] + rnd.normal(0, 0.1)) % 360, float(np.clip(lat[k * 3] + rnd.normal(0, 0.1), -90, 90))) for k in range(150)] + [("p", 100.0, 90.0), ("q", None, 2.0)]
    df = spark.createDataFrame(points, "pid long, lon double, lat double, cell string")
    ref = spark.createDataFrame(refs, "rid string, lon double, lat double")
    ok = [p for p in points if p[0] is not None and p[1] is not None and p[1] <= 360 and not math.isnan(p[2])]
    want = {(p[0], r[0]) for p in ok for r in refs if r[1] is not None and near.great_circle_km(np.float64(p[1]), np.float64(p[2]), np.float64(r[1]), np.float64(r[2])) <= 25}
    got = near.near_points(df, ref, 25.0, sample=50, cell_rows=20).collect()
    assert len(got) == len(want) and {(r.pid, r.rid) for r in got} == want
    twice = spark.createDataFrame([*refs, ("r0b", *refs[0][1:]), ("r0c", *refs[0][1:])], "rid string, lon double, lat double")
    got = near.near_points(df, twice, 25.0, sample=50, cell_rows=20).collect()
    assert {(r.pid, r.rid) for r in got} == want | {(p, x) for p, r in want if r == "r0" for x in ("r0b", "r0c")} and len(got) == len({(r.pid, r.rid) for r in got})
    rings = [("tri", [(-1.0, 40.0), (30.0, 40.0), (10.0, 90.0)]), ("seam", [(170.0, 40.0), (190.0, 40.0), (190.0, 60.0), (170.0, 60.0), (170.0, 40.0)]), ("far", [(350.0, -80.0), (530.0, -80.0), (530.0, 10.0), (350.0, 10.0)]), ("thin", [(0.0, 0.0), (1.0, 1.0)]), ("none", None)]
    zones = spark.createDataFrame([(n, [{"lon": a, "lat": b} for a, b in r] if r else None) for n, r in rings], "rid string, ring array<struct<lon:double,lat:double>>")

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (x1 > x) != (x2 > x) and y < (y2 - y1) * (x - x1) / (x2 - x1) + y1
        return odd

    want = {(p[0], n) for p in ok for n, r in rings if r and len(r) > 2 and any(inside(p[1] + 360 * k, p[2], r) for k in (-2, -1, 0, 1, 2))}
    got = near.in_regions(df, zones, sample=50, cell_rows=20).collect()
    assert len(got) == len(want) and {(r.pid, r.rid) for r in got} == want
    assert near.near_points(df.limit(0), ref, 25.0).count() == 0 and near.in_regions(df, zones.limit(0)).count() == 0


def test_a_ring_of_many_vertices_over_all_cells():
    rnd = np.random.default_rng(1)
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    reach = 60 + 8 * np.sin(37 * turn) + 0.5 * np.sin(4001 * turn)
    e = near.ring_edges(1.8 * reach * np.cos(turn), reach * np.sin(turn))
    lon, lat = rnd.uniform(-130, 130, 3000), rnd.uniform(-75, 75, 3000)
    splits = near.Splits(np.stack([lon, lat], axis=1), 256)
    row, cell = splits.place(np.stack([lon, lat], axis=1))
    flip = np.where((e[:, 0] > e[:, 2])[:, None], e[:, [2, 3, 0, 1]], e)
    flip = flip[flip[:, 0] < flip[:, 2]]
    want, _ = near.sweep(lon, lat, *flip.T, np.zeros(len(flip), int))
    parts = dict(near.descend(splits, e))
    got = [i for c, own in parts.items() for i in row[cell == c][near.sweep(lon[row[cell == c]], lat[row[cell == c]], *own.T, np.zeros(len(own), int))[0]].tolist()]
    assert sorted(got) == sorted(want.tolist()) and 500 < len(want) < 2900
    # Only what crosses a cell comes whole: all copies together stay near the ring itself.
    assert sum(len(x) for x in parts.values()) < 1.6 * len(e) and max(len(x) for x in parts.values()) < 0.1 * len(e)


def test_crowded_references_are_parted(spark):
    rnd = np.random.default_rng(2)
    at = lambda n, c: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rnd.normal(0, 0.01, (n, 2)))], f"{c} long, lon double, lat double")
    points, refs = at(90, "pid"), at(400, "rid")
    got = near.near_points(points, refs, 1.0, sample=30, cell_rows=25).select("pid", "rid").collect()
    p, r = points.toPandas(), refs.toPandas()
    km = near.great_circle_km(p.lon.to_numpy()[:, None], p.lat.to_numpy()[:, None], r.lon.to_numpy(), r.lat.to_numpy())
    assert sorted(map(tuple, got)) == sorted(zip(*(x.tolist() for x in np.nonzero(km <= 1.0))))


# -- spikes --------------------------------------------------------------------------------

OBS = "oid long, upload long, station string, t timestamp, h double, note string"


def tide(t):
    return 1.2 * math.cos(2 * math.pi * t / 44_714) + 0.3 * math.cos(2 * math.pi * t / 86_164)


def make_obs(seed=0, uploads=6, n=300):
    rnd = random.Random(seed)
    out, bad = [], set()
    oid = 0
    for u in range(uploads):
        t = 1_700_000_000 + u * 10**6
        spikes_at = set(rnd.sample(range(20, n - 20, 12), 8))
        stuck = rnd.randrange(100, 150)
        shift = 0.0
        held = 0.0
        for k in range(n):
            t += rnd.uniform(250, 420)
            oid += 1
            h = tide(t) + rnd.gauss(0, 0.015)
            shift = 0.8 if k >= n - 12 else 0.0  # a lasting shift is no spike
            h += shift
            if any(k - j in spikes_at for j in range(1 + u % 3)):
                h += 0.4 * (1 if u % 2 else -1) * rnd.uniform(1, 4)
                bad.add(oid)
            if stuck <= k < stuck + 9:
                held = held if k > stuck else round(h, 3)
                h = held
                bad.add(oid)
            out.append((oid, u, f"s{u % 2}", at(t), round(h, 3), "n"))
    return out, bad


@pytest.mark.parametrize("block", [120, 10**6])
def test_spikes_runs_and_bounds(spark, block):
    data, bad = make_obs()
    extra = [(10_001, 0, "s0", data[50][3] + timedelta(seconds=1), 99.0, ""), (10_002, 0, "s0", data[60][3], None, ""), (10_003, 0, "s0", data[61][3], float("nan"), ""), (10_004, None, "s0", data[61][3], -30.0, ""), (10_005, 1, None, None, float("inf"), ""), (10_006, None, None, None, 1.0, "")]
    repeat = [(20_000 + r[0], *r[1:]) for r in data if r[0] in bad or r[0] % 9 == 0]
    df = spark.createDataFrame(data + extra + repeat, OBS)
    got = {r.id for r in spikes.implausible(df, "upload", "t", "h", "station", "oid", block).collect()}
    want = bad | {10_001, 10_004, 10_005} | {20_000 + r for r in bad}
    assert len(got - want) <= 0.02 * len(want) and len(want - got) <= 0.03 * len(want)
    assert spikes.implausible(df.limit(0), "upload", "t", "h", "station", "oid").count() == 0


def search(t, h, seg=None, sigma=0.02):
    n = len(h)
    return np.flatnonzero(spikes.find_spikes(np.asarray(t, float), np.asarray(h, float), np.zeros(n, int) if seg is None else seg, np.full(n, sigma), np.full((3, n), 0.02))).tolist()


def coarse_series(seed, n=4000):
    """Half-hourly readings of a large tide at irregular times, with shifts and spikes."""
    rnd = np.random.default_rng(seed)
    t = np.cumsum(rnd.uniform(900, 2700, n))
    h = 2 * np.cos(2 * np.pi * t / 44_714) + 0.5 * np.cos(2 * np.pi * t / 86_164) + rnd.normal(0, 0.01, n)
    for k in range(60, n, 200):
        h[k:] += rnd.choice([-0.3, 0.3])
    spots = np.arange(150, n, 200)
    h[spots] += rnd.choice([-1, 1], len(spots)) * rnd.uniform(1, 3, len(spots))
    return t, h, spots.tolist()


def test_ellipsoids_decide(monkeypatch):
    t, h, spots = coarse_series(4)
    got = search(t, h, sigma=0.01)
    assert len(set(got) & set(spots)) >= 0.9 * len(spots) and len(set(got) - set(spots)) <= 0.2 * len(spots)
    monkeypatch.setattr(spikes.Ellipsoids, "outside", lambda self, points: np.ones(points.shape[1], bool))
    free = search(t, h, sigma=0.01)
    assert set(free) != set(got) and len(set(free) - set(spots)) > len(set(got) - set(spots))
    monkeypatch.setattr(spikes.Ellipsoids, "outside", lambda self, points: np.zeros(points.shape[1], bool))
    assert search(t, h, sigma=0.01) == []


def test_ellipsoids_turn_with_the_correlation_and_hold_the_universal_share():
    rnd = np.random.default_rng(0)
    n = 5000
    u = rnd.normal(0, 1, n)
    points = np.stack([u, rnd.normal(0, 2, n), -1.5 * u + rnd.normal(0, 0.5, n)])
    shape = spikes.Ellipsoids(points, np.zeros(n, int), np.ones((3, n)))
    assert shape.scale[:, 0] == pytest.approx([1, 2, math.sqrt(2.5)], rel=0.1) and shape.rho[0] == pytest.approx(-1.5 / math.sqrt(2.5), abs=0.05)
    assert shape.outside(points).sum() <= 5
    against = np.array([[2.5], [0.0], [3.5]]).repeat(n, axis=1)  # inside both axes, against the correlation
    assert shape.outside(against).all()


def test_odd_rates(spark):
    rnd = random.Random(1)
    data = [(k, "float" if k % 2 else None, rnd.gauss(0, 0.01) if k % 2 else rnd.gauss(0, 0.2)) for k in range(400)]
    data += [(1000, "float", 0.15), (1001, None, 0.15), (1002, None, float("inf")), (1003, "float", float("nan")), (1004, "float", None), (1005, None, 5.0)]
    df = spark.createDataFrame(data, "i long, kind string, v double")
    assert rows(spikes.odd_rates(df, "v", "kind", "i")) == [(1000,), (1002,), (1005,)]
    assert spikes.odd_rates(df.limit(0), "v", "kind", "i").count() == 0


@pytest.mark.parametrize("tidal", [0.0, 1.2])
def test_close_spikes_chains_shifts_and_gaps(tidal):
    t = np.arange(120) * 600.0
    level = tidal * np.cos(2 * np.pi * t / 44_714) + np.random.default_rng(0).normal(0, 0.01, 120)
    chain = lambda n: ([30 + 2 * k for k in range(n)], [0.3 * 2.5**k for k in range(n)])
    for spots, sizes in (([30, 32], [3, 3]), ([30, 32], [3, -3]), ([30, 32, 34, 36], [5] * 4), ([30, 31, 33], [2, 2, 2]), chain(5), chain(6), chain(9)):
        h = level.copy()
        h[spots] += sizes
        assert search(t, h, sigma=0.01) == spots
    h = level.copy()
    h[30:] += 5.0
    assert search(t, h, sigma=0.01) == []  # a shift
    late, h = t.copy(), level.copy()
    late[32:] += 86_400.0
    h[32:] += 2.0
    h[30] += 2.0
    assert search(late, h, sigma=0.01) == [30]
    stuck = level.copy()
    stuck[40:52] = stuck[40]
    stuck[46:] += 0.0
    assert not set(search(t, stuck, sigma=0.01)) & set(range(40, 52))


def test_small_series_have_no_spikes():
    for n in range(4):
        assert search(np.arange(n) * 600.0, np.array([0.0, 9.0, 0.0])[:n]) == ([1] if n == 3 else [])
    assert search([0, 0, 0, 600], [0, 5, 9, 0]) is not None  # equal times
