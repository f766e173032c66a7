"""Quality, corrections, world and federation operators on made-up data, against numpy or the truth that made them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborline.common import release, shared_dir, written_dir
from harborline.functions import astro
from harborline.operators import corrections, lineage, quality, world
from harborline.plans.steps import with_steps

T0, HOUR = 1_704_067_200_000_000, 3_600_000_000


def test_sliding_median_equals_numpy():
    rnd = np.random.default_rng(0)
    v, seg, half = rnd.normal(size=90), np.repeat([0, 1, 2], [50, 39, 1]), np.repeat([6, 2, 3], [50, 39, 1])
    got = quality.sliding_median(v, seg, half)
    for k in range(90):
        mine = np.flatnonzero(seg == seg[k])
        near = mine[np.abs(mine - k) <= half[k]]
        assert got[k] == np.median(v[near])


@pytest.mark.parametrize("block", [60, 10**6])
def test_battery_finds_spikes_shift_and_drift_and_cleans(spark, block):
    rnd = np.random.default_rng(1)
    n = 240
    flat = rnd.normal(0, 0.01, (5, n))
    flat[0, [50, 100, 150]] += 5.0
    flat[1, 120:] += 0.5
    flat[2] += np.linspace(0, 1.5, n)
    flat[3, :200] = 0.25
    rows = [(k * 1000 + t, k, T0 + t * HOUR, float(flat[k, t])) for k in range(5) for t in range(n)] + [(9000 + t, 9, T0 + t * HOUR, 1.0) for t in range(10)]
    rows.append((9500, 4, T0, 0.0))
    df = spark.createDataFrame(rows, "obs_id long, key long, us long, height double")
    got = {r.key: r for r in quality.battery(df, block).collect()}
    assert got[0].flagged == 3 and got[0].reasons == "" and not got[0].rejected
    assert "datum" in got[1].reasons and got[1].datum_shift == pytest.approx(0.5, abs=0.01)
    assert "drift" in got[2].reasons and got[2].drift == pytest.approx(0.15, abs=0.02)
    assert "flat" in got[3].reasons and got[3].flat > 0.8
    assert got[4].repeated == 1 and "times" in got[4].reasons
    assert got[9].reasons == "few" and got[9].rejected and got[9].flagged is None
    clean = {r.obs_id: r.cleaned for r in quality.cleaned(df, block).collect()}
    assert len(clean) == len(rows) and max(abs(clean[t]) for t in range(n)) < 0.06 and clean[9005] == 1.0
    assert quality.battery(df.limit(0)).count() == 0 and quality.cleaned(df.limit(0)).count() == 0


def test_season_fills_the_circle_and_halves_a_bias(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 6, -2.0)], "station string, bin int, resid double")
    got = corrections.season_table(rows, "station").first()
    filled = np.array([2.0] * 4 + [-2.0] * 6 + [2.0] * 2)  # from the nearest, the one before on ties
    assert np.allclose(got.biases, 0.25 * np.roll(filled, 1) + 0.5 * filled + 0.25 * np.roll(filled, -1)) and got.counts[0] == 2 and sum(got.counts) == 3
    rnd = np.random.default_rng(0)
    t = np.arange(2 * 365 * 4)
    bias = 0.15 * np.sin(2 * np.pi * t / (365.25 * 4))
    df = spark.createDataFrame(pd.DataFrame({"station": "a", "obs_id": t, "us": T0 + t * 6 * HOUR, "resid": bias + rnd.normal(0, 0.02, len(t)), "sigma": 0.02}))
    got = corrections.learn_season(df, "station", "obs_id").first()
    assert got.n == len(t) and got.n_test == 730 and got.rmse_after < 0.5 * got.rmse_before and 0.93 <= got.coverage_after <= 0.97
    assert corrections.learn_season(df.limit(20), "station", "obs_id").count() == 0


def test_river_and_regime(spark):
    rnd = np.random.default_rng(2)
    q = rnd.uniform(0, 5, 500)
    df = spark.createDataFrame(pd.DataFrame({"station": "a", "qa": q, "y": 0.3 * q**0.6 + rnd.normal(0, 0.005, 500)})).unionByName(spark.createDataFrame([("b", 1.0, 1.0), ("b", None, 1.0)], "station string, qa double, y double"))
    got = corrections.river_response(df).collect()
    assert len(got) == 1 and (got[0].alpha, got[0].beta) == (pytest.approx(0.3, abs=0.01), pytest.approx(0.6, abs=0.03)) and got[0].r2 > 0.99
    down = df.withColumn("y", -F.col("y"))
    assert corrections.river_response(down).count() == 0
    rows = spark.createDataFrame([("spring-calm", 1.0, 0.1), ("odd", 1.0, 0.1), (None, 1.0, 0.0)], "regime string, mean double, sigma double")
    got = {r.regime: round(r.upper, 6) for r in corrections.regime_bands(rows, spark.createDataFrame([("spring-calm", 3.0)], "regime string, q double"), F.lit(2.0)).collect()}
    assert got == {"spring-calm": 1.3, "odd": 1.2, None: 1.0}


GAUGES = "station string, lon double, lat double, mean double, n int, region_name string, constituents array<struct<name string, amplitude double, phase double>>"


def test_world_between_stations_and_short_records(spark):
    square = [("A", -1.0, 0.0), ("B", 1.0, 0.0), ("C", 0.0, 1.0), ("D", 0.0, -1.0)]
    g = spark.createDataFrame([(s, x, y, 1 + 0.05 * y, 1000, "r", [("M2", 1.0, 30.0), ("K1", 0.2 + 0.05 * x, 100.0)]) for s, x, y in square] + [("E", None, 0.0, 5.0, 10, "r", [("S2", 9.0, 0.0)])], GAUGES)
    network, names = world.network_table(g)
    assert names == ["M2", "K1"] and network.count() == 4
    at = world.kriged_constants(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, None, 0.0)], "pid long, lon double, lat double"), network, names, 300.0, 0.0)
    got = {r.pid: r for r in at.collect()}
    assert set(got) == {1, 2} and got[1].z0 == pytest.approx(1.0, abs=1e-6) and got[2].z0 == pytest.approx(1.05, abs=1e-9) and got[2].v0 == pytest.approx(0, abs=1e-9)
    assert got[1].x_M2 == pytest.approx(math.cos(math.radians(30)), abs=1e-6) and got[1].v0 > 0
    times = spark.createDataFrame([(1, T0), (2, T0), (9, T0)], "pid long, us long")
    levels = {r.pid: r for r in world.world_levels(times, at, names, 1e-3).collect()}
    assert set(levels) == {1, 2} and levels[1].upper - levels[1].lower > levels[2].upper - levels[2].lower
    rnd = np.random.default_rng(0)
    rows = spark.range(72).selectExpr(f"{T0} + id * {HOUR} AS us")
    basis = with_steps(rows, astro.basis_steps([astro.BY_NAME["M2"], astro.BY_NAME["K1"]])).orderBy("us").toPandas()
    height = 1 + 0.8 * basis["c_M2"] + 0.3 * basis["s_M2"] + 0.2 * basis["c_K1"] + rnd.normal(0, 0.2, 72)
    obs = spark.createDataFrame(pd.DataFrame({"station": "s", "us": basis["us"], "height": height}))
    prior = spark.createDataFrame([("s", n, p, 3, m, 1e-4) for n, p, m in (("M2", "a", 0.8), ("M2", "b", 0.3), ("K1", "a", 0.2), ("K1", "b", 0.0))], "station string, name string, part string, k long, mu double, tau2 double")
    got = {(r.name, r.part): r for r in world.seed_short(obs, prior, ["M2", "K1"]).collect()}
    assert len(got) == 4
    for r in got.values():
        assert 0.5 < r.shrinkage < 1 and abs(r.own - r.pooled) <= abs(r.own - {"M2a": 0.8, "M2b": 0.3, "K1a": 0.2, "K1b": 0.0}[r.name + r.part])
    assert world.seed_short(obs.limit(4), prior, ["M2", "K1"]).count() == 0


def test_a_poisoned_peer_loses_trust(spark):
    rnd = np.random.default_rng(5)
    t = np.arange(24 * 30)
    basis = with_steps(spark.createDataFrame([(int(T0 + x * HOUR),) for x in t], "us long"), astro.basis_steps([astro.BY_NAME["M2"]])).orderBy("us").toPandas()
    height = 0.9 * basis["c_M2"] + rnd.normal(0, 0.02, len(t))
    obs = spark.createDataFrame(pd.DataFrame({"obs_id": t, "station": "a1", "us": basis["us"], "height": height}))
    kind = "station string, peer string, region_name string, z0 double, constituents array<struct<name string, amplitude double, phase double>>, n int"
    good = [(f"a{k}", "good", "r", 0.0, [("M2", 0.9 + 0.001 * k, 0.0)], 100) for k in range(1, 4)]
    same = [(f"c{k}", "copy", "r", 0.0, [("M2", 0.9 + 0.001 * k, 0.0)], 100) for k in range(1, 4)]
    bad = [("b1", "bad", "r", 0.0, [("M2", 2.5, 180.0)], 100)]
    got = {r.peer: r for r in world.peer_trust(spark.createDataFrame(good + same + bad, kind), obs).collect()}
    assert got["bad"].trust == 0.05 and got["bad"].gain < 0 and got["good"].duplicate == 0.5 and got["good"].trust == pytest.approx(0.5) and got["bad"].duplicate == 0


def test_history_counts_across_days(spark):
    from datetime import datetime, timedelta, timezone

    rows = [(k, "a" if k % 2 else None, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=7 * (k // 3))) for k in range(40)] + [(99, "a", None)]
    got = {r.id: r for r in lineage.history(spark.createDataFrame(rows, "i long, name string, at timestamp"), "name", "at", "i").collect()}
    order = sorted((r[2], r[0]) for r in rows if r[1] and r[2])
    assert [got[i].version for _, i in order] == list(range(1, len(order) + 1)) and len(got) == len(order)
    assert [got[i].parent for _, i in order] == [None, *(i for _, i in order[:-1])] and [i for i, r in got.items() if r.latest] == [order[-1][1]]


def test_written_tables_are_released_and_clusters_must_name_a_folder(spark):
    from pathlib import Path
    from types import SimpleNamespace

    path = Path(written_dir(spark).removeprefix("file://"))
    assert path.exists() and shared_dir(spark) in written_dir(spark)
    release(spark)
    assert not path.exists()
    assert Path(written_dir(spark).removeprefix("file://")).exists()
    none = lambda *_: None
    cluster = SimpleNamespace(conf=SimpleNamespace(get=none), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=none)))
    with pytest.raises(ValueError):
        shared_dir(cluster)
