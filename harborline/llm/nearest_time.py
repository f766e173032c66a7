"""Pairing records with the nearest record in time of the same entity (problem 1), by tick expansion.

The time axis is cut into ticks as wide as the tolerance. Every right record is exploded to each tick it can reach; per
entity and tick only what can be nearest to some instant of the tick is kept: the last record before it, the first after
it, and the records inside it (one per instant). The left records are then equi-joined on entity and tick, so no
non-equi join is needed and a hot entity is spread over its ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import iso_instant, micros, table


def expand_ticks(right: DataFrame, tol_us: int) -> DataFrame:
    """right(entity, us, id) -> (entity, tick, us, id), reduced to the possible nearest of each tick.

    Rows with a null in any of the three columns are left out. Of rows at the same instant the smallest id stays.
    """
    tick = F.floor(F.col("us") / tol_us).cast("long")
    near = right.dropna(subset=["entity", "us", "id"]).select("entity", "us", "id", tick.alias("own"))
    # Tolerance and tick are equally wide: a record reaches its own tick and the two beside it.
    reach = near.select("entity", "us", "id", "own", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)).alias("tick"))
    inside = F.when(F.col("tick") == F.col("own"), F.col("us"))
    before = F.when(F.col("tick") > F.col("own"), F.struct("us", (-F.col("id")).alias("neg")))
    after = F.when(F.col("tick") < F.col("own"), F.struct("us", "id"))
    kept = reach.groupBy("entity", "tick", inside.alias("at")).agg(F.max(before).alias("b"), F.min(after).alias("a"), F.min(F.when(inside.isNotNull(), F.col("id"))).alias("i"))
    each = F.array_compact(
        F.array(
            F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("us"), F.col("i").alias("id"))),
            F.when(F.col("b").isNotNull(), F.struct(F.col("b.us").alias("us"), (-F.col("b.neg")).alias("id"))),
            F.when(F.col("a").isNotNull(), F.struct(F.col("a.us").alias("us"), F.col("a.id").alias("id"))),
        )
    )
    return kept.select("entity", "tick", F.inline(each))


def nearest_time(left: DataFrame, right: DataFrame, tol_us: int) -> DataFrame:
    """left(entity, us, lid), right(entity, us, id) -> (lid, id, gap_us): the nearest right record at most `tol_us` away.

    Ties: of two records equally far, the earlier; of records at the same instant, the smallest id. A left row without
    a partner has no row; repeated left rows (same lid) give one row. Null entities, times or ids match nothing.
    """
    ticks = expand_ticks(right, tol_us).select(F.col("entity").alias("e"), F.col("tick").alias("k"), F.col("us").alias("rus"), "id")
    asked = left.dropna(subset=["entity", "us", "lid"]).select("entity", "us", "lid", F.floor(F.col("us") / tol_us).cast("long").alias("tick"))
    gap = F.abs(F.col("us") - F.col("rus"))
    met = asked.join(ticks, (F.col("entity") == F.col("e")) & (F.col("tick") == F.col("k"))).where(gap <= tol_us)
    best = met.groupBy("lid").agg(F.min(F.struct(gap.alias("gap_us"), F.col("rus"), F.col("id"))).alias("m"))
    return best.select("lid", F.col("m.id").alias("id"), F.col("m.gap_us").alias("gap_us"))


TOLERANCE_US = 600_000_000


def _sides(spark, d: str) -> tuple[DataFrame, DataFrame]:
    ledger = table(spark, d, "ledger").where((F.col("origin") == "local") & F.col("realized_level").isNull())
    left = ledger.select(F.col("station").alias("entity"), iso_instant("time").alias("us"), F.col("entry_id").alias("lid"))
    obs = table(spark, d, "obs").where(F.col("height").isNotNull() & ~F.isnan("height"))
    return left, obs.select(F.col("station").alias("entity"), micros(F.col("t")).alias("us"), F.col("obs_id").alias("id"))


def p1_found(spark, d: str) -> DataFrame:
    """The nearest reading of each open local ledger entry within ten minutes."""
    return nearest_time(*_sides(spark, d), TOLERANCE_US).select(F.col("lid").alias("entry_id"), F.col("id").alias("obs_id"))


def p1_gaps(spark, d: str) -> DataFrame:
    """How far the nearest readings lie: entries and mean gap by whole minute."""
    got = nearest_time(*_sides(spark, d), TOLERANCE_US)
    return got.groupBy(F.floor(F.col("gap_us") / 60_000_000).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("entries"), F.sum("gap_us").alias("gap_us"))


QUERIES = {"p1_found": p1_found, "p1_gaps": p1_gaps}

_BEST = """WITH l AS (SELECT entry_id, station, epoch_us(CAST(time AS TIMESTAMPTZ)) AS us FROM ledger WHERE origin = 'local' AND realized_level IS NULL),
o AS (SELECT station, epoch_us(t) AS us, min(obs_id) AS obs_id FROM obs WHERE height IS NOT NULL AND NOT isnan(height) GROUP BY ALL),
c AS (SELECT l.entry_id, l.us AS lus, o.us, o.obs_id FROM l ASOF JOIN o ON l.station = o.station AND l.us >= o.us
  UNION ALL SELECT l.entry_id, l.us, o.us, o.obs_id FROM l ASOF JOIN o ON l.station = o.station AND l.us <= o.us),
b AS (SELECT entry_id, abs(us - lus) AS gap_us, obs_id, row_number() OVER (PARTITION BY entry_id ORDER BY abs(us - lus), us, obs_id) AS rn FROM c WHERE abs(us - lus) <= 600000000)
"""
SQL = {
    "p1_found": _BEST + "SELECT entry_id, obs_id FROM b WHERE rn = 1",
    "p1_gaps": _BEST + "SELECT gap_us // 60000000 AS minute, count(*) AS entries, CAST(sum(gap_us) AS BIGINT) AS gap_us FROM b WHERE rn = 1 GROUP BY 1",
}
