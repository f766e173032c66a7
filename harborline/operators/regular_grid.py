"""Irregular readings onto a regular grid of slots (problem 4).

Consecutive readings of a series are differenced; each increment (or, at a counter's reset, the new count) is spread over
the grid cells its interval overlaps, in proportion to the overlap. A cell that is overlapped but holds no reading is
uncovered. Everything is native: one window per series (hot series are cut into blocks with a halo) and one explode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import explode_steps, micros, small, table
from harborline.operators.blocks import BLOCK_ROWS, ordered_blocks

US = 1_000_000


def readings(df: DataFrame, series: str, time: str, value: str, step: str) -> DataFrame:
    """(series, step_us, us, v) of the usable rows: series, time and step known, value neither null nor NaN, step positive."""
    return df.where(F.col(series).isNotNull() & F.col(time).isNotNull() & (F.col(step) > 0) & F.col(value).isNotNull() & ~F.isnan(value)).select(
        F.col(series).alias("series"), (F.col(step).cast("long") * US).alias("step_us"), micros(F.col(time)).alias("us"), F.col(value).alias("v")
    )


def increments(read: DataFrame, counter: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per pair of consecutive readings of a series: us, next_us, v, increment, reset.

    For a gauge the increment is the difference. For a cumulative counter a falling value is a reset and the increment
    is the new count. Readings at the same instant give pairs of no length, which overlap no further cell.
    """
    cut = ordered_blocks(read, "series", ["us", "v"], F.floor(F.col("us") / (7 * 86_400 * US)), halo=1, block_rows=block_rows)
    w = Window.partitionBy("series", "_blk").orderBy("us", "v")
    pairs = cut.withColumns({"next_us": F.lead("us").over(w), "next_v": F.lead("v").over(w), "_next_core": F.lead("_core").over(w)})
    # A pair belongs to the block that holds its first reading as core.
    pairs = pairs.where(F.col("_core"))
    reset = F.lit(counter) & (F.col("next_v") < F.col("v"))
    return pairs.select(
        "series", "step_us", "us", "v", "next_us", "next_v", F.when(reset, F.col("next_v")).otherwise(F.col("next_v") - F.col("v")).alias("increment"), F.coalesce(reset, F.lit(False)).alias("reset")
    )


def _slot(us: F.Column) -> F.Column:
    return us - F.pmod(us, F.col("step_us"))


def uncovered(pairs: DataFrame) -> DataFrame:
    """(series, slot_us): the cells strictly between the cells of two consecutive readings."""
    first, last = _slot(F.col("us")) + F.col("step_us"), _slot(F.col("next_us")) - F.col("step_us")
    gaps = pairs.where(F.col("next_us").isNotNull()).select("series", "step_us", first.alias("a"), last.alias("b"))
    return explode_steps(gaps, F.col("a"), F.col("b"), F.col("step_us"), "slot_us").select("series", "slot_us")


def regular_series(pairs: DataFrame) -> DataFrame:
    """One row per cell from a series' first reading to its last: amount, readings, resets, status.

    amount: the increments' shares by overlap; status: 'observed' (holds a reading) or 'uncovered'. A series of one
    reading has one observed cell of amount 0.
    """
    end = F.coalesce(F.col("next_us"), F.col("us"))
    cells = explode_steps(pairs, _slot(F.col("us")), _slot(end), F.col("step_us"), "slot_us")
    overlap = F.least(F.col("slot_us") + F.col("step_us"), end) - F.greatest(F.col("slot_us"), F.col("us"))
    here = _slot(F.col("us")) == F.col("slot_us")
    # An interval of no length falls wholly into its cell.
    share = F.when(end > F.col("us"), F.col("increment") * overlap / (end - F.col("us"))).otherwise(F.coalesce(F.col("increment"), F.lit(0.0)))
    return (
        cells.groupBy("series", "slot_us")
        .agg(F.sum(share).alias("amount"), F.count(F.when(here, 1)).alias("readings"), F.count(F.when(here & F.col("reset"), 1)).alias("resets"), F.max("step_us").alias("step_us"))
        .withColumn("status", F.when(F.col("readings") > 0, "observed").otherwise("uncovered"))
    )


def fill_levels(pairs: DataFrame) -> DataFrame:
    """(series, slot_us, level): each uncovered cell's level at its start, linear between the readings around it."""
    first, last = _slot(F.col("us")) + F.col("step_us"), _slot(F.col("next_us")) - F.col("step_us")
    gaps = explode_steps(pairs, first, last, F.col("step_us"), "slot_us")
    level = F.col("v") + (F.col("next_v") - F.col("v")) * (F.col("slot_us") - F.col("us")) / (F.col("next_us") - F.col("us"))
    return gaps.select("series", "slot_us", level.alias("level"))


def _obs(spark, d: str) -> DataFrame:
    gauges = small(table(spark, d, "gauges").select("station", "step_s"))
    return readings(table(spark, d, "obs").select("upload_id", "station", "t", "height").join(gauges, "station"), "upload_id", "t", "height", "step_s")


def p4_found(spark, d: str) -> DataFrame:
    """Slots without a reading between the first and the last slot of each upload of obs."""
    return uncovered(increments(_obs(spark, d))).select(F.col("series").alias("upload_id"), F.floor(F.col("slot_us") / US).cast("long").alias("slot_s"))


def p4_series(spark, d: str) -> DataFrame:
    """The whole regular series of each upload: change of height in each slot, and whether it holds a reading."""
    out = regular_series(increments(_obs(spark, d)))
    return out.select(F.col("series").alias("upload_id"), F.floor(F.col("slot_us") / US).cast("long").alias("slot_s"), F.round("amount", 6).alias("rise_m"), "readings", "status")


QUERIES = {"p4_found": p4_found, "p4_series": p4_series}

_READ = """r AS (
  SELECT o.upload_id, g.step_s, epoch_us(o.t) AS us, o.height AS v FROM obs o JOIN gauges g ON o.station = g.station
  WHERE o.upload_id IS NOT NULL AND o.t IS NOT NULL AND g.step_s > 0 AND o.height IS NOT NULL AND NOT isnan(o.height))"""
SQL = {
    "p4_found": f"""WITH {_READ},
p AS (SELECT DISTINCT upload_id, step_s, us // (step_s::BIGINT * 1000000) AS k FROM r),
q AS (SELECT *, lead(k) OVER (PARTITION BY upload_id ORDER BY k) AS nk FROM p)
SELECT upload_id, unnest(range(k + 1, nk)) * step_s AS slot_s FROM q WHERE nk > k + 1""",
    "p4_series": f"""WITH {_READ},
p AS (SELECT *, step_s::BIGINT * 1000000 AS step, lead(us) OVER w AS us2, lead(v) OVER w - v AS inc FROM r WINDOW w AS (PARTITION BY upload_id ORDER BY us, v)),
c AS (SELECT *, coalesce(us2, us) AS e, unnest(range(us // step, coalesce(us2, us) // step + 1)) AS k FROM p)
SELECT upload_id, CAST(k * step_s AS BIGINT) AS slot_s,
  round(sum(CASE WHEN e > us THEN inc * (least((k + 1) * step, e) - greatest(k * step, us)) / (e - us) ELSE coalesce(inc, 0) END), 6) AS rise_m,
  count(*) FILTER (us // step = k) AS readings, CASE WHEN count(*) FILTER (us // step = k) > 0 THEN 'observed' ELSE 'uncovered' END AS status
FROM c GROUP BY upload_id, k, step_s""",
}
