"""Ordered groups cut into blocks with halos, so that one hot group never becomes one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one group up to which it stays whole.
BLOCK_ROWS = 500_000
#: More hot groups than this are found by a join instead of a literal list.
HOT_LIST = 2_000


def ordered_blocks(df: DataFrame, key: str, order: list[str], chunk: F.Column, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `_blk` (block of the group) and `_core` (false for halo copies).

    Groups of at most `block_rows` rows stay whole as block 0. Larger ones are numbered in `order` and cut
    every `block_rows` rows; the first and last `halo` rows of a block are copied to its neighbours. The numbering
    takes two steps: within coarse chunks (`chunk`, monotone in the first order column) and over the chunks' counts,
    so that no window sees more than a chunk. Null keys form one group; an empty table stays empty.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select(F.col(key).alias("_hot"))
    some = [r[0] for r in counts.limit(HOT_LIST + 1).collect()]
    plain = df.withColumns({"_blk": F.lit(0).cast("long"), "_core": F.lit(True)})
    if not some:
        return plain
    if len(some) <= HOT_LIST:
        hit = F.col(key).isNull() if None in some else F.lit(False)
        if named := [x for x in some if x is not None]:
            hit = hit | F.coalesce(F.col(key).isin(named), F.lit(False))
        hot, cold = df.where(hit), plain.where(~hit)
    else:
        same = F.col(key).eqNullSafe(F.col("_hot"))
        hot, cold = df.join(counts, same, "left_semi"), plain.join(counts, same, "left_anti")
    hot = hot.withColumn("_chunk", chunk)
    by = Window.partitionBy(key, "_chunk").orderBy(*order)
    sizes = hot.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
    at = F.col("_off") + F.col("_rn") - 1
    numbered = (
        hot.withColumn("_rn", F.row_number().over(by))
        .join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_chunk").eqNullSafe(F.col("_c")))
        .withColumn("_b", F.floor(at / block_rows).cast("long"))
        .withColumn("_at", at % block_rows)
    )
    copies = F.array_compact(
        F.array(
            F.struct(F.col("_b").alias("_blk"), F.lit(True).alias("_core")),
            F.when((F.col("_at") < halo) & (F.col("_b") > 0), F.struct((F.col("_b") - 1).alias("_blk"), F.lit(False).alias("_core"))),
            F.when((F.col("_at") >= block_rows - halo) & ((F.col("_b") + 1) * block_rows < F.col("_all")), F.struct((F.col("_b") + 1).alias("_blk"), F.lit(False).alias("_core"))),
        )
    )
    cut = numbered.withColumn("_to", F.explode(copies)).select(*df.columns, "_to._blk", "_to._core")
    return cold.unionByName(cut)
