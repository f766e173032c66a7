"""The quality battery of an upload and the cleaned series: residuals about a running median, spikes, flat stretches, shift and drift.

Medians over windows whose width follows from the length of the series are taken in Arrow batches over series laid out in time
(hot series in blocks with halos); all figures of a series are plain aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import materialize
from harborline.operators.blocks import BLOCK_ROWS, ordered_blocks
from harborline.operators.series import DAY, _obs, with_neighbours
from harborline.operators.spikes import _whole
from harborline.operators.tides import OBS_SQL

# The tolerances of the battery.
SPIKE_SIGMA, MOST_SPIKES, DATUM_M, DRIFT_M_A_DAY, LEAST, FLAT_STEP, MOST_FLAT = 5.0, 0.05, 0.30, 0.10, 24, 1e-6, 0.50
SHORT, LONG = (0.03, 5, 13), (0.20, 49, 201)


def half_width(n: str, part: float, low: int, high: int, even: str) -> str:
    """Half the odd window of `part` of n readings, within low..high, as SQL; `even` rounds to the nearest, ties to even."""
    return f"(CAST(greatest({low}, least({high}, {even}({n} * {part}, 0))) AS INT) DIV 2)" if even == "bround" else f"(CAST(greatest({low}, least({high}, {even}({n} * {part}, 0))) AS INT) // 2)"


def sliding_median(v: np.ndarray, seg: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The median of the `half` readings on each side and the reading itself, cut at the ends of the segment."""
    n, out = len(v), np.empty(len(v))
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]]) if n else np.zeros(0, int)
    low, size = np.repeat(first, np.diff(np.r_[first, n])), np.repeat(np.diff(np.r_[first, n]), np.diff(np.r_[first, n]))
    for h in np.unique(half).tolist():
        rows = np.flatnonzero(half == h)
        for part in np.array_split(rows, max(1, len(rows) * (2 * h + 1) // 4_000_000)):
            at = part[:, None] + np.arange(-h, h + 1)[None, :]
            ok = (at >= low[part][:, None]) & (at < (low + size)[part][:, None])
            w = np.sort(np.where(ok, v[np.clip(at, 0, n - 1)], np.inf), axis=1)
            count, row = ok.sum(axis=1), np.arange(len(part))
            out[part] = (w[row, (count - 1) // 2] + w[row, count // 2]) / 2
    return out


def with_medians(obs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """obs(obs_id, key, us, height, n, half_s, half_l) -> (obs_id, key, us, height, n, resid, smooth): residual about the short median, and the long one."""
    cut = ordered_blocks(obs, "key", ["us", "obs_id"], F.floor(F.col("us") / (7 * DAY)), LONG[2] // 2, block_rows)
    laid = cut.repartition("key", "_blk").sortWithinPartitions("key", "_blk", "us", "obs_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _whole(batches):
            seg = np.cumsum(np.r_[0, (x["key"][1:] != x["key"][:-1]) | (x["_blk"][1:] != x["_blk"][:-1])])
            v = x["height"]
            short, long = sliding_median(v, seg, x["half_s"]), sliding_median(v, seg, x["half_l"])
            core = x["_core"].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(y[core]) for y in (x["obs_id"], x["key"], x["us"], v, x["n"], v - short, long)], ["obs_id", "key", "us", "height", "n", "resid", "smooth"])

    return laid.mapInArrow(run, "obs_id long, key long, us long, height double, n long, resid double, smooth double")


def judged(obs: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """obs(obs_id, key, us, height), no nulls -> (readings with `spike`, figures of each series) of series of at least LEAST readings.

    Readings go by time, equal times by id. spread: 1.4826 MAD of the residuals, else their deviation, else 1.
    """
    counts = obs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    wide = lambda w: F.expr(half_width("n", *w, "bround"))
    use = obs.join(counts.where(F.col("n") >= LEAST), "key").withColumns({"half_s": wide(SHORT), "half_l": wide(LONG)})
    # Written once: centre, spread, halves and the verdicts all read it. Residuals are rounded to a micrometre, so exact medians count a bounded number of values.
    rows = materialize(with_medians(use, block_rows).withColumn("resid", F.round("resid", 6)), "medians")
    centre = rows.groupBy("key").agg(F.percentile("resid", F.lit(0.5)).alias("centre"), F.stddev_pop("resid").alias("std"))
    mad = rows.join(centre, "key").groupBy("key").agg(F.percentile(F.abs(F.col("resid") - F.col("centre")), F.lit(0.5)).alias("mad"), F.first("centre").alias("centre"), F.first("std").alias("std"))
    spread = F.when(F.col("mad") > 1e-9, 1.4826 * F.col("mad")).when(F.col("std") > 1e-9, F.col("std")).otherwise(1.0)
    rows = rows.join(mad.select("key", "centre", spread.alias("spread")), "key").withColumn("spike", F.abs(F.col("resid") - F.col("centre")) > SPIKE_SIGMA * F.col("spread"))
    return rows, rows.groupBy("key").agg(F.first("n").alias("n"), F.count(F.when(F.col("spike"), 1)).alias("flagged"), F.first("spread").alias("spread"))


def battery(obs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """obs(obs_id, key, us, height), no nulls -> (key, n, flagged, flat, repeated, datum_shift, drift, reasons, rejected).

    Series of fewer than LEAST readings are rejected as 'few' with no figures. flat: share of steps below FLAT_STEP; repeated:
    readings at an instant already read; datum_shift: median of the second half less that of the first; drift: slope a day of
    the long median over the readings that are no spikes. Reasons come in the order few, times, flat, spikes, datum, drift.
    """
    rows, about = judged(obs, block_rows)
    hours = (F.col("us") - F.col("us0")) / 3.6e9
    steps = with_neighbours(rows, "key", ["us", "obs_id"], {"before": lambda w: F.lag("height").over(w), "last": lambda w: F.lag("us").over(w)}, 1, block_rows)
    # Places within days plus the days' counts: no window sees more than a day of a series.
    day = F.expr(f"us DIV {DAY}")
    days = rows.groupBy("key", day.alias("day")).agg(F.count(F.lit(1)).alias("c"))
    days = days.withColumn("sofar", F.coalesce(F.sum("c").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    placed = rows.withColumn("day", day).join(days, ["key", "day"]).withColumn("place", F.col("sofar") + F.row_number().over(Window.partitionBy("key", "day").orderBy("us", "obs_id")) - 1)
    half = lambda late: F.percentile(F.when((F.col("place") >= F.expr("n DIV 2")) == late, F.col("height")), F.lit(0.5))
    halves = placed.groupBy("key").agg((half(True) - half(False)).alias("datum_shift"))
    first = rows.groupBy("key").agg(F.min("us").alias("us0"))
    good = rows.where(~F.col("spike")).join(first, "key").withColumns({"x": hours, "y": F.col("smooth")})
    slope = good.groupBy("key").agg((24 * F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("drift"))
    flat = steps.where("before IS NOT NULL").groupBy("key").agg(F.avg((F.abs(F.col("height") - F.col("before")) < FLAT_STEP).cast("double")).alias("flat"), F.count(F.when(F.col("us") == F.col("last"), 1)).alias("repeated"))
    got = about.join(halves, "key").join(slope, "key", "left").join(flat, "key")
    figures = got.select("key", "n", "flagged", F.round("flat", 5).alias("flat"), "repeated", F.round("datum_shift", 4).alias("datum_shift"), F.round(F.coalesce("drift", F.lit(0.0)), 4).alias("drift"))
    why = {"times": "repeated > 0", "flat": f"flat > {MOST_FLAT}", "spikes": f"flagged > {MOST_SPIKES} * n", "datum": f"abs(datum_shift) > {DATUM_M}", "drift": f"abs(drift) > {DRIFT_M_A_DAY}"}
    figures = figures.withColumn("reasons", F.expr(f"concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in why.items())})"))
    few = obs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < LEAST).withColumn("reasons", F.lit("few"))
    return figures.unionByName(few, allowMissingColumns=True).withColumn("rejected", F.col("reasons") != "")


def cleaned(obs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """obs(obs_id, key, us, height), no nulls -> (obs_id, height, cleaned): spikes replaced by the line between the good readings
    around them, or by the only one at an end. Series of fewer than LEAST readings stay as they are.

    A stretch of spikes is shorter than the short window, whose median would follow it, so a block's halo always reaches past it.
    """
    rows, _ = judged(obs, block_rows)
    good = F.when(~F.col("spike"), F.struct("us", "height"))
    columns = {"b": lambda w: F.last(good, True).over(w.rowsBetween(-2 * SHORT[2], -1)), "a": lambda w: F.first(good, True).over(w.rowsBetween(1, 2 * SHORT[2]))}
    near = with_neighbours(rows.select("obs_id", "key", "us", "height", "spike"), "key", ["us", "obs_id"], columns, 2 * SHORT[2], block_rows)
    line = F.when(F.col("a.us") == F.col("b.us"), F.col("a.height")).otherwise(F.col("b.height") + (F.col("a.height") - F.col("b.height")) * (F.col("us") - F.col("b.us")) / (F.col("a.us") - F.col("b.us")))
    fixed = near.where("spike").select("obs_id", F.coalesce(line, F.col("b.height"), F.col("a.height")).alias("fixed"))
    return obs.join(fixed, "obs_id", "left").select("obs_id", "height", F.coalesce("fixed", "height").alias("cleaned"))


def _uploads(spark, d: str) -> DataFrame:
    return _obs(spark, d).where(F.abs("height") < 25).select("obs_id", F.col("upload_id").alias("key"), "us", "height")


def ref_qc(spark, d: str) -> DataFrame:
    """The battery over every upload: readings, spikes, flat share, repeated instants, shift, drift, reasons for rejection."""
    return battery(_uploads(spark, d)).withColumnRenamed("key", "upload_id")


def ref_clean(spark, d: str) -> DataFrame:
    """Every upload's readings with spikes replaced by interpolation."""
    return cleaned(_uploads(spark, d)).select("obs_id", (F.round("cleaned", 6) + 0.0).alias("cleaned"))


QUERIES = {"ref_qc": ref_qc, "ref_clean": ref_clean}
_JUDGED = f"""o AS (SELECT obs_id, upload_id, us, height, count(*) OVER (PARTITION BY upload_id) AS n FROM {OBS_SQL} WHERE upload_id IS NOT NULL AND abs(height) < 25),
h AS (SELECT *, {half_width('n', *SHORT, 'round_even')} AS hs, {half_width('n', *LONG, 'round_even')} AS hl FROM o WHERE n >= {LEAST}),
m AS (SELECT *, round(height - quantile_cont(height, 0.5) OVER (PARTITION BY upload_id ORDER BY us, obs_id ROWS BETWEEN hs PRECEDING AND hs FOLLOWING), 6) AS resid,
  quantile_cont(height, 0.5) OVER (PARTITION BY upload_id ORDER BY us, obs_id ROWS BETWEEN hl PRECEDING AND hl FOLLOWING) AS smooth,
  row_number() OVER w - 1 AS place, lag(height) OVER w AS before, lag(us) OVER w AS last, min(us) OVER (PARTITION BY upload_id) AS us0 FROM h WINDOW w AS (PARTITION BY upload_id ORDER BY us, obs_id)),
c AS (SELECT upload_id, median(resid) AS centre, stddev_pop(resid) AS std FROM m GROUP BY 1),
d AS (SELECT upload_id, centre, std, median(abs(resid - centre)) AS mad FROM m JOIN c USING (upload_id) GROUP BY 1, 2, 3),
j AS (SELECT m.*, abs(resid - centre) > {SPIKE_SIGMA} * CASE WHEN mad > 1e-9 THEN 1.4826 * mad WHEN std > 1e-9 THEN std ELSE 1.0 END AS spike FROM m JOIN d USING (upload_id))"""
SQL = {
    "ref_qc": f"""WITH {_JUDGED}, f AS (SELECT upload_id, max(n) AS n, count(*) FILTER (spike) AS flagged, round(avg(CAST(abs(height - before) < {FLAT_STEP} AS DOUBLE)), 5) AS flat, count(*) FILTER (us = last) AS repeated,
  round(median(height) FILTER (place >= n // 2) - median(height) FILTER (place < n // 2), 4) AS datum_shift,
  round(coalesce(24 * regr_slope(smooth, (us - us0) / 3.6e9) FILTER (NOT spike), 0.0), 4) AS drift FROM j GROUP BY 1),
r AS (SELECT *, concat_ws(',', CASE WHEN repeated > 0 THEN 'times' END, CASE WHEN flat > {MOST_FLAT} THEN 'flat' END, CASE WHEN flagged > {MOST_SPIKES} * n THEN 'spikes' END, CASE WHEN abs(datum_shift) > {DATUM_M} THEN 'datum' END, CASE WHEN abs(drift) > {DRIFT_M_A_DAY} THEN 'drift' END) AS reasons FROM f
  UNION ALL SELECT DISTINCT upload_id, n, NULL, NULL, NULL, NULL, NULL, 'few' FROM o WHERE n < {LEAST})
SELECT *, reasons <> '' AS rejected FROM r""",
    "ref_clean": f"""WITH {_JUDGED}, g AS (SELECT *, last_value(CASE WHEN NOT spike THEN us END IGNORE NULLS) OVER b AS bu, last_value(CASE WHEN NOT spike THEN height END IGNORE NULLS) OVER b AS bh,
  first_value(CASE WHEN NOT spike THEN us END IGNORE NULLS) OVER a AS au, first_value(CASE WHEN NOT spike THEN height END IGNORE NULLS) OVER a AS ah FROM j
  WINDOW b AS (PARTITION BY upload_id ORDER BY us, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY upload_id ORDER BY us, obs_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT o.obs_id, round(CASE WHEN NOT coalesce(g.spike, FALSE) THEN o.height WHEN au = bu THEN ah WHEN au IS NULL THEN bh WHEN bu IS NULL THEN ah ELSE bh + (ah - bh) * (g.us - bu) / (au - bu) END, 6) + 0.0 AS cleaned FROM o LEFT JOIN g USING (obs_id)""",
}
