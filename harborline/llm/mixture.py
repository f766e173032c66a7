"""Mixing sources to target shares of tokens, with capped repeats (problem 8), by entropy balancing.

Each document gets a rate (expected copies) as close in entropy to its base rate as the shares allow. With tokens n, the source's
cap C and target share p, the constraints are sum over documents of rate * n * (own source - p) = 0, so the rates are
tilted exponentially in n times the dual's coefficient of the source, and stay below the cap: rate / C = logistic(base +
n * coefficient). The dual is convex; Newton's steps need only two sums per source, taken in Spark over the
table of (source, n) counts. Rates become whole copies by a hash of the id, the cut chosen so that each source's tokens fit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import materialize, small, table, take_bounded
from harborline.llm.tokenize import TOKENIZERS, VOCABULARY, count_tokens

#: Sources that a mixture may name; their targets and sums are held on the driver.
MOST_SOURCES = 10_000
STEPS, CLOSE = 80, 1e-10
#: Bins of each of the two levels at which the rounding's cut is sought.
CUT_BINS = 4096


def _logistic(x: F.Column) -> F.Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def _base(cap: float) -> float:
    """Log odds of one copy under the cap; of half a copy where one is the cap."""
    q = min(1.0, cap / 2) / cap
    return float(np.log(q / (1 - q)))


def _rate(tokens: F.Column, cap: F.Column, base: F.Column, tilt: F.Column) -> F.Column:
    return cap * _logistic(base + tokens * tilt)


def _tilts(spark, rows: list[tuple]) -> DataFrame:
    """One row per source: few, by MOST_SOURCES."""
    return F.broadcast(spark.createDataFrame(rows, "src string, cap double, base double, tilt double"))


def solve_tilts(counts: DataFrame, targets: dict[str, tuple[float, float]], sums: dict[str, tuple[float, float]]) -> dict[str, float]:
    """source -> coefficient of tokens. counts(source, n, docs); targets: source -> (share, cap); sums: source -> (tokens, documents).

    Damped Newton on the dual in coordinates scaled by the source's mean tokens; every evaluation is one distributed sum.
    """
    names = sorted(sums)
    p = np.array([targets[s][0] for s in names])
    p = p / p.sum()
    cap = np.array([targets[s][1] for s in names])
    mean = np.array([sums[s][0] / sums[s][1] for s in names])
    base = np.array([_base(c) for c in cap])
    spark = counts.sparkSession

    def at(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Dual value, tokens by source and their change with the tilt."""
        tilt = _tilts(spark, [(s, float(cap[k]), float(base[k]), float(y[k])) for k, s in enumerate(names)])
        n, x = F.col("n"), F.col("base") + F.col("n") * F.col("tilt")
        odds = _logistic(x)
        soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
        got = (
            counts.join(tilt, counts["source"] == F.col("src"))
            .groupBy("src")
            .agg(F.sum(F.col("docs") * F.col("cap") * soft).alias("f"), F.sum(F.col("docs") * F.col("cap") * odds * n).alias("t"), F.sum(F.col("docs") * F.col("cap") * odds * (1 - odds) * n * n).alias("v"))
            .collect()
        )  # one row per source
        by = {r["src"]: r for r in got}
        return sum(by[s]["f"] for s in names), np.array([by[s]["t"] for s in names]), np.array([by[s]["v"] for s in names])

    # y_s = lambda_s - sum_r p_r lambda_r: the tilt of source s; one lambda is free, the smallest step is taken.
    lam = np.zeros(len(names))
    tilt = lambda v: v - p @ v
    value, t, v = at(tilt(lam))
    for _ in range(STEPS):
        gradient = t - p * t.sum()
        if np.abs(gradient).max() <= CLOSE * t.sum():
            break
        move = np.eye(len(names)) - np.outer(np.ones(len(names)), p)  # d tilt / d lambda
        hessian = move.T @ (v[:, None] * move)
        scale = 1 / mean
        h = hessian * np.outer(scale, scale)
        step = -scale * np.linalg.lstsq(h + 1e-12 * np.trace(h) * np.eye(len(h)), gradient * scale, rcond=None)[0]
        size = min(1.0, 8.0 / max(np.abs(tilt(step) * mean).max(), 1e-300))
        for _ in range(40):
            new, t2, v2 = at(tilt(lam + size * step))
            if new <= value + 1e-4 * size * (gradient @ step) + 1e-12 * abs(value):
                break
            size /= 2
        lam, value, t, v = lam + size * step, new, t2, v2
    y = tilt(lam)
    return {s: float(y[k]) for k, s in enumerate(names)}


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """docs(id, source, tokens), targets(source, target_share, max_repeats) -> (id, source, tokens, copies) with copies >= 1.

    Documents of sources without a positive target or without tokens, and null sources, are not used. Sources with a target but no
    tokens are left out and the others' shares rescaled. Of repeated target rows the one with the largest share holds.
    No document is used more than its source's max_repeats; the tokens of each source fit its rate's sum to about one document.
    """
    spark = docs.sparkSession
    wish: dict[str, tuple[float, float]] = {}
    for r in take_bounded(targets.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull()), MOST_SOURCES, "the table of targets"):
        wish[r["source"]] = max(wish.get(r["source"], (0.0, 0.0)), (float(r["target_share"]), float(r["max_repeats"])))
    none = docs.select("id", "source", "tokens", F.lit(0).cast("int").alias("copies")).limit(0)
    if not wish:
        return none
    named = _tilts(spark, [(s, c, _base(c), 0.0) for s, (_, c) in wish.items()])
    used = docs.where(F.col("tokens") > 0).join(named, F.col("source") == F.col("src"), "left_semi").select("id", "source", "tokens")
    counts = materialize(used.groupBy("source", F.col("tokens").alias("n")).agg(F.count(F.lit(1)).alias("docs")), "lengths")
    sums = {r["source"]: (float(r["t"]), float(r["d"])) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("docs")).alias("t"), F.sum("docs").alias("d")).collect()}
    if not sums:
        return none
    tilts = solve_tilts(counts, wish, sums)
    rated = used.join(_tilts(spark, [(s, wish[s][1], _base(wish[s][1]), y) for s, y in tilts.items()]), F.col("source") == F.col("src"))
    rate = _rate(F.col("tokens").cast("double"), F.col("cap"), F.col("base"), F.col("tilt"))
    chance = (F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    rated = rated.select("id", "source", "tokens", rate.alias("rate")).withColumn("whole", F.floor("rate"))
    part = F.col("rate") - F.col("whole")
    # Documents in order of chance / part get one copy more, until the source's tokens are full.
    rank = F.when(part > 0, chance / (part + chance)).otherwise(F.lit(2.0))
    rated = materialize(rated.select("id", "source", "tokens", "rate", "whole", rank.alias("rank")), "rates")
    cuts = _tilts(spark, [(s, cut, 0.0, 0.0) for s, cut in _cuts(rated).items()])
    copies = (F.col("whole") + F.when(F.col("rank") < F.col("cap"), 1).otherwise(0)).cast("int")
    return rated.join(cuts, F.col("source") == F.col("src")).select("id", "source", "tokens", copies.alias("copies")).where(F.col("copies") > 0)


def _cuts(rated: DataFrame) -> dict[str, float]:
    """source -> the rank below which documents get one copy more, so that tokens come nearest the rates' sum."""
    lack = {r["source"]: float(r["x"]) for r in rated.groupBy("source").agg(F.sum((F.col("rate") - F.col("whole")) * F.col("tokens")).alias("x")).collect()}
    low, width = dict.fromkeys(lack, 0.0), 1.0
    for _ in range(3):  # each level looks into the bin that the one before it found
        bounds = _tilts(rated.sparkSession, [(s, low[s], 0.0, 0.0) for s in lack])
        bin_ = F.floor((F.col("rank") - F.col("cap")) / (width / CUT_BINS))
        tokens = rated.join(bounds, F.col("source") == F.col("src")).where((F.col("rank") >= F.col("cap")) & (bin_ < CUT_BINS)).groupBy("source", bin_.alias("bin")).agg(F.sum("tokens").alias("t"))
        # At most CUT_BINS rows per source, cut down to one per source.
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("bin"))
        need = _tilts(rated.sparkSession, [(s, lack[s], 0.0, 0.0) for s in lack])
        passed = tokens.withColumn("upto", upto).join(need, F.col("source") == F.col("src")).where(F.col("upto") <= F.col("cap"))
        done = {r["source"]: (r["b"], float(r["u"])) for r in passed.groupBy("source").agg(F.max("bin").alias("b"), F.max("upto").alias("u")).collect()}
        following = tokens.withColumn("upto", upto).join(need, F.col("source") == F.col("src")).where(F.col("upto") > F.col("cap")).groupBy("source").agg(F.min("bin").alias("b")).collect()
        at = {r["source"]: r["b"] for r in following}
        for s in lack:
            lack[s] -= done.get(s, (0, 0.0))[1]
            low[s] += (at[s] if s in at else CUT_BINS) * (width / CUT_BINS)
        width /= CUT_BINS
    # The next document goes in, too, if that comes nearer.
    bounds = _tilts(rated.sparkSession, [(s, low[s], 0.0, 0.0) for s in lack])
    following = rated.join(bounds, F.col("source") == F.col("src")).where((F.col("rank") >= F.col("cap")) & (F.col("rank") < 1.5))
    for r in following.groupBy("source").agg(F.min("rank").alias("r"), F.min_by("tokens", "rank").alias("t")).collect():
        if r["t"] < 2 * lack[r["source"]]:
            low[r["source"]] = float(np.nextafter(r["r"], 2.0))
    return low


def sized_documents(spark, d: str) -> DataFrame:
    """(id, source, tokens) of the documents whose source has a target, counted once and kept."""
    named = small(table(spark, d, "mix_targets").where(F.col("source").isNotNull()).select("source").distinct())
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text").join(named, "source", "left_semi")
    return materialize(count_tokens(docs.select("id", "source", "text"), "text", f"{TOKENIZERS}/{VOCABULARY}"), "sizes")


def p8_mixture(spark, d: str) -> DataFrame:
    """The documents of the mixture with their numbers of copies."""
    got = mix(sized_documents(spark, d), table(spark, d, "mix_targets"))
    return got.select(F.col("id").alias("doc_id"), "source", "tokens", "copies")


def p8_shares(spark, d: str) -> DataFrame:
    """Target and reached share of each source, its tokens in the mixture, documents used, most copies of one."""
    targets = table(spark, d, "mix_targets")
    got = mix(sized_documents(spark, d), targets).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())  # one row per source
    return small(targets.select("source", "target_share", "max_repeats")).join(got.withColumn("share", share), "source", "left").select("source", "target_share", "share", "tokens", "documents", "most_copies", "max_repeats")


def p8_kept(spark, d: str) -> DataFrame:
    """Whether each source of the targets keeps its target to half a percent of all tokens, and its cap on copies."""
    got = p8_shares(spark, d)
    return got.select("source", (F.abs(F.col("share") - F.col("target_share")) <= 0.005).alias("on_target"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_kept": p8_kept}
#: The mixture itself has no SQL; that it keeps targets and caps has.
SQL = {"p8_kept": "SELECT source, TRUE AS on_target, TRUE AS within_cap FROM mix_targets WHERE target_share > 0 AND source IN (SELECT source FROM documents)"}
