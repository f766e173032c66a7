"""Digests and deltas of data sets: content hashes that don't depend on order, snapshots compared, aliases, a content store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.common import small, table, written_dir


def digests(obs: DataFrame) -> DataFrame:
    """obs(key, us, height) -> (key, n, digest): SHA-256 over the days' SHA-256 in order, each over its sorted readings.

    Two levels, so a long series is hashed in many tasks. A reading is 'microseconds;micrometres'; null heights are 'null',
    those beyond a billion kilometres count as that.
    Repeated readings count each.
    """
    line = F.concat_ws(";", "us", F.coalesce(F.when(F.col("height").isNotNull(), F.round(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), F.col("height"))) * 1e6).cast("long").cast("string")), F.lit("null")))
    days = obs.groupBy("key", F.expr("us DIV 86400000000").alias("day")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return days.groupBy("key").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) between two tables of digests: added, removed, updated or unchanged."""
    a, b = old.select("key", F.col("digest").alias("was")), new.select("key", F.col("digest").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated").otherwise("unchanged")
    return a.join(b, "key", "full").select("key", change.alias("change"))


def alias(owner, name):
    """A station's name in shared data: twelve digits of the hash of owner and name."""
    return F.substring(F.sha2(F.concat_ws("|", owner, name), 256), 1, 12)


def with_noise(coef: DataFrame, epsilon: float, delta_: float = 1e-5, clip: float = 5.0, seed: int = 0) -> DataFrame:
    """coef(key, k, value) with values clipped and Gaussian noise of the mechanism for (epsilon, delta) added.

    The noise is drawn from a hash of key, k and seed, so it doesn't depend on the partitioning.
    """
    import math

    sigma = clip * math.sqrt(2 * math.log(1.25 / delta_)) / epsilon
    u = lambda salt: (F.pmod(F.xxhash64("key", "k", F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    gauss = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    return coef.withColumn("value", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("value"))) + sigma * gauss)


def store_new(df: DataFrame, content: str, path: str) -> DataFrame:
    """Append to the store the rows whose content is new, keyed by its hash; the whole store is returned. Never rewrites."""
    spark = df.sparkSession
    keyed = df.withColumn("hash", F.sha2(F.col(content), 256)).where("hash IS NOT NULL").dropDuplicates(["hash"])
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        keyed = keyed.join(spark.read.parquet(path).select("hash"), "hash", "left_anti")
    keyed.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def resolve(store: DataFrame, prefix: str) -> DataFrame:
    """The row whose hash begins so, if it is the only one and the prefix has at least eight digits; else none."""
    hit = store.where(F.col("hash").startswith(prefix) & F.lit(len(prefix) >= 8)).limit(2)
    return hit if hit.count() == 1 else hit.limit(0)


CUT = "2025-03-01 00:00:00"


def _keyed(spark, d: str) -> DataFrame:
    return table(spark, d, "obs").where("upload_id IS NOT NULL AND t IS NOT NULL").select(F.col("upload_id").alias("key"), F.unix_micros("t").alias("us"), F.when(~F.isnan("height"), F.col("height")).alias("height"), "received_at")


def ref_digests(spark, d: str) -> DataFrame:
    """Content digest of each upload."""
    return digests(_keyed(spark, d)).select(F.col("key").alias("upload_id"), "n", "digest")


def ref_delta(spark, d: str) -> DataFrame:
    """How each upload changed between what had been received by a cut and all."""
    obs = _keyed(spark, d)
    return delta(digests(obs.where(F.col("received_at") <= F.lit(CUT).cast("timestamp"))), digests(obs)).select(F.col("key").alias("upload_id"), "change")


def ref_alias(spark, d: str) -> DataFrame:
    """Aliases of the stations under one owner."""
    return table(spark, d, "gauges").select("station", alias(F.lit("harbour"), F.col("station")).alias("alias"))


def ref_latest_report(spark, d: str) -> DataFrame:
    """The latest report of each station."""
    return table(spark, d, "qc_reports").where("reported_at IS NOT NULL").groupBy("station").agg(F.max_by("upload_id", F.struct("reported_at", "upload_id")).alias("upload_id"), F.count(F.lit(1)).alias("reports"))


def verified(store: DataFrame, content: str) -> DataFrame:
    """(hash, ok): whether each stored content still has its hash."""
    return store.select("hash", F.coalesce(F.sha2(F.col(content), 256) == F.col("hash"), F.lit(False)).alias("ok"))


def history(df: DataFrame, name: str, at: str, rid: str) -> DataFrame:
    """(id, version, parent, latest) of every version of a name in order of time (equal times by id); versions start at 1.

    Versions are counted within days and the days' counts added up, so no window sees more than a name's day.
    """
    rows = df.where(F.col(name).isNotNull() & F.col(at).isNotNull()).select(F.col(name).alias("name"), F.unix_micros(at).alias("us"), F.col(rid).alias("id"))
    rows = rows.withColumn("day", F.expr("us DIV 86400000000"))
    days = rows.groupBy("name", "day").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("us", "id")).alias("end"))
    w = Window.partitionBy("name").orderBy("day")
    days = days.select("name", "day", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sofar"), F.lag("end").over(w)["id"].alias("last"), F.sum("c").over(Window.partitionBy("name")).alias("total"))
    own = Window.partitionBy("name", "day").orderBy("us", "id")
    got = rows.withColumns({"place": F.row_number().over(own), "before": F.lag("id").over(own)}).join(days, ["name", "day"])
    return got.select("id", (F.col("place") + F.col("sofar")).alias("version"), F.coalesce("before", "last").alias("parent"), (F.col("place") + F.col("sofar") == F.col("total")).alias("latest"))


def merged(parts: DataFrame, by: str) -> DataFrame:
    """parts(by, n, first_us, last_us, digest) -> one provenance per group: counts summed, the span, and a digest of the sorted digests."""
    return parts.groupBy(by).agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), "\n"), 256).alias("digest"))


def ref_store(spark, d: str) -> DataFrame:
    """Reports' contents put into the content store twice, the second time with more: every content once, each still true to its hash."""
    path = f"{written_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, d, "qc_reports").select("upload_id", F.concat_ws("|", "station", "sensor", "n_total").alias("content"))
    store_new(rows.where("upload_id % 2 = 0").select("content"), "content", path)
    return verified(store_new(rows.select("content"), "content", path), "content")


def ref_history(spark, d: str) -> DataFrame:
    """Every station's reports as versions: number, the one before, whether it is the latest."""
    return history(table(spark, d, "qc_reports"), "station", "reported_at", "upload_id").withColumnRenamed("id", "upload_id")


def ref_provenance(spark, d: str) -> DataFrame:
    """Provenance of each region: its uploads' counts, span and digests merged."""
    obs = table(spark, d, "obs").where("upload_id IS NOT NULL AND t IS NOT NULL")
    about = obs.groupBy(F.col("upload_id").alias("key")).agg(F.min("station").alias("station"), F.min(F.unix_micros("t")).alias("first_us"), F.max(F.unix_micros("t")).alias("last_us"))
    region = small(table(spark, d, "gauges").select("station", F.coalesce("region_name", F.lit("unknown")).alias("region")).dropDuplicates(["station"]))
    return merged(digests(_keyed(spark, d)).join(about, "key").join(region, "station"), "region")


def ref_clip_noise(spark, d: str) -> DataFrame:
    """Constants with the noise mechanism at a budget so large that only its clipping shows."""
    each = table(spark, d, "gauges").where("station IS NOT NULL").select("station", F.posexplode("constituents").alias("k", "c")).select(F.col("station").alias("key"), "k", (F.col("c.amplitude") * 10).alias("value"))
    return with_noise(each, 1e9).select(F.col("key").alias("station"), "k", (F.round("value", 5) + 0.0).alias("value"))


QUERIES = {f.__name__: f for f in (ref_digests, ref_delta, ref_alias, ref_latest_report, ref_store, ref_history, ref_provenance, ref_clip_noise)}

_DIGEST = """(WITH d AS (SELECT upload_id, epoch_us(t) // 86400000000 AS day, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM
  (SELECT *, epoch_us(t)::VARCHAR || ';' || coalesce(CAST(round(CASE WHEN NOT isnan(height) THEN greatest(-1e12, least(1e12, height)) END * 1e6) AS BIGINT)::VARCHAR, 'null') AS line FROM obs WHERE upload_id IS NOT NULL AND t IS NOT NULL {more}) GROUP BY 1, 2)
SELECT upload_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY day)) AS digest FROM d GROUP BY 1)"""
SQL = {
    "ref_digests": _DIGEST.format(more=""),
    "ref_delta": f"SELECT upload_id, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' WHEN a.digest <> b.digest THEN 'updated' ELSE 'unchanged' END AS change FROM {_DIGEST.format(more=f'''AND received_at <= TIMESTAMPTZ '{CUT}+00' ''')} a FULL JOIN {_DIGEST.format(more='')} b USING (upload_id)",
    "ref_alias": "SELECT station, substr(sha256('harbour|' || station), 1, 12) AS alias FROM gauges",
    "ref_latest_report": "SELECT station, first(upload_id ORDER BY reported_at DESC, upload_id DESC) AS upload_id, count(*) AS reports FROM qc_reports WHERE reported_at IS NOT NULL GROUP BY 1",
    "ref_store": "SELECT DISTINCT sha256(concat_ws('|', station, sensor, n_total::VARCHAR)) AS hash, TRUE AS ok FROM qc_reports",
    "ref_history": """SELECT upload_id, row_number() OVER w AS version, lag(upload_id) OVER w AS parent, row_number() OVER w = count(*) OVER (PARTITION BY station) AS latest FROM qc_reports
WHERE station IS NOT NULL AND reported_at IS NOT NULL WINDOW w AS (PARTITION BY station ORDER BY reported_at, upload_id)""",
    "ref_provenance": f"""WITH p AS (SELECT * FROM {_DIGEST.format(more='')} JOIN (SELECT upload_id, min(station) AS station, epoch_us(min(t)) AS a, epoch_us(max(t)) AS b FROM obs WHERE upload_id IS NOT NULL AND t IS NOT NULL GROUP BY 1) USING (upload_id) JOIN (SELECT station, coalesce(region_name, 'unknown') AS region FROM gauges) USING (station))
SELECT region, count(*) AS parts, CAST(sum(n) AS BIGINT) AS n, min(a) AS first_us, max(b) AS last_us, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS digest FROM p GROUP BY 1""",
    "ref_clip_noise": "SELECT station, CAST(i - 1 AS INT) AS k, round(greatest(-5.0, least(5.0, constituents[i].amplitude * 10)), 5) + 0.0 AS value FROM (SELECT station, constituents, unnest(range(1, len(constituents) + 1)) AS i FROM gauges WHERE station IS NOT NULL)",
}
