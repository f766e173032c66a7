"""Helpers shared by all operators: tables, shared storage, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay within this bound.
BROADCAST_ROWS = 50_000


_SHIPPED: set[str] = set()
_WRITTEN: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python need not find it by path or working directory."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = package_root()
    path = os.path.join(tempfile.mkdtemp(prefix="harborline-"), "harborline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "harborline")):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables, with zone-less timestamps read as UTC instants."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local master without one (tests) gets a temporary folder; a cluster must name one,
    since what executors write to their own disks is lost to the others."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='harborline-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def written_dir(spark: SparkSession) -> str:
    """This application's folder of written tables in the shared folder; it is removed when the driver's JVM ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/harborline/{sc.applicationId}"
    if path not in _WRITTEN:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _WRITTEN.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove this application's written tables now; results that still read them can't be used any more."""
    sc, path = spark.sparkContext, written_dir(spark)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, runs the plan once."""
    path = f"{written_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast if it has at most `rows` rows (counted, stopping there); else leave the choice to Catalyst."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def take_bounded(df: DataFrame, rows: int, what: str) -> list:
    """Collect a table whose size is bounded by its meaning; raise instead of swamping the driver."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return got


def explode_steps(df: DataFrame, first: F.Column, last: F.Column, step: F.Column, name: str, chunk: int = 65_536) -> DataFrame:
    """df with `name`: a row for each of first, first + step, ... up to last; none where last lies before first.

    In two levels, so that no single gap, however long, becomes one array.
    """
    parts = df.where(first <= last).withColumn("_from", F.explode(F.sequence(first, last, step * chunk)))
    return parts.withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(last, F.col("_from") + step * (chunk - 1)), step))).drop("_from")


def micros(c) -> F.Column:
    return F.unix_micros(c)


def valid_number(c: str) -> F.Column:
    """Neither null nor NaN."""
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def iso_instant(c) -> F.Column:
    """Microseconds of ISO text with optional seconds, fraction and zone (UTC without one); null where it is none."""
    text = F.regexp_replace(c, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2})(?=$|Z|[+-])", "$1:00")
    return F.unix_micros(F.try_to_timestamp(text))
