"""Mixed timestamp texts to one UTC instant each (problem 3).

Distinct (text, zone, date order) triples form a dictionary; each is parsed once, exhaustively, in Arrow batches; a
stored dictionary grows by the triples it lacks; the instants are joined back to the rows. A text stands for an instant
only if exactly one reading of it exists: skipped or repeated wall-clock times, impossible dates, unknown words give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import materialize, small, table

EPOCH = datetime(1970, 1, 1)
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
#: Rows of one text from which its dictionary entry is joined by broadcast, apart from the rest.
HOT_TEXT = 1_000_000

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?)(?![A-Za-z]))?"
_ZONE = r"(?:\s*(?P<zone>[Zz]|[A-Za-z]{2,5}|[\[(]?(?:UTC|GMT)?[+\-−]\d{2}(?::?\d{2})?[\])]?|\[?[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+\]?|[\[(](?:UTC|GMT|Z)[\])]))?"
_SHAPES = [
    re.compile(p + _ZONE, re.ASCII)
    for p in (
        r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})(?:[Tt]|\s+)" + _TIME,
        r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})(?:[Tt]|\s+)(?P<h>\d{1,2})(?:h|:)(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?",
        r"(?P<y>\d{4})-(?P<doy>\d{3})(?:[Tt]|\s+)" + _TIME,
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt](?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?",
        r"(?P<sa>\d{1,2})/(?P<sb>\d{1,2})/(?P<y>\d{4}),?\s+" + _TIME,
        r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}),?\s+" + _TIME,
        r"(?:(?P<wd>[A-Za-z]{3,9}),?\s+)?(?P<d>\d{1,2})\s+(?P<mon>[A-Za-z]{3,9})\.?,?\s+(?P<y>\d{4}),?\s+" + _TIME,
        r"(?:(?P<wd>[A-Za-z]{3,9}),?\s+)?(?P<mon>[A-Za-z]{3,9})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4}),?\s+" + _TIME,
    )
]
_BARE = re.compile(r"\d+(?:\.\d{1,9})?", re.ASCII)
_OFFSET = re.compile(r"(?:UTC|GMT)?([+\-−])(\d{2}):?(\d{2})?", re.ASCII)


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - unknown keys fail in several ways
        return None


@lru_cache(maxsize=1024)
def _abbreviations(zone: str) -> dict[str, int]:
    """Abbreviation -> offset in seconds, as used in the zone from 2000 on; those with two offsets are left out."""
    seen: dict[str, set[int]] = {}
    if (tz := _zone(zone)) is not None:
        for month in range(12 * 40):
            at = datetime(2000 + month // 12, month % 12 + 1, 15, tzinfo=timezone.utc).astimezone(tz)
            seen.setdefault(at.tzname(), set()).add(int(at.utcoffset().total_seconds()))
    return {k: v.pop() for k, v in seen.items() if len(v) == 1}


def _micros(wall: datetime) -> int:
    gap = wall - EPOCH
    return (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds


def _local(wall: datetime, tz: ZoneInfo | None) -> int | None:
    """The one instant of a wall-clock time, or None where a clock change skips or repeats it."""
    if tz is None:
        return None
    early, late = (wall.replace(tzinfo=tz, fold=k).utcoffset() for k in (0, 1))
    return _micros(wall - early) if early == late else None


def _word(text: str, words: list[str]) -> int | None:
    """Index of a full or three-letter name (also 'sept')."""
    low = text.lower()
    for k, w in enumerate(words):
        if low in (w, w[:3]) or (w == "september" and low == "sept"):
            return k
    return None


def _bare(text: str) -> int | datetime | None:
    """A bare number: dates written together (8, 12 or 14 digits) are wall-clock, other lengths Unix time."""
    whole, _, part = text.partition(".")
    if not part and len(whole) in (8, 12, 14) and whole[:2] in ("19", "20"):
        shape = {8: "%Y%m%d", 12: "%Y%m%d%H%M", 14: "%Y%m%d%H%M%S"}[len(whole)]
        try:
            return datetime.strptime(whole, shape)
        except ValueError:
            return None
    unit = 1_000_000 if 9 <= len(whole) <= 10 else 1_000 if 12 <= len(whole) <= 13 else 1 if 15 <= len(whole) <= 16 else 0
    return (int(whole + part) * unit) // 10 ** len(part) if unit else None


def parse_time(text: str | None, zone: str | None, order: str | None) -> int | None:
    """Microseconds since 1970 UTC of the one instant the text stands for, else None.

    `zone` (IANA) holds for texts without a zone of their own and for abbreviations; `order` is 'dmy' or 'mdy' and holds
    for slashed dates. Without them such texts have no instant. Blanks around the text are ignored.
    """
    if text is None or not (text := text.strip()):
        return None
    if _BARE.fullmatch(text):
        got = _bare(text)
        return _local(got, _zone(zone) if zone else None) if isinstance(got, datetime) else got
    for shape in _SHAPES:
        if m := shape.fullmatch(text):
            return _instant(m.groupdict(), zone, order)
    return None


def _instant(g: dict, zone: str | None, order: str | None) -> int | None:
    if g.get("sa"):
        if order not in ("dmy", "mdy"):
            return None
        g["d"], g["m"] = (g["sa"], g["sb"]) if order == "dmy" else (g["sb"], g["sa"])
    if g.get("mon"):
        if (k := _word(g["mon"], MONTHS)) is None:
            return None
        g["m"] = k + 1
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    us = int(((g["f"] or "") + "000000")[:6])
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"][0] in "Pp")
    if mi > 59 or s > 59 or h > 24 or (h == 24 and (mi or s or us)):
        return None
    try:
        day = datetime(int(g["y"]), 1, 1) + timedelta(days=int(g["doy"]) - 1) if g.get("doy") else datetime(int(g["y"]), int(g["m"]), int(g["d"]))
        if g.get("doy") and (day.year != int(g["y"])):
            return None
        wall = day + timedelta(hours=h, minutes=mi, seconds=s, microseconds=us)
    except (ValueError, OverflowError):
        return None
    if g.get("wd") and _word(g["wd"], DAYS) != day.weekday():
        return None
    return _zoned(wall, g.get("zone"), zone)


def _zoned(wall: datetime, own: str | None, zone: str | None) -> int | None:
    if not own:
        return _local(wall, _zone(zone) if zone else None)
    own = own.strip("[]()")
    if own in ("Z", "z") or own.upper() in ("UTC", "GMT"):
        return _micros(wall)
    if m := _OFFSET.fullmatch(own):
        hours, minutes = int(m[2]), int(m[3] or 0)
        if minutes > 59 or hours * 60 + minutes > 18 * 60:
            return None
        offset = timedelta(hours=hours, minutes=minutes)
        return _micros(wall - offset if m[1] == "+" else wall + offset)
    if "/" in own:
        return _local(wall, _zone(own))
    offset = _abbreviations(zone).get(own) if zone else None
    return None if offset is None else _micros(wall - timedelta(seconds=offset))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, zones, orders = (b.column(k).to_pylist() for k in ("text", "zone", "date_order"))
        got = pa.array(map(parse_time, texts, zones, orders), pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("text", "zone", "date_order", "n")), got], ["text", "zone", "date_order", "n", "utc_us"])


_DICT = "text string, zone string, date_order string, n long, utc_us long"


def time_dictionary(rows: DataFrame, store: str | None = None) -> DataFrame:
    """rows(text, zone, date_order) -> the dictionary (text, zone, date_order, n, utc_us) with every distinct triple.

    With `store`, a folder in shared storage, only triples missing there are parsed; they are appended to it, and n
    counts the rows at that time. Null texts have no entry; null zones and orders are values of their own.
    """
    distinct = rows.where(F.col("text").isNotNull()).groupBy("text", "zone", "date_order").agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    if store is None:
        return materialize(distinct.mapInArrow(_parse_batches, _DICT), "times")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        have = spark.read.schema(_DICT).parquet(store)
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("text", "zone", "date_order")]
        distinct = distinct.alias("a").join(have.alias("b"), same[0] & same[1] & same[2], "left_anti")
    distinct.mapInArrow(_parse_batches, _DICT).write.mode("append").parquet(store)
    return spark.read.schema(_DICT).parquet(store)


def normalise_times(rows: DataFrame, store: str | None = None, hot: int = HOT_TEXT) -> DataFrame:
    """Add utc_us to rows(text, zone, date_order, ...): null where the text stands for no or more than one instant.

    Rows of texts that occur `hot` times or more are joined by a size-checked broadcast, so no text is one task's load. A
    column utc_us that the rows already have is replaced.
    """
    rows = rows.drop("utc_us")
    known = time_dictionary(rows, store)
    keys = ("text", "zone", "date_order")
    named = lambda df: df.select(*(F.col(k).alias(f"_{k}") for k in keys), "utc_us")
    on = F.col("text") == F.col("_text")
    for k in keys[1:]:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    keep = [*rows.columns, "utc_us"]
    # Rows without a text never reach a join: they would meet in one task for each zone.
    blank = rows.where(F.col("text").isNull()).withColumn("utc_us", F.lit(None).cast("long")).select(*keep)
    rows = rows.where(F.col("text").isNotNull())
    often = named(known.where(F.col("n") >= hot))
    if often.isEmpty():
        return rows.join(named(known), on, "left").select(*keep).unionByName(blank)
    often = small(often)
    return rows.join(often, on).select(*keep).unionByName(rows.join(often, on, "left_anti").join(named(known.where(F.col("n") < hot)), on, "left").select(*keep)).unionByName(blank)


def _rows(spark, d: str) -> DataFrame:
    zones = small(table(spark, d, "gauges").select("station", F.col("tz").alias("zone"), "date_order"))
    feed = table(spark, d, "gauge_feed").select(F.lit("feed").alias("origin"), F.col("feed_id").alias("row_id"), "station", F.col("time").alias("text"))
    ledger = table(spark, d, "ledger").select(F.lit("ledger").alias("origin"), F.col("entry_id").alias("row_id"), "station", F.col("time").alias("text"))
    return feed.unionByName(ledger).join(zones, "station", "left").select("origin", "row_id", "text", "zone", "date_order")


def p3_found(spark, d: str) -> DataFrame:
    """The UTC instant of every row of gauge_feed and ledger whose time text stands for exactly one."""
    return normalise_times(_rows(spark, d)).where(F.col("utc_us").isNotNull()).select("origin", "row_id", "utc_us")


def p3_unread(spark, d: str) -> DataFrame:
    """How many rows of each origin have a text with and without an instant, and no text."""
    kind = F.when(F.col("text").isNull(), "missing").when(F.col("utc_us").isNull(), "no instant").otherwise("instant")
    return normalise_times(_rows(spark, d)).groupBy("origin", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]{1,6})?(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9])$"


def p3_iso(spark, d: str) -> DataFrame:
    """The instants of the rows whose text is ISO 8601 with seconds and a zone: the part of the result that plain SQL can check."""
    return normalise_times(_rows(spark, d)).where(F.col("utc_us").isNotNull() & F.col("text").rlike(ISO)).select("origin", "row_id", "utc_us")


QUERIES = {"p3_found": p3_found, "p3_unread": p3_unread, "p3_iso": p3_iso}
#: Zone rules and the many formats are beyond plain SQL; tests compare with fixed cases and a brute-force reading.
SQL = {
    "p3_iso": f"""WITH x AS (SELECT 'feed' AS origin, feed_id AS row_id, time FROM gauge_feed UNION ALL SELECT 'ledger', entry_id, time FROM ledger)
SELECT origin, row_id, epoch_us(try_cast(time AS TIMESTAMPTZ)) AS utc_us FROM x WHERE regexp_matches(time, '{ISO}') AND try_cast(time AS TIMESTAMPTZ) IS NOT NULL""",
}
