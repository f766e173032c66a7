"""Separating records that fail to parse, with the first reason (problem 5).

A schema gives one anchored regular expression for whole records; records that match it (and pass the numeric bounds) are
valid and never leave the JVM. The few others go in Arrow batches through incremental patterns: balanced quotes, number of
fields, then the pattern of the first field, of the first two, and so on; the first that fails names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import iso_instant, table

#: Any field. Possessive, so that neither engine backtracks.
ANY = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
#: Names of a register that are written into the pattern; a longer register is joined instead.
NAMES = 20_000
#: The JVM's engine recurses once for each doubled quote; records with more go to the second step unseen.
DOUBLED = 500

_DAY = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29"
TIME = rf"(?!0000)(?:[0-9]{{4}}-{_DAY}|{_LEAP})[T ](?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{{1,6}})?)?(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
NUMBER = r"(?:[+-]?(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?)?"


@dataclass(frozen=True)
class Field:
    """A field's name and value pattern (None: anything); low and high bound its number where it is not empty."""

    name: str
    pattern: str | None = None
    low: float | None = None
    high: float | None = None

    def regex(self, group: bool = False) -> str:
        if self.pattern is None:
            return ANY
        value = f"({self.pattern})" if group else f"(?:{self.pattern})"
        return rf'(?:"{value}"|[ ]*+{value}[ ]*+)'


def alternation(words: list[str]) -> str:
    """A regular expression of exactly these words, shared beginnings written once."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [re.escape(c) + write(below) for c, below in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return body + ("?" if "" in node else "")

    return write(tree) if tree else r"(?!)"


def row_regex(schema: list[Field]) -> str:
    """The anchored regular expression of a valid record."""
    return r"\A" + ",".join(f.regex() for f in schema) + r"\z"


def _bounded(schema: list[Field], line: str) -> F.Column:
    """Whether every bounded number of a matching record lies within its bounds."""
    ok = F.lit(True)
    for k, f in enumerate(schema):
        if f.low is not None:
            lead = r"\A" + "".join(x.regex() + "," for x in schema[:k]) + f.regex(group=True)
            text = F.concat(F.regexp_extract(line, lead, 1), F.regexp_extract(line, lead, 2))
            ok = ok & ((text == "") | F.coalesce(text.try_cast("double").between(f.low, f.high), F.lit(False)))
    return ok


def _heavy(line: str) -> F.Column:
    return F.length(line) - F.length(F.replace(F.col(line), F.lit('""'), F.lit(""))) > 2 * DOUBLED


def is_valid(line: str, schema: list[Field]) -> F.Column:
    """True for valid records; false for faulty ones and for those left to the second step; false for null."""
    ok = F.when(_heavy(line), F.lit(False)).when(F.col(line).rlike(row_regex(schema)), _bounded(schema, line)).otherwise(False)
    return F.coalesce(ok, F.lit(False))


class Diagnosis:
    """The incremental patterns of a schema; `reason(record)` gives the first that fails, or None."""

    def __init__(self, schema: list[Field]) -> None:
        self.schema = schema
        self.quotes = re.compile(rf"{ANY}(?:,{ANY})*+")
        self.width = re.compile(",".join([ANY] * len(schema)))
        self.prefixes = [re.compile("".join(f.regex() + "," for f in schema[:k]) + schema[k].regex(group=True) + r"(?:,|\Z)") for k in range(len(schema)) if schema[k].pattern is not None]
        self.checked = [f for f in schema if f.pattern is not None]

    def reason(self, record: str | None) -> str | None:
        if record is None:
            return "width"
        if not self.quotes.fullmatch(record):
            return "quote"
        if not self.width.fullmatch(record):
            return "width"
        for f, prefix in zip(self.checked, self.prefixes, strict=True):
            if not (m := prefix.match(record)):
                return f.name
            if f.low is not None and (text := m[1] or m[2] or "") and not f.low <= float(text) <= f.high:
                return f.name
        return None


def faulty_rows(df: DataFrame, line: str, rid: str, schema: list[Field], register: tuple[str, DataFrame] | None = None) -> DataFrame:
    """(id, reason, line) of every faulty record, with the first reason that applies.

    A null record has no fields ('width'), an empty one has one empty field. Repeated records are judged each on their own.
    register: (field, table of one column): the field, which has no pattern of its own, must hold one of these values; they are
    joined, so there may be any number of them.
    """
    names = [f.name for f in schema]
    joined = register is not None
    at = names.index(register[0]) if joined else 0
    rows = df.select(F.col(rid).alias("id"), F.col(line).alias("line"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, reason string, line string, value string"

    def diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, one = Diagnosis(schema), re.compile(f"({ANY})(?:,|\\Z)")
        for b in batches:
            lines = b.column("line").to_pylist()
            why = [first.reason(x) for x in lines]
            value = [None if not joined or w in ("quote", "width") else _plain(one.findall(x)[at]) for x, w in zip(lines, why, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(why, pa.string()), b.column("line"), pa.array(value, pa.string())], ["id", "reason", "line", "value"])

    judged = rows.where(~is_valid("line", schema)).mapInArrow(diagnose, kind)
    if not joined:
        return judged.where(F.col("reason").isNotNull()).drop("value")
    # Records valid but for the register stay in the JVM; a reason of an earlier field comes before the register's.
    judged = judged.unionByName(df.where(is_valid(line, schema)).select(F.col(rid).alias("id"), F.lit(None).cast("string").alias("reason"), F.col(line).alias("line"), _field(schema, at, line).alias("value")))
    known = register[1].select(F.col(register[1].columns[0]).alias("_known")).where("_known IS NOT NULL").distinct()
    early = F.coalesce(F.col("reason").isin(["quote", "width", *names[:at]]), F.lit(False))
    reason = F.when(early, F.col("reason")).when(F.col("_known").isNull(), F.lit(register[0])).otherwise(F.col("reason"))
    return judged.join(known, F.col("value") == F.col("_known"), "left").select("id", reason.alias("reason"), "line").where(F.col("reason").isNotNull())


def _plain(text: str) -> str:
    """A field's text without its quotes, or without the blanks around it."""
    return text[1:-1].replace('""', '"') if text[:1] == '"' else text.strip(" ")


def _field(schema: list[Field], k: int, line: str) -> F.Column:
    """Text of field k of a valid record, unquoted and trimmed."""
    lead = r"\A" + "".join(ANY + "," for _ in range(k)) + f"({ANY})"
    text = F.regexp_extract(line, lead, 1)
    return F.when(text.startswith('"'), F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(F.trim(text))


def valid_rows(df: DataFrame, line: str, keep: list[str], schema: list[Field], register: tuple[str, DataFrame] | None = None) -> DataFrame:
    """The valid records, split into text fields named as in the schema, beside the columns in `keep`.

    Records with more than DOUBLED doubled quotes are judged and split in the second step. register: as in faulty_rows().
    """
    fast = df.where(is_valid(line, schema)).select(*keep, *(_field(schema, k, line).alias(f.name) for k, f in enumerate(schema)))
    rest = df.where(_heavy(line)).select(*keep, line)
    names = [f.name for f in schema]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, one = Diagnosis(schema), re.compile(f"({ANY})(?:,|\\Z)")
        for b in batches:
            good = [k for k, x in enumerate(b.column(line).to_pylist()) if x is not None and first.reason(x) is None]
            cut = [[_plain(v) for v in one.findall(b.column(line)[k].as_py())[: len(names)]] for k in good]
            kept = [b.column(c).take(pa.array(good, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x[k] for x in cut], pa.string()) for k in range(len(names)))], [*keep, *names])

    out = fast.unionByName(rest.mapInArrow(split, fast.schema))
    return out if register is None else out.join(register[1].select(F.col(register[1].columns[0]).alias(register[0])).distinct(), register[0], "left_semi")


def gauge_schema(stations: list[str] | None) -> list[Field]:
    """The schema of gauge records; without a list of stations any text is one (a register decides)."""
    return [Field("station", None if stations is None else alternation(stations)), Field("time", TIME), Field("height", NUMBER, -20.0, 20.0), Field("source"), Field("note")]


def gauge_rules(register: DataFrame, names: int = NAMES) -> tuple[list[Field], tuple[str, DataFrame] | None]:
    """The schema for a register (one column) of stations, and the register itself if it is too long for a pattern."""
    some = [r[0] for r in register.where(F.col(register.columns[0]).isNotNull()).distinct().limit(names + 1).collect()]
    return (gauge_schema(some), None) if len(some) <= names else (gauge_schema(None), ("station", register))


def p5_found(spark, d: str) -> DataFrame:
    """Every faulty record of gauge_lines with its reason."""
    rules = gauge_rules(table(spark, d, "gauges").select("station"))
    return faulty_rows(table(spark, d, "gauge_lines"), "line", "row_id", *rules).select(F.col("id").alias("row_id"), "reason")


def p5_loaded(spark, d: str) -> DataFrame:
    """The valid records of gauge_lines as typed rows; times without a zone are UTC."""
    rules = gauge_rules(table(spark, d, "gauges").select("station"))
    rows = valid_rows(table(spark, d, "gauge_lines"), "line", ["row_id"], *rules)
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    return rows.select("row_id", "station", iso_instant("time").alias("utc_us"), none("height").cast("double").alias("height"), none("source").alias("source"), none("note").alias("note"))


QUERIES = {"p5_found": p5_found, "p5_loaded": p5_loaded}
_F = '(?:"(?:[^"]|"")*"|[^",]*)'
_RAW = ", ".join(f"regexp_extract(line, '^{(_F + ',') * k}({_F})', 1) AS r{k}" for k in range(5))
_TEXT = ", ".join(f"CASE WHEN r{k} LIKE '\"%' THEN replace(substr(r{k}, 2, length(r{k}) - 2), '\"\"', '\"') ELSE trim(r{k}, ' ') END AS f{k}" for k in range(5))
_NUMBER_SQL = r"[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
_JUDGED = rf"""q AS (SELECT row_id, coalesce(line, '') AS line FROM gauge_lines), f AS (SELECT *, {_TEXT} FROM (SELECT *, {_RAW} FROM q)),
j AS (SELECT *, CASE WHEN NOT regexp_full_match(line, '{_F}(?:,{_F})*') THEN 'quote' WHEN NOT regexp_full_match(line, '{_F},{_F},{_F},{_F},{_F}') THEN 'width'
  WHEN f0 NOT IN (SELECT station FROM gauges WHERE station IS NOT NULL) THEN 'station'
  WHEN NOT regexp_full_match(f1, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{{1,6}})?)?(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?') OR try_cast(substr(f1, 1, 10) AS DATE) IS NULL OR substr(f1, 1, 4) = '0000' THEN 'time'
  WHEN f2 <> '' AND NOT (regexp_full_match(f2, '{_NUMBER_SQL}') AND coalesce(try_cast(ltrim(f2, '+') AS DOUBLE) BETWEEN -20 AND 20, FALSE)) THEN 'height' END AS reason FROM f)"""
SQL = {
    "p5_found": f"WITH {_JUDGED} SELECT row_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_loaded": f"""WITH {_JUDGED} SELECT row_id, f0 AS station, epoch_us(CAST(CASE WHEN regexp_matches(f1, '(Z|[+-][0-9:]{{5}})$') THEN f1 ELSE f1 || 'Z' END AS TIMESTAMPTZ)) AS utc_us, CAST(nullif(ltrim(f2, '+'), '') AS DOUBLE) AS height, nullif(f3, '') AS source, nullif(f4, '') AS note FROM j WHERE reason IS NULL""",
}
