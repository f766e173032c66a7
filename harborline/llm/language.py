"""Languages of documents and of their mixed-language segments (problem 9), by prediction by partial matching.

For each language the labelled sample gives a byte context tree of orders 0 to ORDER with PPM's method C: in a context seen
n times with d distinct followers, a follower seen c times costs -log2 c/(n+d) bits, an unseen one -log2 d/(n+d) bits for the
escape to the next shorter context, down to a uniform byte. The statistics are then frozen, so the cost of a byte depends only
on the ORDER bytes before it: the costs of all windows seen in any language are tabulated for all languages at once, and
those of other windows follow from the escape costs of their contexts. Cues are scored by table look-ups over whole Arrow
batches, smoothed along the document by the best path with a price for switching, and counted by characters. No shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import table

LANGUAGES = "da de el en es fr it ja nl pl pt ru sv uk".split()
#: Names a label may use, by language: ISO 639 codes of three letters and the English name (fixed values).
NAMES = {
    "da": "dan danish", "de": "deu ger german", "el": "ell gre greek", "en": "eng english", "es": "spa spanish", "fr": "fra fre french", "it": "ita italian",
    "ja": "jpn japanese", "nl": "nld dut dutch", "pl": "pol polish", "pt": "por portuguese", "ru": "rus russian", "sv": "swe swedish", "uk": "ukr ukrainian",
}
LABELS = {name: code for code, names in NAMES.items() for name in (code, *names.split())}

ORDER = 5
#: Bounds of the labelled sample: documents and bytes of dialogue per language. Every document is then scored.
SAMPLE_DOCS, SAMPLE_BYTES = 150, 120_000
#: Longer documents (in bytes) are not drawn for the fit, so that what reaches the driver is bounded; they are labelled like all.
SAMPLE_TEXT = 1_000_000
#: Bits that a change of language from line to line costs.
SWITCH_BITS = 9.0
SHARE = 0.2

_TIMING = re.compile(r"^[ \t﻿]*(?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3}[ \t]*-{1,2}>[^\n]*(?:\n|\Z)", re.M)
_MARKUP = re.compile(r"<[^<>\n]{1,120}>|\{\\?[^{}\n]{0,80}\}")
_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\*[^*\n]*\*|[♪♫][^♪♫]*(?:[♪♫]|$)|^[ \t]*([�?#]) [^\n]* \1[ \t]*$", re.M)
_ODD = re.compile(r"[\[(*♪♫#�?]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_SPEAKER = re.compile(r"^([ \t]*[-–—]?[ \t]*)([^\n:：]{1,30})[:：][ \t]*", re.M)
_ADVERT = re.compile(r"://|www\.|\w@\w|\b[\w-]{2,}\.(?:com|net|org|info|example|tv|io)\b", re.I)
_DOMAIN = re.compile(r"[\w-]{3,}\.[A-Za-z|0-9]{2,12}\W*\Z")
_CREDIT = re.compile(r"^\W*(?:re)?sync\w*\W|^\W*(?:subtitle[sd]|captions?|captioned|translated|transcribed|corrected)\b.*\bby\b", re.I)
_LETTER = re.compile(r"[^\W\d_]")
_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")
_WINDOWS = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def label_language(label: str | None) -> str | None:
    """The language a label names by ISO 639 code, with or without region, or English name, in any case; else None."""
    if label is None:
        return None
    low = label.strip().lower()
    return LABELS.get(low) or (LABELS.get(re.split(r"[-_]", low)[0]) if re.fullmatch(r"[a-z]{2,3}[-_][a-z0-9_-]{2,12}", low) else None)


def repair(text: str) -> str:
    """Undo UTF-8 read as Windows-1252, line by line, up to twice; other text stays."""
    for _ in range(2):
        if not _MOJIBAKE.search(text):
            break
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if _MOJIBAKE.search(line):
                try:
                    lines[k] = line.translate(_WINDOWS).encode("latin-1").decode("utf-8")
                except UnicodeError:
                    pass  # no such text: score_as_meant() tries other encodings
        text = "\n".join(lines)
    return text


def _unnamed(m: re.Match) -> str:
    return m[1] if m[2].isupper() else m[0]


def dialogue(text: str | None) -> list[tuple[int, str]]:
    """(place of the cue, a sentence of its dialogue within a line) of all that have letters; adverts, credits
    and sound descriptions left out.

    Text without any timing line counts as one cue a line.
    """
    if not text or text.isspace():
        return []
    text = text.replace("\r", "")
    parts = _TIMING.split(repair(text))
    timed = len(parts) > 1
    out = []
    for k, cue in enumerate(parts[1:] if timed else text.split("\n")):
        if timed:
            cue = cue.rstrip()
            head, _, tail = cue.rpartition("\n")
            if tail.strip().isdigit():  # the next cue's number
                cue = head
        if ("." in cue or "@" in cue) and (_ADVERT.search(cue) or _DOMAIN.search(cue)):
            continue
        if _CREDIT.match(cue):
            continue
        if "<" in cue or "{" in cue:
            cue = _MARKUP.sub("", cue)
        if ":" in cue or "：" in cue:
            cue = _SPEAKER.sub(_unnamed, cue)
        if _ODD.search(cue):
            cue = _SOUND.sub(" ", cue)
        for line in cue.split("\n"):
            for piece in _SENTENCE.split(line.strip(" \t-–—﻿")):
                if piece and _LETTER.search(piece):
                    out.append((k, piece))
    return out


class _Table:
    """Open-addressing hash table of 64-bit keys for whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys, self.at = np.full(size, np.uint64(2**64 - 1)), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.at[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is none."""
        slot = self._slot(keys)
        out = self.at[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(wrong):
            slot_w = (slot[wrong] + 1) & (len(self.keys) - 1)
            slot[wrong] = slot_w
            out[wrong] = self.at[slot_w]
            wrong = wrong[(self.keys[slot_w] != keys[wrong]) & (out[wrong] >= 0)]
        return out


def windows(data: np.ndarray, length: int) -> np.ndarray:
    """The last `length` bytes up to each byte as one number; before the beginning lie zeros."""
    w = np.zeros(len(data), np.uint64)
    for k in range(length - 1, -1, -1):
        w <<= np.uint64(8)
        w[k:] |= data[: len(data) - k]
    return w


class Models:
    """Frozen code lengths of all languages: for each window length a table of windows and one of contexts."""

    def __init__(self, samples: list[bytes], order: int = ORDER) -> None:
        n = len(samples)
        self.order = order
        self.codes: list[_Table] = []
        self.escapes: list[_Table] = []
        self.code_bits: list[np.ndarray] = []
        self.escape_bits: list[np.ndarray] = []
        data = [np.frombuffer(s, np.uint8).astype(np.uint64) for s in samples]
        lower_keys = lower_bits = None
        for length in range(1, order + 2):
            seen = [np.unique(windows(x, length)[length - 1 :], return_counts=True) if len(x) >= length else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in data]
            keys = np.arange(256, dtype=np.uint64) if length == 1 else np.unique(np.concatenate([k for k, _ in seen]))
            contexts = np.unique(keys >> np.uint64(8))
            bits, out = np.zeros((len(keys), n), np.float32), np.zeros((len(contexts), n), np.float32)
            place = np.searchsorted(contexts, keys >> np.uint64(8))
            base = np.full((len(keys), n), 8.0, np.float32) if length == 1 else lower_bits[np.searchsorted(lower_keys, keys & np.uint64(256 ** (length - 1) - 1))]
            for j, (k, c) in enumerate(seen):
                at = np.searchsorted(contexts, k >> np.uint64(8))
                total, kinds = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                known = total > 0
                out[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                bits[:, j] = base[:, j] + out[place, j]
                mine = np.searchsorted(keys, k)
                bits[mine, j] = -np.log2(c / (total[at] + kinds[at]))
            self.codes.append(_Table(keys))
            self.code_bits.append(bits)
            self.escapes.append(_Table(contexts))
            self.escape_bits.append(out)
            lower_keys, lower_bits = keys, bits

    def costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in bits of each stretch of bytes from starts[k] on, under each language."""
        w = windows(data.astype(np.uint64), self.order + 1)
        top = self.codes[self.order].find(w)
        hit = top >= 0
        each = self.code_bits[self.order][np.where(hit, top, 0)]
        left = np.flatnonzero(~hit)
        extra = np.zeros((len(left), each.shape[1]), np.float32)
        length = self.order + 1
        while len(left):
            # The context of the longer window escapes; the shorter window codes, or escapes in turn.
            context = self.escapes[length - 1].find((w[left] >> np.uint64(8)) & np.uint64(256 ** (length - 1) - 1))
            extra += np.where((context >= 0)[:, None], self.escape_bits[length - 1][np.maximum(context, 0)], np.float32(0))
            length -= 1
            got = self.codes[length - 1].find(w[left] & np.uint64(256**length - 1))
            ok = got >= 0
            each[left[ok]] = extra[ok] + self.code_bits[length - 1][got[ok]]
            left, extra = left[~ok], extra[~ok]
        return np.add.reduceat(each, starts, axis=0) if len(starts) else np.zeros((0, each.shape[1]), np.float32)


def score(models: Models, cues: list[str], chunk: int = 400_000) -> np.ndarray:
    """Bits of each cue under each language; a line feed stands before each."""
    out: list[np.ndarray] = [np.zeros((0, len(LANGUAGES)), np.float32)]
    part: list[bytes] = []
    held = 0
    for cue in [*cues, None]:
        if cue is None or held > chunk:
            if part:
                sizes = np.array([len(p) for p in part])
                out.append(models.costs(np.frombuffer(b"".join(part), np.uint8), np.cumsum(sizes) - sizes))
            part, held = [], 0
        if cue is not None:
            # A lost character becomes one byte that no sample has, so it costs every language alike and little.
            part.append(b"\n" + cue.replace("\ufffd", "\0").encode("utf-8", "replace"))
            held += len(part[-1])
    return np.concatenate(out)


#: Encodings that bytes may have been read in, and those they may have been written in.
MISREAD = [("cp1252", ("cp1253", "cp1251", "koi8-u", "cp1250")), ("cp1251", ("koi8-u", "utf-8")), ("koi8-u", ("cp1251",)), ("cp1253", ("cp1251",)), ("cp1250", ("cp1252",))]
#: Lines costing more bits a character are read again in other encodings; a reading is taken if it costs less than this part.
POOR_BITS, BETTER = 2.6, 0.65


def _readings(line: str) -> list[str]:
    """What the line would say if its bytes had been written in another encoding than they were read in."""
    out = []
    for read, written in MISREAD:
        try:
            raw = line.translate(_WINDOWS).encode("latin-1") if read == "cp1252" else line.encode(read)
        except UnicodeError:
            continue
        for w in written:
            try:
                out.append(raw.decode(w))
            except UnicodeError:
                continue
    return [x for x in dict.fromkeys(out) if x != line]


def score_as_meant(models: Models, cues: list[str]) -> np.ndarray:
    """score(), but of the best reading of lines in a wrong encoding."""
    bits = score(models, cues)
    size = np.array([len(c) for c in cues])
    poor = [k for k in np.flatnonzero(bits.min(axis=1) > POOR_BITS * size).tolist() if not cues[k].isascii()] if len(cues) else []
    tried, owner = [], []
    for k in poor:
        for x in _readings(cues[k]):
            tried.append(x)
            owner.append(k)
    if tried:
        again = score(models, tried)
        for k, row in zip(owner, again, strict=True):
            if row.min() < BETTER * bits[k].min():
                bits[k] = row
    return bits


def best_paths(bits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The language of each cue on its document's cheapest path; doc: number of each cue's document, ascending."""
    n = len(doc)
    if not n:
        return np.zeros(0, int)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    cost, came = bits.astype(np.float64), np.zeros(bits.shape, np.int8)
    own = np.arange(bits.shape[1])
    for k in range(1, int(size[0])):  # the k-th cue of all documents that long
        at = first[: np.searchsorted(-size, -k, "left")] + k
        before = cost[at - 1]
        least = before.argmin(axis=1)
        switch = before[np.arange(len(at)), least][:, None] + SWITCH_BITS
        stay = before <= switch
        came[at] = np.where(stay, own, least[:, None])
        cost[at] += np.where(stay, before, switch)
    path = np.zeros(n, int)
    last = first + size - 1
    path[last] = cost[last].argmin(axis=1)
    for k in range(int(size[0]) - 1, 0, -1):
        at = first[: np.searchsorted(-size, -k, "left")] + k
        path[at - 1] = came[at, path[at]]
    return path


def label_column(c: str) -> F.Column:
    """label_language as a native expression."""
    low = F.lower(F.trim(F.col(c)))
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.element_at(names, low), F.when(low.rlike(r"^[a-z]{2,3}[-_][a-z0-9_-]{2,12}$"), F.element_at(names, F.regexp_extract(low, "^[a-z]+", 0))))


def fit(df: DataFrame, rid: str, text: str, label: str, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> Models:
    """Models from a bounded sample of labelled documents of at most SAMPLE_TEXT bytes, chosen by a hash of their ids.

    Labels are noisy, so the sample is halved; each half's cues are kept where the other half's models agree with the label.
    """
    named = df.select(F.col(rid).alias("id"), label_column(label).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # at most one row per language
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000
    got = named.where(drawn & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT)).select("id", "lang", "text").limit(2 * docs * len(LANGUAGES)).collect()
    halves: list[dict[str, list[str]]] = [{}, {}]
    used = dict.fromkeys(LANGUAGES, 0)
    for k, r in enumerate(sorted(got, key=lambda r: str(r["id"]))):
        if used[r["lang"]] > size:
            continue
        for _, cue in dialogue(r["text"]):
            halves[k % 2].setdefault(r["lang"], []).append(cue)
            used[r["lang"]] += len(cue.encode("utf-8", "replace")) + 1
    join = lambda cues: b"".join(b"\n" + c.encode("utf-8", "replace") for c in cues)
    rough = [Models([join(h.get(x, [])) for x in LANGUAGES], 3) for h in halves]
    clean: list[list[str]] = []
    for j, lang in enumerate(LANGUAGES):
        kept: list[str] = []
        for k in (0, 1):
            cues = halves[k].get(lang, [])
            trust = bool(halves[1 - k].get(lang))
            ok = score(rough[1 - k], cues).argmin(axis=1) == j if cues and trust else np.ones(len(cues), bool)
            kept += [c for c, good in zip(cues, ok, strict=True) if good]
        clean.append(kept)
    return Models([join(c) for c in clean])


def _documents(b: pa.RecordBatch, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of dialogue in the batch: document, place, characters, bits by language, language."""
    doc, place, cues = [], [], []
    for k, text in enumerate(b.column("text").to_pylist()):
        for at, cue in dialogue(text):
            doc.append(k)
            place.append(at)
            cues.append(cue)
    bits = score_as_meant(models, cues)
    docs = np.array(doc, int)
    return docs, np.array(place, int), np.array([len(c) for c in cues], int), bits, best_paths(bits, docs)


def languages(df: DataFrame, rid: str, text: str, label: str, models: Models) -> DataFrame:
    """(id, label_lang, lang, share, confidence, main, listed): one row per language with at least SHARE of a document's characters.

    Documents without dialogue (null, empty, blank, only adverts or sounds) have no row. confidence: 1 - 2^-(bits per character by
    which the language's cues fit it better than the next best). listed: the document has several languages or its label
    doesn't name the main one. Ties of the main language go to the first in code order.
    """
    shipped = df.sparkSession.sparkContext.broadcast(models)
    use = df.select(F.col(rid).alias("id"), label_column(label).alias("label_lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(LANGUAGES)
        for b in batches:
            docs, _, chars, bits, lang = _documents(b, shipped.value)
            spot = docs * n + lang
            count = np.bincount(spot, chars, b.num_rows * n).reshape(-1, n)
            two = np.partition(bits, 1, axis=1)[:, :2] if len(bits) else np.zeros((0, 2))
            mine = bits[np.arange(len(lang)), lang]
            lead = np.where(mine <= two[:, 0], two[:, 1], two[:, 0]) - mine
            ahead = np.bincount(spot, lead, b.num_rows * n).reshape(-1, n)
            total = count.sum(axis=1)
            d, k = np.nonzero((count >= SHARE * total[:, None]) & (count > 0))
            sure = 1 - np.exp2(-np.clip(ahead[d, k] / count[d, k], 0, 50))
            main = count.argmax(axis=1)
            named = np.array([LANGUAGES.index(x) if x else -1 for x in b.column("label_lang").to_pylist()], int)
            listed = (np.bincount(d, minlength=b.num_rows) > 1) | (named != main)
            rows = pa.array(d)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(rows), b.column("label_lang").take(rows), pa.array(np.array(LANGUAGES)[k].tolist(), pa.string()), pa.array(count[d, k] / total[d]), pa.array(sure), pa.array(main[d] == k), pa.array(listed[d])],
                ["id", "label_lang", "lang", "share", "confidence", "main", "listed"],
            )

    return use.mapInArrow(run, f"id {use.schema['id'].dataType.simpleString()}, label_lang string, lang string, share double, confidence double, main boolean, listed boolean")


def segments(df: DataFrame, rid: str, text: str, models: Models) -> DataFrame:
    """(id, first_cue, last_cue, lang, chars, confidence): the stretches of cues in one language of every document."""
    shipped = df.sparkSession.sparkContext.broadcast(models)
    use = df.select(F.col(rid).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, place, chars, bits, lang = _documents(b, shipped.value)
            if not len(docs):
                continue
            start = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (lang[1:] != lang[:-1])])
            end = np.r_[start[1:], len(docs)] - 1
            total, size = np.add.reduceat(bits, start, axis=0), np.add.reduceat(chars, start)
            mine = total[np.arange(len(start)), lang[start]]
            total[np.arange(len(start)), lang[start]] = np.inf
            sure = 1 - np.exp2(-np.clip((total.min(axis=1) - mine) / size, 0, 50))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(docs[start])), pa.array(place[start]), pa.array(place[end]), pa.array(np.array(LANGUAGES)[lang[start]].tolist(), pa.string()), pa.array(size), pa.array(sure.astype(float))],
                ["id", "first_cue", "last_cue", "lang", "chars", "confidence"],
            )

    return use.mapInArrow(run, f"id {use.schema['id'].dataType.simpleString()}, first_cue long, last_cue long, lang string, chars long, confidence double")


def p9_found(spark, d: str) -> DataFrame:
    """The languages of every document that has several or whose label doesn't name its main one."""
    docs = table(spark, d, "documents")
    got = languages(docs, "doc_id", "text", "lang", fit(docs, "doc_id", "text", "lang"))
    return got.where(F.col("listed")).select(F.col("id").alias("doc_id"), "lang")


def p9_segments(spark, d: str) -> DataFrame:
    """The stretches of cues in one language of every document, with confidence."""
    docs = table(spark, d, "documents")
    got = segments(docs, "doc_id", "text", fit(docs, "doc_id", "text", "lang"))
    return got.select(F.col("id").alias("doc_id"), "first_cue", "last_cue", "lang", "chars", F.round("confidence", 3).alias("confidence"))


QUERIES = {"p9_found": p9_found, "p9_segments": p9_segments}
SQL: dict[str, str] = {}
