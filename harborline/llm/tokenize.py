"""Encoding whole texts with a public byte-level BPE (problem 7), by a tokenization automaton.

The automaton runs over tokens: its states are what may follow a token, its arcs the tokens. It starts as one state with an arc
for each byte; each merge, in order of rank, is compiled in by a gadget: after the left part a new state without the arc of the
right part, and beside each arc of the left part an arc of the merged token. A sequence of tokens is the encoding of its
bytes exactly if the automaton accepts it. A pre-split word is encoded by following the arcs that spell it; each position is
reached by one arc, whose labels are the ids. Decoding emits the labels' bytes.

Words are pre-split by the tokenizer's own pattern and encoded once per worker; a bounded memo keeps them. No shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.common import table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's pre-splitting pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers; beyond it the memo starts anew. Ids do not depend on it.
MEMO_WORDS = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def read_vocabulary(path: str) -> tuple[list[tuple[int, bytes]], list[tuple[int, int, int]]]:
    """((id, bytes) of the single bytes, (left, right, merged) ids in order of rank) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, ids = byte_letters(), model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return [(ids[c], bytes([b])) for c, b in letters.items() if c in ids], [(ids[a], ids[b], ids[a + b]) for a, b in pairs]


class Automaton:
    """Tokens as labels; state[t] is where every arc of token t leads."""

    def __init__(self, singles: list[tuple[int, bytes]], merges: list[tuple[int, int, int]]) -> None:
        self.text = dict(singles)
        self.state = {t: 0 for t, _ in singles}
        # Of each token: when it came and its left part. Of each state: its original, when it was copied, the arc it lacks.
        self.born = {t: -1 for t, _ in singles}
        self.left: dict[int, int] = {}
        self.origin, self.copied, self.lacks = [0], [-1], [-1]
        for rank, (a, b, c) in enumerate(merges):
            self._gadget(rank, a, b, c)
        self._table: dict[int, bool] = {}
        self._trie: list[dict[int, int]] = [{}]
        self._ends: list[int] = [-1]
        for t, word in self.text.items():
            self._spell(t, word)

    def _gadget(self, rank: int, a: int, b: int, c: int) -> None:
        if c in self.born:
            return
        # The merged token leads where the right part led before; the left part leads to a copy without the right part.
        self.state[c] = self.state[b]
        self.born[c], self.left[c], self.text[c] = rank, a, self.text[a] + self.text[b]
        self.origin.append(self.state[a])
        self.copied.append(rank)
        self.lacks.append(b)
        self.state[a] = len(self.origin) - 1

    def _spell(self, t: int, word: bytes) -> None:
        node = 0
        for b in word:
            nxt = self._trie[node].get(b)
            if nxt is None:
                nxt = self._trie[node][b] = len(self._trie)
                self._trie.append({})
                self._ends.append(-1)
            node = nxt
        self._ends[node] = t

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc of the token; answers fill the transition table."""
        key = state << 20 | token
        known = self._table.get(key)
        if known is None:
            s, u, has = state, token, True
            while s:
                if self.born[u] < self.copied[s]:  # an arc of the original, unless it is the one taken out
                    if u == self.lacks[s]:
                        has = False
                        break
                    s = self.origin[s]
                else:  # added beside the arc of its left part
                    u = self.left[u]
            self._table[key] = known = has
            if len(self._table) > 2_000_000:
                self._table.clear()
        return known

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one accepted path that spells the word."""
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        trie, ends, state, arc = self._trie, self._ends, self.state, self.arc
        for j in range(n):
            if j and last[j] < 0:
                continue
            here = state[last[j]] if j else 0
            node = 0
            for i in range(j, n):
                node = trie[node].get(word[i], -1)
                if node < 0:
                    break
                t = ends[node]
                if t >= 0 and last[i + 1] < 0 and arc(here, t):
                    last[i + 1], back[i + 1] = t, j
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))


class _Memo(dict):
    """Word -> its ids as packed 32-bit integers."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = np.array(self.automaton.encode(word.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        # Very long words recur rarely; the memo stays small in bytes, too.
        if len(word) <= 64:
            self[word] = got
        return got


_BUILT: dict[str, tuple[Automaton, _Memo]] = {}


def _built(name: str, vocabulary: tuple) -> tuple[Automaton, _Memo]:
    """One automaton and memo per worker process."""
    if name not in _BUILT:
        one = Automaton(*vocabulary)
        _BUILT[name] = one, _Memo(one)
    return _BUILT[name]


def _packed(texts: pa.Array, memo: _Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's begin and end."""
    split = regex.compile(PATTERN).findall
    parts = [b"".join(map(memo.__getitem__, split(t))) if t else b"" for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return np.frombuffer(b"".join(parts), np.int32), ends


def encode_texts(df: DataFrame, rid: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, ids): one row per row with the ids of its whole text, without special tokens.

    Null and empty texts give an empty list; the strings of special tokens are ordinary text; repeated rows repeat. `path` is read
    on the driver; the vocabulary (a few megabytes, whatever the data) is broadcast.
    """
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _built(path, shipped.value)
        for b in batches:
            flat, ends = _packed(b.column("text"), memo)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], ["id", "ids"])

    use = df.select(F.col(rid).alias("id"), F.col(text).alias("text"))
    return use.mapInArrow(run, f"id {use.schema['id'].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", out: str = "tokens") -> DataFrame:
    """The rows with `text` replaced by its number of tokens in a column `out` (0 for null and empty)."""
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    keep = [c for c in df.columns if c not in (text, out)]
    use = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _built(path, shipped.value)
        for b in batches:
            _, ends = _packed(b.column("_text"), memo)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(ends), pa.int64())], [*keep, out])

    kinds = ", ".join(f"`{c}` {use.schema[c].dataType.simpleString()}" for c in keep)
    return use.mapInArrow(run, f"{kinds}, `{out}` long")


def decode_ids(df: DataFrame, rid: str, ids: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, text): the text that the ids spell; null for null ids, bytes that are no UTF-8 as U+FFFD."""
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, _ = _built(path, shipped.value)
        for b in batches:
            texts = [None if x is None else one.decode(x).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    use = df.select(F.col(rid).alias("id"), F.col(ids).alias("ids"))
    return use.mapInArrow(run, f"id {use.schema['id'].dataType.simpleString()}, text string")


def returns(df: DataFrame, rid: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(id, tokens, same): whether the ids of each text spell it again; encoded and decoded where it is read.

    Null counts as empty. Lone surrogates, which no UTF-8 text holds, are kept as they are.
    """
    shipped = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, memo = _built(path, shipped.value)
        for b in batches:
            flat, ends = _packed(b.column("text"), memo)
            ids = flat.tolist()
            same = [one.decode(ids[a:z]) == (t or "").encode("utf-8", "surrogatepass") for t, a, z in zip(b.column("text").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(ends), pa.int64()), pa.array(same)], ["id", "tokens", "same"])

    use = df.select(F.col(rid).alias("id"), F.col(text).alias("text"))
    return use.mapInArrow(run, f"id {use.schema['id'].dataType.simpleString()}, tokens long, same boolean")


def p7_ids(spark, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


def p7_returned(spark, d: str) -> DataFrame:
    """Documents whose ids decode to their text, by whether they do."""
    return returns(table(spark, d, "documents"), "doc_id", "text").groupBy("same").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p7_ids": p7_ids, "p7_returned": p7_returned}
SQL = {"p7_returned": "SELECT TRUE AS same, count(*) AS documents FROM documents"}
