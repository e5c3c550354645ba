"""Token counts (operator 1): a two-tier lookup on the map side.

The tokenizers handled here drop white space and never merge across it, so a
text's count is the sum of the counts of its white-space-delimited pre-tokens.
Tier one is a compact table of the corpus's frequent pre-tokens and their
lengths, which is broadcast; tier two is a cache in each Python worker, filled
by encoding the pre-tokens that tier one misses.  No pre-token is shuffled.

The frequent pre-tokens come from all rows: each task keeps a bounded counter
and hands on one row, a summary of its ``TASK_SUMMARY`` most frequent entries.
Summaries are merged up a tree, whole, ``MERGED`` at a time, and cut to ``FREQUENT``
each; the driver merges the last ``MERGED``.  The table only decides what is looked up where; counts never
depend on it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings inside a text are tokens, as is the library's default; texts of any
length are counted whole; repeated rows give repeated results; an empty table
gives an empty result; other columns pass through untouched unless they clash
with a result column, in which case the result column wins.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, slices, written

#: Entries of the broadcast table, at most: with pre-tokens of up to LONGEST bytes about 1 MB.
FREQUENT = 16_384
#: Frequent pre-tokens that a task hands on.
TASK_SUMMARY = 2_048
#: Summaries that one task of the tree, or the driver, merges: of at most 1 MB each.
MERGED = 64
#: Distinct pre-tokens that a task counts before it drops the rare ones.
TASK_COUNTED = 200_000
#: Entries of a worker's cache, and the longest pre-token (bytes) that a table or cache keeps.
CACHED, LONGEST = 400_000, 64


#: Words of letters before this one have lower-case forms of one character each, the same everywhere.
LAST_PLAIN = "\u0130"


def byte_chars() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself where printable, else the next from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


BYTE_CHARS = byte_chars()


def _lower_words(tokenizer_json: str) -> bool:
    """Whether the tokenizer composes and lower-cases texts, then takes runs of letters as words of byte-level BPE."""
    spec = json.loads(tokenizer_json)
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return kinds == ["NFC", "Replace", "Lowercase"] and len(pre) == 2 and "[\\p{L}]+" in str(pre[0]["pattern"]["Regex"]) and pre[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Lengths(dict):
    """Pre-token to number of tokens; encodes what it does not hold."""

    def __init__(self, tokenizer_json: str, frequent: dict[bytes, int]):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.frequent = frequent
        self.plain = self.tokenizer.model.tokenize if _lower_words(tokenizer_json) else None

    def _encoded(self, pretoken: bytes) -> int:
        """The library's count; words of letters go straight to its model, which is most of the work saved."""
        text = pretoken.decode()
        if self.plain and len(text) <= LONGEST:
            word = text if text.isascii() else unicodedata.normalize("NFC", text)
            end = word[-1:] if word[-1] in ".,;:!?" else ""
            word = word[: len(word) - len(end)]
            if word.isalpha() and max(word) < LAST_PLAIN:
                return len(self.plain(word.lower().encode().decode("latin-1").translate(BYTE_CHARS))) + (self[end.encode()] if end else 0)
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def __missing__(self, pretoken: bytes) -> int:
        n = self._encoded(pretoken)
        if len(pretoken) <= LONGEST:
            if len(self) >= len(self.frequent) + CACHED:
                self.clear()
                self.update(self.frequent)
            self[pretoken] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


#: One table per worker process and tokenizer, kept from task to task.
_WORKER: dict[int, Lengths] = {}


def _summary(seen: Counter[bytes], most: int) -> pa.RecordBatch:
    """One row: the most frequent pre-tokens of at most LONGEST bytes, joined by spaces, and how often each was seen."""
    top = sorted(((k, n) for k, n in seen.most_common(most) if len(k) <= LONGEST), key=lambda x: (-x[1], x[0]))
    return pa.RecordBatch.from_arrays([pa.array([b" ".join(k for k, _ in top)], pa.binary()), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["pretokens", "counts"])


def _trimmed(seen: Counter[bytes]) -> Counter[bytes]:
    return Counter(dict(seen.most_common(TASK_COUNTED // 2))) if len(seen) > TASK_COUNTED else seen


def _merged(rows: Iterable[tuple[bytes, list[int]]]) -> Counter[bytes]:
    seen: Counter[bytes] = Counter()
    for pretokens, counts in rows:
        for k, n in zip(pretokens.split(b" "), counts):
            seen[k] += n
        seen = _trimmed(seen)
    return seen


def frequent_pretokens(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The frequent pre-tokens of all rows, most frequent first; at most FREQUENT."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text"):
            for text in as_bytes(batch.column("text")):
                seen.update(text.split() if text else ())
            seen = _trimmed(seen)
        yield _summary(seen, TASK_SUMMARY)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _summary(_merged((r["pretokens"], r["counts"]) for b in batches for r in b.to_pylist()), FREQUENT)

    schema = "pretokens binary, counts array<bigint>"
    found = written(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(summarise, schema), "summaries")
    left = found.count()
    while left > MERGED:
        left = -(-left // MERGED)
        found = found.repartition(left).mapInArrow(merge, schema)
    seen = _merged((bytes(r["pretokens"]), r["counts"]) for r in found.collect())
    return [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT] if k]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit; the text column is not passed on."""
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    from tokenizers import Tokenizer

    words = frequent_pretokens(docs, text_col)
    encoded = Tokenizer.from_str(tokenizer_json).encode_batch([w.decode() for w in words], add_special_tokens=False)
    key = hash((tokenizer_json, tuple(words)))
    held = docs.sparkSession.sparkContext.broadcast((tokenizer_json, b" ".join(words), [len(e) for e in encoded]))
    passed = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    names = [f"c{i}" for i in range(len(passed))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, passed)] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _WORKER:
            text, joined, lengths = held.value
            _WORKER.clear()
            _WORKER[key] = Lengths(text, dict(zip(joined.split(), lengths)))
        lengths = _WORKER[key]
        for batch in slices(batches, "text"):
            texts = [x or b"" for x in as_bytes(batch.column("text"))]
            sizes = pa.array(map(len, texts), pa.int64())
            counts = pa.array(map(lengths.count, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), sizes, counts], [*names, "n_bytes", "n_tokens"])

    given = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, passed)), F.col(f"`{text_col}`").alias("text"))
    out = given.mapInArrow(count, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, passed)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
