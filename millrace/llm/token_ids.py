"""Encoding of a whole corpus with a public tokenizer (problem 8), and token counts for others.

The encoder cuts a text where the tokenizer's own split pattern always cuts, and encodes long
unsplit stretches by tree concatenation: halves on their own, then a growing window around the
join until it agrees with the tokens kept on both sides.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import once, width

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text before the merges of the byte-level rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches without a safe cut are encoded whole up to this many bytes, in halves above.
WHOLE_BYTES = 512
#: Texts above this many characters are cut and encoded by several tasks.
LONG_CHARS = 1 << 18
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE given by its rank file."""

    def __init__(self, path: str, whole: int = WHOLE_BYTES):
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(SPLIT)
        self.long = regex.compile(r"\S{%d}|\s{%d}" % (whole, whole))
        self.whole = whole

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one unsplit stretch."""
        if len(data) <= self.whole:
            return self.bpe._encode_single_piece(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def agree(self, a: int, b: int) -> bool:
        """Whether the two tokens stay two when their bytes are encoded together.

        A row of tokens is the encoding of its bytes just if this holds for all neighbours.
        """
        return self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of left's and right's bytes together, both of the same stretch."""
        if not left or not right:
            return left or right
        w = 2
        while True:
            lo, hi = max(0, len(left) - w), min(len(right), w)
            middle = self.bpe._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[lo:] + right[:hi])))
            if (lo == 0 or self.agree(left[lo - 1], middle[0])) and (hi == len(right) or self.agree(middle[-1], right[hi])):
                return left[:lo] + middle + right[hi:]
            w *= 2

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, an empty list for an empty or null one. Strings of special tokens are ordinary text."""
        if not text:
            return []
        text = text.encode("utf-8", "replace").decode("utf-8")
        if not self.long.search(text):
            return self.bpe.encode_ordinary(text)
        ids: list[int] = []
        for m in self.split.finditer(text):
            ids += self.piece(m.group().encode("utf-8"))
        return ids

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def encoder(path: str) -> Encoder:
    """One encoder for each rank file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_LETTERS, _NUMBERS, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")


def _kind(c: str) -> str:
    return "L" if _LETTERS.match(c) else "N" if _NUMBERS.match(c) else "S" if _SPACE.match(c) else "O"


def cuts(text: str, size: int) -> list[tuple[int, bool]]:
    """Where to cut a long text in segments of about `size` characters, and whether a stretch goes on over the cut.

    A cut between a visible character and a blank is one of the split pattern too. Within a run of one
    kind the stretch goes on: far enough from an apostrophe, and in blanks with two more to come, both
    sides' outer pieces belong to the same stretch.
    """
    out, at, n = [], size, len(text)
    while at < n:
        i = at
        while i < n:
            a, b = _kind(text[i - 1]), _kind(text[i])
            if a != "S" and b == "S":
                out.append((i, False))
                break
            if i - at > 64 and a == b and "'" not in text[max(0, i - 4) : i + 4]:
                if a != "S" or (i + 1 < n and _kind(text[i + 1]) == "S"):
                    out.append((i, True))
                    break
            i += 1
        at = i + size
    return out


def _segments(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places = cuts(text, size)
                edges = [0, *(i for i, _ in places), len(text)]
                goes = [False, *(g for _, g in places)]
                rows += [(doc, k, goes[k], text[edges[k] : edges[k + 1]]) for k in range(len(edges) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((b.schema.field(0).type, pa.int32(), pa.bool_(), pa.string()))], names=["doc_id", "seg", "goes", "text"])

    return cut


def _encode(path: str, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path) if whole == WHOLE_BYTES else Encoder(path, whole)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                s = b.slice(lo, 512)
                texts = s.column(s.schema.get_field_index("text")).to_pylist()
                ids = pa.array([enc.encode(t) for t in texts], type=pa.list_(pa.int32()))
                kept = [i for i, f in enumerate(s.schema) if f.name != "text"]
                yield pa.RecordBatch.from_arrays([*(s.column(i) for i in kept), ids], names=[*(s.schema.field(i).name for i in kept), "ids"])

    return run


def _tree(path: str):
    """Joins the segments of each document pairwise, level by level."""

    def run(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        rows = sorted(zip(table.column("seg").to_pylist(), table.column("goes").to_pylist(), table.column("text").to_pylist(), table.column("ids").to_pylist()))
        parts = []
        for _, goes, text, ids in rows:
            outer = [None, None]
            for m in enc.split.finditer(text):
                outer = [outer[0] or m.group(), m.group()]
            parts.append((goes, ids, *(len(enc.piece(x.encode("utf-8"))) for x in outer)))
        while len(parts) > 1:
            joined = []
            for i in range(0, len(parts), 2):
                if i + 1 == len(parts):
                    joined.append(parts[i])
                    continue
                (g, a, f, last), (goes, b, first, z) = parts[i], parts[i + 1]
                if not goes:
                    joined.append((g, a + b, f, z))
                    continue
                k = len(a) - last
                middle = enc.join(a[k:], b[:first])
                joined.append((g, a[:k] + middle + b[first:], len(middle) if k == 0 else f, len(middle) if first == len(b) else z))
            parts = joined
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([parts[0][1]], type=pa.list_(pa.int32()))})

    return run


def token_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE}", key: str = "doc_id", text: str = "text", long_chars: int = LONG_CHARS, whole: int = WHOLE_BYTES) -> DataFrame:
    """(doc_id, ids): the token ids of each distinct document, without special tokens.

    Null and empty texts give an empty list, blank ones the ids of their blanks. Texts of more than
    `long_chars` characters are cut in segments that are encoded by different tasks and joined by tree
    concatenation; all others are encoded where they are. A null id counts as one id.
    """
    docs = once(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    ids = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= long_chars).mapInArrow(_encode(path, whole), ids)
    long = docs.where(F.length("text") > long_chars).select("doc_id", "text")
    parted = T.StructType([docs.schema["doc_id"], T.StructField("seg", T.IntegerType()), T.StructField("goes", T.BooleanType()), T.StructField("text", T.StringType())])
    segments = long.mapInArrow(_segments(max(1, long_chars // 2)), parted).repartition(width(docs.sparkSession), "doc_id", "seg")
    coded = segments.withColumn("kept", F.col("text")).mapInArrow(_encode(path, whole), T.StructType([*parted.fields[:3], T.StructField("kept", T.StringType()), ids.fields[1]])).withColumnRenamed("kept", "text")
    return short.unionByName(coded.groupBy("doc_id").applyInArrow(_tree(path), ids))


def token_counts(documents: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE}", text: str = "text", out: str = "n_tokens") -> DataFrame:
    """documents, with the text replaced by its number of tokens; 0 for null and empty texts."""
    rest = [f for f in documents.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = pa.array([enc.count(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in rest), n], names=[*(f.name for f in rest), out])

    return documents.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))
