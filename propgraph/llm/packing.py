"""Best-fit packing of tokenized documents by bin completion, branch and bound.

Documents become token ids (by a public tokenizer's file, whose path is a parameter) and end with id 0; only those
longer than a sequence are cut, into whole sequences and a last, shorter piece. Pieces are then packed into as few
sequences as the search finds (``binpack``).

Scale: packing needs only how many pieces there are of each length, which is at most ``capacity`` numbers, however
many documents there are. The driver solves on that histogram. Each piece then finds its place by its length and its
rank among pieces of that length, which come from windows over slices of each length; rows that are repeated lie in
different slices (no length and no document, however common, is one task). What is broadcast has at most ``capacity``
rows, or that many for each of a length's slices: ``SLICES``, and one for each ``SLICE_ROWS`` pieces.

Defined results: a null text is empty, a sequence of id 0 alone; repeated rows are packed each; null ids are kept;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .binpack import solve
from .common import held, small_batches

CAPACITY, END = 2048, 0
#: A length's pieces are ranked in so many slices at least, and in more where a slice would have more rows than this.
SLICES, SLICE_ROWS = 64, 1_000_000
#: Words, and pieces of words, whose ids a worker keeps: the first ones that it meets, among them all common ones.
CACHE = 250_000
_ODD = re.compile(r"[\x1c-\x1f]|<\|")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)}


class _Lazy(dict):
    """Values made when asked for, and the first ``most`` of them kept."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes; the same ids as the tokenizer gives the whole text.

    The tokenizer never joins what white space parts, so that ids are kept for each word, and for the pieces into
    which its pre-tokenizer parts words; new pieces go to its model. Words with letters beyond U+017F, whose case or
    composition may depend on more, go to the whole tokenizer, as do texts with a special token's mark or a separator
    that Python alone takes for white space, and all texts if the file is not of this kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        steps = [x.get("type") for x in (parts.get("normalizer") or {}).get("normalizers", [])]
        first, *second = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and [x["type"] for x in second] == ["ByteLevel"]
        self.pattern = regex.compile(first["pattern"]["Regex"]) if self.by_word else None
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.pieces, self.words = _Lazy(self._piece, CACHE), _Lazy(self._word, CACHE)

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])

    def _word(self, word: str) -> bytes:
        if not word.isascii() and max(word) > "\u017f":
            return self._raw(word)
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        if low[:-1].isalpha():  # letters and one other character, which is a piece of its own
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(low)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or _ODD.search(text):
            return self._raw(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian, if asked for)."""
    last = np.asarray([end], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = Encoder(path)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(t) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.strip().split()[0] for f in schema.split(",")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def places(fillings: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each (length, first rank): the first sequence, how many a sequence, and the offset in it; sorted for search."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for filling, times in fillings:
        at = 0
        for length in sorted(filling, reverse=True):
            each = filling[length]
            rows.append(((length << 48) + rank.get(length, 0), rank.get(length, 0), seq, each, at))
            rank[length] = rank.get(length, 0) + each * times
            at += each * length
        seq += times
    a = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "seq", "each", "at"), a.T.copy(), strict=True))


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark, names = pieces.sparkSession, [*pieces.columns, "sequence_id", "offset"]
    pieces = held(pieces.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(places(solve(counts, capacity)))
    order = ["doc_id", "piece", "ids_crc32", "__row"]
    slices = spark.createDataFrame([(k, max(SLICES, -(-n // SLICE_ROWS))) for k, n in counts.items()], "length long, __slices int")
    dealt = pieces.join(F.broadcast(slices), "length")  # at most `capacity` rows
    sliced = dealt.withColumn("__slice", F.pmod(F.xxhash64(*order), F.col("__slices")).cast("int")).drop("__slices")
    sums = sliced.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "__slice", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__slice").orderBy(*order)) - 1
    ranked = sliced.withColumn("__inside", inside).join(F.broadcast(before), ["length", "__slice"])  # at most capacity * SLICES rows, and one for each SLICE_ROWS pieces
    ranked = ranked.select(*names[:-2], (F.col("__before") + F.col("__inside")).cast("long").alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = where.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            r = b.column(b.schema.get_field_index("__rank")).to_numpy(zero_copy_only=False)
            i = np.searchsorted(p["key"], (length << 48) + r, "right") - 1
            k, each = r - p["rank"][i], p["each"][i]
            made = [pa.array(p["seq"][i] + k // each), pa.array(p["at"][i] + (k % each) * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(names) - 2)), *made], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with their sequence and offset."""
    return assign(tokenize(docs, path, capacity, end, keep_ids), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
