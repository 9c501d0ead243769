"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of training text. A text is encoded with each
dictionary in blocks; the language whose dictionary gives the fewest bytes is chosen. A choice whose margin over
the next language is narrow is marked as rejected.

Training: of each language exactly the ``docs_per_lang`` different texts with the smallest hashes are taken (all, if
it has fewer: a language with one text has a dictionary), and of each a span of ``chars_per_doc`` characters at a
place that its hash gives. Copies are collapsed before anything is chosen, so that they take no place. With more than
``MOST_DOCS / docs_per_lang`` languages each has fewer texts, one at least. The driver gets the chosen spans alone.
Prediction reads whole texts: no prefix, no cap.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; null languages are not
learned; without any training rows every text is ``und``; ties go to the language with more training documents, then
to the first by code point; repeated rows get equal results; an empty table gives an empty result; columns of the
input that have a result's name are replaced (``names`` gives the results others).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, small_batches

DOCS_PER_LANG, CHARS_PER_DOC = 60, 1200
#: Texts that are learned from in all, one for each language at least.
MOST_DOCS = 60_000
#: Sets of tasks whose smallest hashes are found apart before those of a whole language are.
PARTS = 32
#: At level 11 zstandard matches the dictionary well enough to tell short texts apart.
LEVEL = 11
#: Bytes that are encoded at a time: a dictionary says little about the end of a long block.
BLOCK = 4096
#: A relative margin below this is narrow: (second - best) / best.
NARROW = 0.002
#: This relative margin, or more, is score 1.
CLEAR = 0.25
_LETTER = regex.compile(r"\p{L}")
_OTHER, _OTHER_ASCII = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+")


def plain(text: str) -> bytes:
    """Lower-cased words of letters and their combining marks, one space apart: capitals, punctuation and digits tell
    no language from another."""
    low = text.lower()
    return (_OTHER_ASCII if low.isascii() else _OTHER).sub(" ", low).encode("utf-8", "replace")


def fit(train: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> dict[str, bytes]:
    """Raw dictionary content for each language, the most frequent first, from at most ``docs_per_lang`` * ``chars_per_doc`` characters each."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    hashed = rows.withColumn("h", F.xxhash64("text", F.lit(17)))
    # equal texts count once: a text with a third of all rows is one row of each task's partial aggregate
    texts = held(hashed.groupBy("lang", "h").agg(F.count("*").alias("n")))
    counts = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    each = max(1, min(docs_per_lang, MOST_DOCS // max(1, len(counts))))
    # the smallest hashes of each task, of each of ``PARTS`` sets of tasks, of each language: no language is one task's work
    parts = texts.select("lang", "h", (F.spark_partition_id() % PARTS).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        parts = parts.withColumn("place", place).filter(F.col("place") <= each).drop("place")
    chosen = parts.select("lang", "h")
    start = F.pmod("h", F.greatest(F.lit(1), F.length("text") - chars_per_doc + 1)) + 1
    span = F.substring("text", start.cast("int"), F.lit(chars_per_doc))
    kept = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(span).alias("text"))  # MOST_DOCS rows, or one a language
    found: dict[str, list] = {}
    for r in kept.collect():
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    texts.unpersist()
    return {k: b" ".join(plain(t) for _, t in sorted(v)) for k, v in sorted(found.items(), key=lambda x: (-counts[x[0]], x[0]))}


class Compressor:
    """Encoded sizes of texts, language by language."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = list(content)
        self.zstd = []
        for k in self.langs:
            # a short dictionary is not raw content to zstandard; spaces in front of it change no size between languages
            d = zstandard.ZstdCompressionDict(content[k].rjust(64), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.zstd.append(zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]
        return [sum(len(z.compress(b)) for b in blocks) for z in self.zstd]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(plain(text))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = [s for i, s in enumerate(sizes) if i != best]
        margin = (min(rest) - sizes[best]) / sizes[best] if rest else CLEAR
        return self.langs[best], min(1.0, margin / CLEAR), bool(rest) and margin < NARROW


def identify(docs: DataFrame, content: dict[str, bytes], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with ``names``: the language, a score (0 to 1, the margin) and whether it is rejected (a narrow margin, or ``und``)."""
    docs = docs.drop(*names)
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(content)  # at most languages * docs_per_lang * chars_per_doc characters
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Compressor(model.value)
        for b in batches:
            found = [z.predict(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that must not be learned from: crc32 of the id as text is divisible by 5. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    content = fit(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", "text"), content)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
