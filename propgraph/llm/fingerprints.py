"""Document fingerprints by a homomorphic multiset hash. DataFrame functions only.

A fingerprint is a wide vector of sums modulo powers of two. Each paragraph (line) adds a vector hashed from it:
``EXACT`` words of its seeded 61-bit hashes, and for each of its sentences a count and ``2 * SHIFTS`` words that hold
two one-bit counters each, modulo 2^62. Sums do not depend on the order of paragraphs; ``combine`` adds or removes
paragraphs without the rest of the text. Equal texts have equal fingerprints; texts that are not permutations of the
same paragraphs have equal ones with a probability of about 2^-480.

Likeness: the counters are random signs of the sentences' hashes, so that the mean of the squared differences of two
vectors estimates in how many sentences two texts differ: 1 for the same sentences, about 0 for none in common, with
an error of about 0.1. A counter has 31 bits, more than a text has sentences.

Scale of ``with_next``: rows with one id and one text are collapsed before anything else, so that each remaining one
has a key of its own (id and text hash). The order is found on keys and lengths alone, by a range partitioning whose
ranges hold equal numbers of rows whatever the ids are (null, clustered, extreme). Texts are shuffled by key once, with
their vectors, and each row sends the one before it in the order its vector and as many characters as that one
replaces. Copies that were collapsed are dealt out again in portions of ``PORTION`` rows.

Defined results: a null text is an empty one; the empty text has one empty paragraph and no sentence; two texts
without a sentence are alike (1); rows with equal ids are ordered by their texts' hashes, null ids come last; of
repeated rows all but one are followed by themselves; an empty table gives an empty result; sums wrap, they never
overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

EXACT, SHIFTS = 8, 31
_MOD = (1 << 62) - 1
_COUNTERS = 1 | 1 << 31
_LANE = (1 << 31) - 1
#: Keys of a range in which each sees the next; rows that are dealt out at a time.
RANGE, PORTION = 1_000_000, 10_000
SENTENCE = r"\n|(?<=[.!?]) +"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column, each) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: (a + each(x)).bitwiseAND(F.lit(_MOD)))


def vector(text: Column) -> Column:
    """The fingerprint of a text, array<long>: sentences, counters, exact words."""
    body = F.coalesce(text, F.lit(""))
    exact = let(
        F.split(body, "\n", -1),
        lambda lines: F.transform(F.sequence(F.lit(1), F.lit(EXACT)), lambda k: _sum(lines, lambda x: F.xxhash64(k, x).bitwiseAND(F.lit((1 << 61) - 1)))),
    )
    sentences = F.filter(F.split(body, SENTENCE, -1), lambda x: x != "")

    def counters(units: Column, seed: int) -> Column:
        shift = lambda h, s: F.call_function("shiftright", h, s)
        hashes = F.transform(units, lambda x: F.xxhash64(F.lit(-seed), x))
        return let(hashes, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(SHIFTS - 1)), lambda s: _sum(hs, lambda h: shift(h, s).bitwiseAND(F.lit(_COUNTERS)))))

    return let(sentences, lambda u: F.concat(F.array(F.size(u).cast("long")), counters(u, 1), counters(u, 2), exact))


def to_text(v: Column) -> Column:
    """Hexadecimal, 16 digits a word."""
    return F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """The vector of a text with the paragraphs of another added, or removed."""
    return F.zip_with(a, b, lambda x, y: (x - y if remove else x + y).bitwiseAND(F.lit(_MOD)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two vectors."""
    shift = lambda h, s: F.call_function("shiftright", h, F.lit(s))
    at = lambda v: F.slice(v, 2, 2 * SHIFTS)

    def squares(x: Column, y: Column, n: Column, m: Column) -> Column:
        """Over the two counters of a word: squared difference, and squared norms, of the signed sums."""
        out = None
        for s in (0, 31):
            p, q = (shift(w, s).bitwiseAND(F.lit(_LANE)).cast("double") * 2 - k for w, k in ((x, n), (y, m)))
            part = (p - q) * (p - q), p * p + q * q
            out = part if out is None else (out[0] + part[0], out[1] + part[1])
        return F.struct(out[0].alias("d"), out[1].alias("n"))

    n, m = F.element_at(a, 1).cast("double"), F.element_at(b, 1).cast("double")
    both = F.zip_with(at(a), at(b), lambda x, y: squares(x, y, n, m))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
    total = F.aggregate(both, zero, lambda t, x: F.struct((t.d + x.d).alias("d"), (t.n + x.n).alias("n")))
    return let(total, lambda t: F.when(a == b, 1.0).when(t.n == 0, F.when(t.d == 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - t.d / t.n)))


KEY = ("__null", "__neg", "__h")


def order(slim: DataFrame) -> DataFrame:
    """``slim`` (KEY, n_chars) in the whole order, with the key and the length of the row before each (before the first:
    of the last) as ``to`` and ``to_chars``. The driver gets a row for each range."""
    rows = slim.count()
    dealt = slim.repartitionByRange(max(32, -(-rows // RANGE)), *KEY).sortWithinPartitions(*KEY)
    dealt = written(dealt.withColumn("pid", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id()), "fp-order")
    me = F.struct(*KEY, "n_chars")
    last = dict(dealt.groupBy("pid").agg(F.max_by(me, "idx").alias("last")).collect())
    if not last:
        return slim.select(*KEY, F.struct(*KEY).alias("to"), F.col("n_chars").alias("to_chars"))
    pids = sorted(last)
    before = slim.sparkSession.createDataFrame([(p, last[pids[k - 1]]) for k, p in enumerate(pids)], f"pid int, before {dealt.select(me.alias('m')).schema['m'].dataType.simpleString()}")
    found = dealt.join(F.broadcast(before), "pid")  # a row for each range
    back = F.coalesce(F.lag(me).over(Window.partitionBy("pid").orderBy("idx")), F.col("before"))
    found = found.withColumn("b", back)
    return found.select(*KEY, F.struct(*(F.col(f"b.{k}").alias(k) for k in KEY)).alias("to"), F.col("b.n_chars").alias("to_chars"))


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of the distinct rows of ``docs`` (doc_id, text, no nulls in text): doc_id, n_chars, text, vector,
    copies; and these with ``head`` and ``next_vector``, the next text's first floor(n_chars / 3) characters and its
    vector. Next is the next id below, after the last the first."""
    keyed = docs.select(
        "doc_id", "text", F.col("doc_id").isNull().alias("__null"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("__neg"),
        F.xxhash64("text").alias("__h"), F.length("text").cast("long").alias("n_chars"),
    )
    # ascending in __neg is descending in doc_id
    links = order(keyed.groupBy(*KEY).agg(F.min("n_chars").alias("n_chars")))
    # as one value, and with a condition on the count, so that no use of this prunes a column: all read one exchange
    one = keyed.groupBy(*KEY).agg(F.min(F.struct("doc_id", "n_chars", "text")).alias("r"), F.count(F.lit(1)).alias("copies")).filter("copies >= 1")
    one = one.select(*KEY, "r.doc_id", "r.n_chars", "r.text", "copies").withColumn("vector", vector(F.col("text")))
    sent = one.join(links, [*KEY]).select(*(F.col(f"to.{k}").alias(k) for k in KEY), F.substring("text", F.lit(1), F.floor(F.col("to_chars") / 3).cast("int")).alias("head"), F.col("vector").alias("next_vector"))
    return one, one.join(sent, [*KEY])


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    distinct, near = with_next(docs)
    k = F.floor(F.col("n_chars") / 3).cast("int")
    kept = (F.col("n_chars") - k).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), "head")

    def result(edited: Column, after: Column) -> Column:
        def out(e: Column) -> Column:
            return let(
                vector(e),
                lambda b: F.struct(
                    F.sha2(e.cast("binary"), 256).alias("edited_sha256"), to_text(b).alias("edited_fingerprint"),
                    likeness(F.col("vector"), b).alias("near_edited"), likeness(F.col("vector"), after).alias("near_next"),
                ),
            )

        return let(edited, out)

    own = F.concat(F.substring("text", F.lit(1), kept), F.substring("text", F.lit(1), k))  # of a row that is followed by itself
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def named(rows: DataFrame, out: Column, *more: str) -> DataFrame:
        rows = rows.select("doc_id", "n_chars", to_text(F.col("vector")).alias("fingerprint"), out.alias("o"), *more)
        return rows.select("doc_id", "n_chars", "o.edited_sha256", "fingerprint", "o.edited_fingerprint", "o.near_edited", "o.near_next", *more)

    first = named(near, result(edited, F.col("next_vector")))
    copies = named(distinct.filter("copies > 1"), result(own, F.col("vector")), "copies")
    portions = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1, F.lit(PORTION).cast("long")))
    copies = copies.withColumn("at", portions).repartition("doc_id", "fingerprint", "at")
    copies = copies.withColumn("copy", F.explode(F.sequence("at", F.least(F.col("copies") - 1, F.col("at") + PORTION - 1))))
    return first.unionByName(copies.select(*names)).select(*names)
