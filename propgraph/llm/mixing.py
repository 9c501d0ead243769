"""Mixing sources to target weights.

Tokens are summed for each source; a budget of tokens is shared among sources by weight, and a source gets no more
than ``most`` times its own tokens (the excess is shared again by weight). A source's repetition rate is target over
tokens: each of its documents is emitted floor(rate) times, plus once more if a hash-seeded Bernoulli draw with the
rate's fraction as probability says so. Of ``SEEDS`` seeds, each source uses the one whose draws come nearest its
target, so that small sources come near theirs too; the choice needs sums for each source only.

Sources stay a distributed table throughout: the water level is found from a few scalar sums a round, weights come
from a distributed rank, and the plan is broadcast only if its counted rows allow it. A source with a third of all
rows is summed by partial aggregates. Texts are never shuffled.

Defined results: null texts have size 0; documents of size 0 are taken as others are (their words count for nothing,
and a source without words has rate 0); a null source is a source, the last; null ids draw by their text; rows that
are repeated with equal id and text draw alike; an empty table gives an empty mix; input columns that have a result's
name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, global_rank, held, lookup, uniform

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
SEEDS = 32


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(k: int | Column) -> Column:
    return uniform(F.col("__h"), k if isinstance(k, Column) else F.lit(k))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: weights repeat in the sources' order, null last."""
    # sources are few or many: each step is an aggregate over them
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "mix-sources", "rank", 8)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = held(ranked.withColumn("weight", weight))
    cap = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, 0.0  # below the level, target = level * weight; a source is full when that passes its cap
    while True:
        full = F.col("weight") * F.lit(level) > cap
        used, free = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (budget - (used or 0.0)) / free if free else float("inf")
        if not free or new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap) if level != float("inf") else cap).drop("rank")


def plan(sized: DataFrame, **how) -> DataFrame:
    """For each source of ``sized`` (source, size, __h): source_size, target, rate, seed."""
    totals = held(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    planned = targets(totals, **how).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    planned = held(planned)
    part = F.col("rate") - F.floor("rate")
    taken = [F.sum(F.when(_draw(k) < part, F.col("size")).otherwise(0)).alias(f"k{k}") for k in range(SEEDS)]
    sums = lookup(sized, planned.select("source", "rate"), "source").groupBy("source").agg(*taken)
    missing = [F.abs(F.col(f"k{k}") + F.floor("rate") * F.col("source_size") - F.col("target")) for k in range(SEEDS)]
    seeds = sums.join(planned.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    best = F.least(*missing)
    seed = F.coalesce(*(F.when(m == best, F.lit(k)) for k, m in enumerate(missing)))
    return held(seeds.select("source", "source_size", "target", "rate", seed.alias("seed")))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.withColumn("size", words(text)).withColumn("__h", F.xxhash64(F.col(doc_id), F.when(F.col(doc_id).isNull(), F.col(text)))).withColumn("source", F.col(source))


def copies(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """``docs`` (from ``sized``) with the plan's columns and ``copies``, how often the mix takes each."""
    found = lookup(docs, planned, "source")
    part = F.col("rate") - F.floor("rate")
    return found.withColumn("copies", (F.floor("rate") + (_draw(F.col("seed")) < part).cast("long")).cast("int"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix of ``docs`` (doc_id, text, source and any more columns): each row as often as it is taken."""
    names = docs.columns
    made = ("size", "copies", "source_size", "target", "rate", "seed")
    clash = {c: f"__in_{c}" for c in names if c in made}
    inner = docs.withColumnsRenamed(clash)
    slim = held(sized(inner.select("doc_id", "text", "source")).select("source", "size", "__h"))
    out = copies(sized(inner), plan(slim, **how))
    out = out.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*(F.col(clash.get(c, c)).alias(c) for c in names))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    slim = held(sized(docs).select("doc_id", "source", "size", "__h"))
    out = copies(slim, plan(slim.select("source", "size", "__h")))
    return out.select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")
