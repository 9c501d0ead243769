"""License scans with ordered signature rules. DataFrame functions only.

A text becomes its words, one space apart. A keyword prefilter looks for any of the rules' keywords; only texts that
have one are scanned, and of the rules only those whose own keyword occurs. Every place where a rule's regex stands
gives a detection (rule, first word, last word). Where detections overlap, one that lies within another is suppressed
if the other is longer, or as long and of a rule with higher priority (earlier in the list); what remains gives the
labels. The base phrases' places are all counted, and their labels always stay.

The rules are written by hand (``license_rules``). Each is a literal pattern of its own, so that it is compiled once a
task. A row is scanned by itself: nothing is shuffled, and no row or group is hot. Suppression is a sweep over the
detections in order of first word, the longest first: one is suppressed exactly if an earlier one ends where it does or
later. Running sums and maxima are taken block by block, so that a text with n detections costs about ``BLOCK`` n steps
and no more than n squared over ``BLOCK`` squared for the blocks' own.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows get equal results; texts of any
length are scanned whole; columns of the input that have a result's name are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import let
from .license_rules import BASE, rules  # noqa: F401

#: What parts words: ASCII without letters and digits. Of other characters every one belongs to a word.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Values that a running sum or maximum takes together.
BLOCK = 64
RESULTS = ("n_words", "detections", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def before(values: Column, start: Column, merge) -> Column:
    """For each of an array's values what ``merge`` makes of all values before it, beginning with ``start``."""
    fold = lambda a, zero: F.aggregate(a, zero, merge)

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start))

        def with_totals(t: Column) -> Column:
            own = F.transform(t, lambda _, b: fold(F.slice(t, F.lit(1), b), start))
            return let(own, lambda o: F.transform(v, lambda _, i: let(F.floor(i / BLOCK).cast("int"), lambda b: fold(F.slice(v, b * BLOCK + 1, i - b * BLOCK), F.get(o, b)))))

        return F.when(F.size(v) == 0, F.slice(v, 1, 0)).otherwise(let(totals, with_totals))

    return let(values, of)


def _keywords(words: set[str]) -> str:
    """A regex for any of the words; by first letter, so that most words of a text are passed over at once."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(w[1:])
    return f"(?i) (?:{'|'.join(k + '(?:' + '|'.join(v) + ')' for k, v in by.items())}) "


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, detections (the base phrases' and those not suppressed), n_base, first_word, last_word, base_labels, labels, score."""
    listed = list(enumerate(rules()))
    keys = sorted({key for _, (_, key, *_) in listed})
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), APART, " "))
    rows = docs.withColumn("__p", plain).drop(*(c for c in RESULTS if c != text))
    p = F.col("__p")
    rows = rows.withColumn("n_words", F.when(p == "", F.lit(0).cast("long")).otherwise(spaces(p) + 1))
    padded = F.concat(F.lit(" "), p, F.lit(" "))

    def marked(t: Column) -> Column:
        """(rule, text with a mark before and after each match) of the rules that match, key by key."""
        none = F.array().cast("array<struct<k:int,m:string>>")

        def of(key: str) -> Column:
            own = []
            for k, (_, of_key, rx, *_) in listed:
                if of_key == key:
                    stands = f"(?<= )(?:{rx})(?= )"
                    hit = F.when(F.rlike(t, F.lit(stands)), F.regexp_replace(t, stands, "\u0001$0\u0002"))
                    own.append(F.struct(F.lit(k).alias("k"), hit.alias("m")))
            return F.when(F.contains(t, F.lit(f" {key} ")), F.filter(F.array(*own), lambda x: x["m"].isNotNull())).otherwise(none)

        return F.flatten(F.array(*map(of, keys)))

    def places(hit: Column) -> Column:
        """Detections of a rule: the text is parted before each match; spaces up to a part's start are words before it."""

        def intervals(parts: Column) -> Column:
            counts = F.transform(parts, spaces)
            ends = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: spaces(F.substring_index(x, "\u0002", 1)))
            first = before(counts, F.lit(0).cast("long"), lambda a, x: a + x)
            return let(first, lambda b: F.transform(ends, lambda n, i: F.struct((F.get(b, i + 1) - 1).alias("start"), (-(F.get(b, i + 1) - 1 + n)).alias("neg_end"), hit["k"].alias("k"))))

        return let(F.split(hit["m"], "\u0001", -1), intervals)

    kind = "array<struct<start:bigint,neg_end:bigint,k:int>>"
    found = let(F.translate(padded, UPPER, LOWER), lambda t: F.sort_array(F.flatten(F.transform(marked(t), places))).cast(kind))
    rows = rows.withColumn("__d", F.when(padded.rlike(_keywords(set(keys))), found).otherwise(F.array().cast(kind)))
    is_base = lambda k: k >= len(listed) - len(BASE)

    def stay(d: Column) -> Column:
        ends = before(F.transform(d, lambda x: -x["neg_end"]), F.lit(-1).cast("long"), lambda a, x: F.greatest(a, x))
        kept = let(ends, lambda e: F.filter(d, lambda x, i: is_base(x["k"]) | (F.get(e, i) < -x["neg_end"])))
        names, sure = (F.array(*(F.lit(r[j]) for _, r in listed)) for j in (0, 3))
        named = lambda x: F.struct(x["start"], (-x["neg_end"]).alias("end"), x["k"].alias("k"), F.get(names, x["k"]).alias("label"), F.get(sure, x["k"]).alias("weight"), is_base(x["k"]).alias("base"))
        return F.transform(kept, named)

    whole = "array<struct<start:bigint,end:bigint,k:int,label:string,weight:double,base:boolean>>"
    rows = rows.withColumn("detections", F.when(F.size("__d") > 0, let(F.col("__d"), stay).cast(whole)).otherwise(F.array().cast(whole)))
    base = let(F.filter("detections", lambda x: x["base"]), lambda b: F.struct(F.size(b).cast("long").alias("n"), F.array_min(F.transform(b, lambda x: x["start"])).alias("lo"), F.array_max(F.transform(b, lambda x: x["start"])).alias("hi"), F.array_join(F.array_sort(F.array_distinct(F.transform(b, lambda x: x["label"]))), ",").alias("labels")))
    rows = rows.withColumn("__b", base)
    score = F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0))
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("detections", lambda x: x["label"]))), ",")
    return rows.select("*", F.col("__b.n").alias("n_base"), F.col("__b.lo").alias("first_word"), F.col("__b.hi").alias("last_word"), F.col("__b.labels").alias("base_labels"), labels.alias("labels"), score.alias("score")).drop("__p", "__d", "__b")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
