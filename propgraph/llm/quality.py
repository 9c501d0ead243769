"""Quality rules: learned decision lists. DataFrame functions only on the main path.

Statistics of each whole text are built-in column expressions. Rules are learned by sequential covering from labelled
statistics: a conjunction of thresholds is grown on one part of the labelled rows by information gain, pruned on the
other, and kept if it rejects good documents hardly ever; the rows it covers go, and the next one is learned. The
result is an ordered conditional expression, which Spark evaluates like any other.

Learning reads at most ``MOST_LABELLED`` labelled rows (those with the smallest hashes of their ids; a documented
bound): that many rows of a dozen numbers reach the driver. Statistics and verdicts cover all documents.

Windows of five words are compared by 64-bit hashes: two different windows of one text are taken for equal with a
probability below 10^-11 for a text of 20,000 words.

Defined results: a null text has no words; ``kept`` is never null; without labelled rows, or of one kind only, no rule
is learned and only the base conditions reject; documents with several labels, or several rows of a labelled id, give
a labelled row each; rows with null ids or labels are not learned from; columns with a statistic's name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD
from .fingerprints import let

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
MOST_LABELLED = 20_000
MOST_RULES, MOST_CONDITIONS, CUTS = 16, 4, 48
#: A rule is kept if this share of what it rejects is bad, on the rows it was not grown on too.
PRECISION, COVERS = 0.97, 3

#: What rules can test, from the columns that ``statistics`` adds.
FEATURES = ("n_words", "symbol_share", "mean_word", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "words_a_line", "distinct_share")


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of five words that the text has twice or more, from the array of its words.

    Windows are hashed; texts without equal hashes are done. In others (hash, place) pairs are sorted, neighbours
    with equal hashes give the places, and each place adds what the next one does not cover: n log n, no pairs.
    """
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.when(F.size(w) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def places(s: Column) -> Column:
        same = lambda e, k: (k > 0) & (F.get(s, k - 1)["h"] == e["h"]) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    def slow(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(let(pairs, places), covered)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow(h))).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base statistics and the rules' features."""
    t = F.col("__t")
    rows = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    # words are used as an array, lines as the two numbers that are taken from them
    inner = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"), F.size(F.array_distinct(w)).alias("d")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    rows = rows.withColumn("__w", inner).withColumn("__l", by_line)
    rows = rows.withColumns({"n_words": F.col("__w.n"), "word_chars": F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long"), "n_symbols": _count(t, r"[#*$%&|<>]+"), "n_dup_lines": F.col("__l.d"), "n_repeat_words": F.col("__w.r")})
    w, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    rows = rows.withColumns({
        "symbol_share": F.col("n_symbols") / c,
        "mean_word": F.col("word_chars") / w,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("__l.n"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / w,
        "upper_share": _count(t, r"\p{Lu}+") / c,
        "mark_share": _count(t, r"[!?.,;:]+") / c,
        "digit_share": _count(t, r"[0-9]+") / c,
        "words_a_line": F.col("n_words") / F.greatest(F.col("__l.n"), F.lit(1)),
        "distinct_share": F.col("__w.d") / w,
    })
    return rows.drop("__t", "__w", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# -- learning, on the driver, from a bounded number of rows ---------------------------------------------------------

Rule = list[tuple[str, str, float]]


def _holds(row: dict, rule: Rule) -> bool:
    return all(row[f] > v if op == ">" else row[f] <= v for f, op, v in rule)


def _score(rows: list[tuple[dict, bool]], rule: Rule) -> tuple[int, int]:
    """(bad, good) rows that the rule covers."""
    hit = [bad for r, bad in rows if _holds(r, rule)]
    return sum(hit), len(hit) - sum(hit)


def _cuts(rows: list[tuple[dict, bool]], f: str) -> list[float]:
    values = sorted({r[f] for r, _ in rows})
    step = max(1, len(values) // CUTS)
    return [(a + b) / 2 for a, b in zip(values[:-1:step], values[1::step], strict=False)]


def _gain(p: int, n: int, q: int, m: int) -> float:
    """FOIL's information gain of covering (q bad, m good) rows where (p, n) were covered."""
    return q * (math.log2(q / (q + m)) - math.log2(p / (p + n))) if q else 0.0


def _grow(rows: list[tuple[dict, bool]]) -> Rule:
    rule: Rule = []
    while len(rule) < MOST_CONDITIONS:
        p = sum(bad for _, bad in rows)
        n = len(rows) - p
        if not n or not p:
            break
        best, chosen = 0.0, None
        for f in FEATURES:
            ranked = sorted((r[f], bad) for r, bad in rows)
            at, low_bad, low_good = 0, 0, 0
            for cut in _cuts(rows, f):
                while at < len(ranked) and ranked[at][0] <= cut:
                    low_bad, low_good, at = low_bad + ranked[at][1], low_good + (not ranked[at][1]), at + 1
                for op, q, m in (("<=", low_bad, low_good), (">", p - low_bad, n - low_good)):
                    if (g := _gain(p, n, q, m)) > best:
                        best, chosen = g, (f, op, cut)
        if chosen is None:
            break
        rule.append(chosen)
        rows = [(r, bad) for r, bad in rows if _holds(r, [chosen])]
    return rule


def _prune(rows: list[tuple[dict, bool]], rule: Rule) -> Rule:
    """The shortest beginning of the rule that does best on rows that it was not grown on."""
    def worth(k: int) -> float:
        q, m = _score(rows, rule[:k])
        return (q - 4 * m) / (q + m + 1)

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 6), -k))] if rule else rule


def learn(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Rules that reject, in order, from (features, is bad). Every third row prunes; the others grow."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < MOST_RULES:
        grow, prune = [x for k, x in enumerate(left) if k % 3], left[::3]
        rule = _prune(prune, _grow(grow))
        bad, good = _score(left, rule) if rule else (0, 0)
        held_bad, held_good = _score(prune, rule) if rule else (0, 0)
        # a rule has to show itself on rows that it was not grown on: one that covers none of them is not accepted
        if bad < COVERS or bad < PRECISION * (bad + good) or not held_bad or held_bad < PRECISION * (held_bad + held_good):
            break
        rules.append(rule)
        left = [(r, b) for r, b in left if not _holds(r, rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that rejects, or null."""
    out = None
    for k, rule in enumerate(rules):
        cond = None
        for f, op, v in rule:
            one = F.col(f) > F.lit(v) if op == ">" else F.col(f) <= F.lit(v)
            cond = one if cond is None else cond & one
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality 0 or 1) of ``docs`` (doc_id, text), at most ``most`` labelled rows."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "quality").limit(most)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # not a filter: Spark would push it, and with it the statistics of all documents, below the join
    rows = rows.select("doc_id", "quality", base_failed().alias("failed"), *FEATURES)
    found = rows.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "quality").limit(most).collect()
    return learn([({f: float(r[f]) for f in FEATURES}, r["quality"] == 0) for r in found if not r["failed"]])  # base conditions go first


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``rule`` (the first that rejects, or null) and ``kept``."""
    rows = statistics(docs, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
