"""N-gram Jaccard self-join by a token-group matrix.

A document's set has its distinct shingles of five words. Similar documents are put into a group (by the shingle
with the smallest hash that is not too common); for each group the union of its members' tokens is stored, as rows
(token, group); the overlap of two groups bounds the overlap of their members; only groups whose bound qualifies are
opened, and there sets are compared exactly. Documents link when the similarity of their sets reaches the threshold;
the result is the components of all links.

What is exact and why. Shingles are ordered by a 64-bit hash. Of a set of n shingles the smallest
n - ceil(t n) + SLACK are kept (all, if fewer): two sets that reach the threshold t share at least
low(n) = min(ceil(t ceil(t n)), SLACK) of what is kept of both. Tokens of more than COMMON groups (passages that many
documents share) are left out of the matrix; a set with f such tokens then still shares low(n) - f tokens, and if
that is no bound (f >= low(n)), the set is saturated: it is grouped by its common tokens, all its tokens are stored,
and any two saturated sets meet there. So no link is lost, and a group pair is opened only if it shares the
required number. What counts as common changes cost, never results. Common tokens are first found where a task meets
them twice; the matrix's tasks then see the exact number of groups of each token, and if one that is not known to be
common has more than ``RUN`` it emits no pairs: it joins the common ones, and the matrix is made anew.

Scale. Equal sets collapse to one before anything is compared. Tokens travel as packed arrays, by hash of the token,
to tasks of bounded size, beyond ``FAN`` of them by way of ``FAN`` ranges, so that the rows sent grow with the data and
not with its square. Groups that a chain of qualifying pairs joins are opened in one task, up to BLOCK shingles;
larger ones in blocks: each block is first joined to the whole's first member, which most near copies reach, and only
the sets that do not are compared with the other blocks. No pair list of a group is ever emitted. The driver gets the
common tokens, at most COMMON_LIMIT (if there are more, the others' pairs are emitted: more work, not other results).

Defined results: a text without words (or null) has an empty set, links with nothing and is its own component; a
text with fewer than five words has one shingle, all its words; repeated rows link; rows with a null id link as others
do, also others with one another, and have a null component if none that they reach has an id; one id may have several
texts, each of which is a row of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, held, lookup, small_batches, written
from .components import connected_components
from .words import word_hashes

WORDS, PERCENT = 5, 80
SLACK, COMMON, COMMON_LIMIT = 96, 64, 500_000
#: Groups of a token beyond which no pairs are made of them; buckets that a chunk is dealt to at once.
RUN, FAN = 512, 512
#: Shingles: in a task that opens groups, and tokens in a chunk or a bucket of the matrix.
BLOCK, CHUNK = 2_000_000, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FLIP = np.int64(0x5DEECE66D)


def _set(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, from the words' hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    a = h[:n] + np.uint64(k)
    for i in range(1, k):
        a = (a ^ (a >> np.uint64(31))) * _MIX + h[i : i + n]
    a = (a ^ (a >> np.uint64(32))) * _MIX
    return np.unique(a ^ (a >> np.uint64(29)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text."""
    return _set(word_hashes((text or "").encode("utf-8", "replace"))[1], words)


def sets_of(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """The sets of many texts, whose words are hashed together."""
    texts = [t or b"" for t in texts]
    start, h = word_hashes(b"\n".join(texts))
    cut = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    for k in range(len(texts)):
        yield _set(h[cut[k] : cut[k + 1]], words)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-n * percent // 100)


def linked(shared: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def sets(docs: DataFrame, words: int, percent: int, slack: int) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): n, a 128-bit digest of its set, and the kept part of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, d1, d2, kept = [], [], [], []
            for s in sets_of(b.column(1).to_pylist(), words):
                n = len(s)
                x, y = digest(s)
                ns.append(n)
                d1.append(x)
                d2.append(y)
                kept.append(s[: n - _least(n, percent) + slack].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "key", "n", "d1", "d2", "kept"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), _key()).mapInArrow(run, "doc_id long, key long, n long, d1 long, d2 long, kept binary")


def _key() -> Column:
    """What a row's text is found by again: its id, or the text's hash if that is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(n, kept tokens) of the non-empty sets of a batch."""
    for n, k in zip(b.column("n").to_pylist(), b.column("kept").to_pylist(), strict=True):
        if n:
            yield n, np.frombuffer(k, np.uint64)


def _distinct(tokens: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((groups, tokens))
    t, g = tokens[order], groups[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    return t[new], g[new]


def _chunks(pairs: Iterator[tuple[np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (token, group) arrays of about CHUNK tokens each."""
    tokens, groups, held = [], [], 0
    for t, g in pairs:
        tokens.append(t)
        groups.append(np.full(len(t), g, np.int64))
        held += len(t)
        if held >= CHUNK:
            yield _distinct(np.concatenate(tokens), np.concatenate(groups))
            tokens, groups, held = [], [], 0
    if held:
        yield _distinct(np.concatenate(tokens), np.concatenate(groups))


def common_tokens(kept: DataFrame, common: int) -> np.ndarray:
    """Tokens that are in ``common`` groups or more, as far as tasks that meet them twice tell; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = ((k, int(k[:1].view(np.int64)[0])) for b in batches for _, k in _rows(b))
        for t, _ in _chunks(first):
            u, c = np.unique(t, return_counts=True)
            u, c = u[c > 1], c[c > 1]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "groups"])

    found = kept.select("n", "kept").mapInArrow(run, "token long, groups long").groupBy("token").agg(F.sum("groups").alias("groups"))
    top = found.filter(F.col("groups") >= common).orderBy(F.desc("groups"), "token").limit(COMMON_LIMIT).select("token").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def place(n: int, kept: np.ndarray, common: np.ndarray, percent: int, slack: int) -> tuple[int, bool, int, np.ndarray]:
    """Of a set: group, whether it is saturated, how many tokens it shares with any partner at least, the tokens it stores."""
    low = min(int(_least(_least(n, percent), percent)), slack)
    if not len(common):
        return int(kept[:1].view(np.int64)[0]), False, low, kept
    at = np.minimum(np.searchsorted(common, kept), len(common) - 1)
    is_common = common[at] == kept
    f = int(is_common.sum())
    if f >= low:
        return int(kept[is_common][:1].view(np.int64)[0] ^ _FLIP), True, low, kept
    rare = kept[~is_common]
    return int(rare[:1].view(np.int64)[0]), False, low - f, rare


def members(kept: DataFrame, common, percent: int, slack: int) -> DataFrame:
    """(doc_id, key, n, d1, d2, grp, sat, req) of each row; grp is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [place(n, np.frombuffer(k, np.uint64), common.value, percent, slack)[:3] if n else (None, False, 0) for n, k in zip(b.column("n").to_pylist(), b.column("kept").to_pylist(), strict=True)]
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "n", "d1", "d2")), *cols], ["doc_id", "key", "n", "d1", "d2", "grp", "sat", "req"])

    return kept.mapInArrow(run, "doc_id long, key long, n long, d1 long, d2 long, grp long, sat boolean, req int")


def _pairs_of_runs(groups: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of groups that share a token, from runs of groups by token; runs of one length at a time."""
    for r in np.unique(lengths[lengths > 1]):
        s = starts[lengths == r]
        step = max(1, 1_000_000 // (r * r))
        for at in range(0, len(s), step):
            block = groups[s[at : at + step, None] + np.arange(r)]
            if r < 2000:
                i, j = np.triu_indices(r, 1)
                yield block[:, i].ravel(), block[:, j].ravel()
            else:
                for i in range(r - 1):
                    yield np.repeat(block[:, i], r - 1 - i), block[:, i + 1 :].ravel()


def group_overlaps(kept: DataFrame, common, percent: int, slack: int, tokens: int, run: int) -> DataFrame:
    """The matrix, by buckets of tokens, times itself: (g, h, shared tokens), g < h; and (token, null, groups) for each
    token that is not common but has more than ``run`` groups, of which no pairs are made."""
    buckets = max(1, -(-tokens // CHUNK))
    step = -(-buckets // FAN)

    def deal(pieces, size: int) -> Iterator[pa.RecordBatch]:
        for t, g in pieces:
            to = (t % np.uint64(buckets)).astype(np.int64) // size
            order = np.argsort(to, kind="stable")
            t, g = t[order], g[order]
            cut = np.searchsorted(to[order], np.arange(-(-buckets // size) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                part = slice(cut[k], cut[k + 1])
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([t[part].tobytes()], pa.binary()), pa.array([g[part].tobytes()], pa.binary())], ["bucket", "tokens", "groups"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stored():
            for b in batches:
                for n, k in _rows(b):
                    g, _, _, t = place(n, k, common.value, percent, slack)
                    yield t, g

        yield from deal(_chunks(stored()), step)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0
        for b in batches:
            for t, g in zip(b.column("tokens").to_pylist(), b.column("groups").to_pylist(), strict=True):
                own.append((np.frombuffer(t, np.uint64), np.frombuffer(g, np.int64)))
                size += len(own[-1][0])
                if size >= CHUNK:
                    yield from deal([_distinct(*(np.concatenate(c) for c in zip(*own, strict=True)))], 1)
                    own, size = [], 0
        if own:
            yield from deal([_distinct(*(np.concatenate(c) for c in zip(*own, strict=True)))], 1)

    def meet(x: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(v, np.uint64) for v in x.column("tokens").to_pylist()])
        g = np.concatenate([np.frombuffer(v, np.int64) for v in x.column("groups").to_pylist()])
        t, g = _distinct(t, g)
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        lengths = np.diff(np.r_[starts, len(t)])
        long = lengths > run
        if long.any():
            first = t[starts[long]]
            at = np.minimum(np.searchsorted(common.value, first), max(0, len(common.value) - 1))
            long[long] = common.value[at] != first if len(common.value) else True
        found = t[starts[long]].view(np.int64), lengths[long]
        starts, lengths = starts[~long], lengths[~long]
        held, size = [], 0

        def merged(parts):
            a, b, c = (np.concatenate(v) for v in zip(*parts, strict=True))
            order = np.lexsort((b, a))
            a, b, c = a[order], b[order], c[order]
            at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return a[at], b[at], np.add.reduceat(c, at)

        for a, b in _pairs_of_runs(g, starts, lengths):
            held.append((a, b, np.ones(len(a), np.int64)))
            size += len(a)
            if size > 2_000_000:
                held = [merged(held)]
                size = len(held[0][0])
        a, b, c = merged(held) if held else (np.zeros(0, np.int64),) * 3
        a, c = np.r_[a, found[0]], np.r_[c, found[1]]
        return pa.table({"g": pa.array(a, pa.int64()), "h": pa.array([*b.tolist(), *[None] * len(found[0])], pa.int64()), "shared": pa.array(c, pa.int64())})

    packed = kept.select("n", "kept").mapInArrow(spread, "bucket long, tokens binary, groups binary")
    if step > 1:
        packed = packed.repartition("bucket").mapInArrow(again, packed.schema)
    return packed.groupBy("bucket").applyInArrow(meet, "g long, h long, shared long").groupBy("g", "h").agg(F.sum("shared").alias("shared"))


class _Sets:
    """Sets in memory with an inverted index; ``shared`` counts the overlap of one with all."""

    def __init__(self, own: list[np.ndarray]):
        self.own, self.n = own, np.array([len(s) for s in own], np.int64)
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(own)), self.n)
        order = np.argsort(every, kind="stable")
        self.tokens, self.owner = every[order], owner[order]

    def shared(self, s: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        size = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=len(self.n))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def join_sets(own: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (as the least index in it) of each set, exactly. The first set is compared with all; after that, only
    sets outside its component are: of two sets in it, the link would change nothing."""
    x, parent = _Sets(own), np.arange(len(own))
    for i in range(len(own)):
        if i and _root(parent, i) == 0:
            continue
        for j in np.flatnonzero(linked(x.shared(own[i]), len(own[i]), x.n, percent)):
            a, b = _root(parent, i), _root(parent, int(j))
            parent[max(a, b)] = min(a, b)
    return np.array([_root(parent, i) for i in range(len(own))])


def _opened(x: pa.Table, words: int) -> list[tuple]:
    """(sg, (no id, rep), d1, d2, role, set) of the rows of a task whose text has the set asked for (ids may repeat), once each."""
    out, seen = [], set()
    cols = [x.column(c).to_pylist() for c in ("sg", "no_id", "rep", "d1", "d2", "role", "text")]
    for sg, no_id, rep, d1, d2, role, text in zip(*cols, strict=True):
        if (sg, d1, d2, role) not in seen:
            s = shingles(text, words)
            if digest(s) == (d1, d2):
                seen.add((sg, d1, d2, role))
                out.append((sg, (no_id, rep), d1, d2, role, s))
    return sorted(out, key=lambda r: (r[0], r[1], r[2], r[3], r[4]))


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def open_groups(wanted: DataFrame, docs: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(d1, d2, component) of the sets in ``wanted`` (no_id, rep, d1, d2, n, sg, shingles of the whole sg)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").isNull().alias("no_id"), _key().alias("rep"), "text")
    total, count = wanted.agg(F.sum("n"), F.count(F.lit(1))).first()
    small = count <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(wanted) if small else wanted, ["no_id", "rep"]).withColumn("role", F.lit(0))
    buckets = max(1, -(-(total or 0) // max(1, block // 2)))

    def whole(x: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        for r in _opened(x, words):
            by.setdefault(r[0], []).append(r)
        out = []
        for own in by.values():
            for r, k in zip(own, join_sets([r[5] for r in own], percent), strict=True):
                no_id, rep = own[k][1]  # rows are sorted by it: the least index has the least id, if any has one
                out.append((r[2], r[3], None if no_id else rep))
        return _table(out, ["d1", "d2", "component"])

    fits = F.col("of") <= block
    small_groups = rows.filter(fits).withColumn("bucket", F.pmod(F.xxhash64("sg"), F.lit(buckets)))
    done = small_groups.groupBy("bucket").applyInArrow(whole, "d1 long, d2 long, component long")
    large = wanted.filter(~fits)
    if large.isEmpty():
        return done

    # -- blocks: first within each, together with the whole's first member; then the sets that it does not reach, with all
    def first_step(x: pa.Table) -> pa.Table:
        own = _opened(x, words)
        own.sort(key=lambda r: -r[4])  # role 1, the first member of all, is compared with the whole block
        k = join_sets([r[5] for r in own], percent)
        led = bool(own) and own[0][4] == 1
        return _table([(r[0], r[2], r[3], own[i][2], r[4], int(led and i == 0)) for r, i in zip(own, k, strict=True)], ["sg", "d1", "d2", "root", "role", "reached"])

    def second_step(x: pa.Table) -> pa.Table:
        own = _opened(x, words)
        asked, there = [r for r in own if r[4] == 2], [r for r in own if r[4] == 0]
        index, out = _Sets([r[5] for r in there]), []
        for r in asked:
            for j in np.flatnonzero(linked(index.shared(r[5]), len(r[5]), index.n, percent)) if there else ():
                out.append((r[2], there[j][2]))
        return _table(out, ["a", "b"])

    big = rows.filter(~fits).withColumn("blocks", F.ceil(F.col("of") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int"))
    big = held(big)
    heads = big.groupBy("sg").agg(F.min(F.struct("no_id", "rep", "d1", "d2")).alias("h")).select("sg", "h.*")
    lead = big.join(heads, ["sg", "no_id", "rep", "d1", "d2"], "left_semi").withColumn("role", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = big.unionByName(lead).groupBy("sg", "block").applyInArrow(first_step, "sg long, d1 long, d2 long, root long, role long, reached long")
    near = held(near)
    rest = near.filter("reached = 0 and role = 0").select("sg", "d1", "d2")
    asked = big.join(rest, ["sg", "d1", "d2"], "left_semi")
    much = asked.groupBy("sg").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts"))
    asked = asked.join(much, "sg").withColumn("part", F.pmod(F.xxhash64("d2", "d1"), F.col("parts")).cast("int"))
    asked = asked.withColumn("role", F.lit(2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    there = big.join(much, "sg").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    far = asked.unionByName(there).groupBy("sg", "block", "part").applyInArrow(second_step, "a long, b long")
    links = near.select(F.col("d1").alias("a"), F.col("root").alias("b")).unionByName(far)
    nodes = big.select("d1", "d2", F.when(~F.col("no_id"), F.col("rep")).alias("rep")).distinct()
    found = nodes.join(connected_components(links).withColumnRenamed("node", "d1"), "d1", "left").withColumn("c", F.coalesce("component", "d1"))
    least = found.groupBy("c").agg(F.min("rep").alias("least"))
    return done.unionByName(found.join(least, "c").select("d1", "d2", F.col("least").alias("component")))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, slack: int = SLACK, common: int = COMMON, run: int = RUN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text): its set's size and the least id its links reach."""
    spark = docs.sparkSession
    kept = written(sets(docs, words, percent, slack), "jaccard-sets")
    tokens = kept.agg(F.sum(F.octet_length("kept"))).first()[0] or 0
    known = common_tokens(kept, common)
    while True:
        often = spark.sparkContext.broadcast(known)
        matrix = held(group_overlaps(kept, often, percent, slack, tokens // 8, run if len(known) < COMMON_LIMIT else tokens))
        more = matrix.filter("h is null").orderBy(F.desc("shared"), "g").limit(COMMON_LIMIT - min(len(known), COMMON_LIMIT)).select("g").collect()
        if not more:
            break
        matrix.unpersist()
        known = np.union1d(known, np.array([r[0] for r in more], np.int64).view(np.uint64))
    rows = held(members(kept, often, percent, slack))
    # equal sets collapse here; a set with a third of all rows is one row of each task's partial aggregate
    reps = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("key").alias("rep"))).alias("r"), *(F.min(c).alias(c) for c in ("n", "grp", "req")), F.max("sat").alias("sat"), F.count(F.lit(1)).alias("copies"))
    reps = held(reps.select("d1", "d2", "r.no_id", "r.rep", "n", "grp", "sat", "req", "copies"))
    groups = held(reps.groupBy("grp").agg(F.max("sat").alias("sat"), F.min("req").alias("req"), F.min("n").alias("least"), F.max("n").alias("most")))
    pairs = matrix
    for side in "gh":
        pairs = pairs.join(groups.select(F.col("grp").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("sat", "req", "least", "most"))), side)
    asked = F.when(F.col("sat_g") == F.col("sat_h"), F.greatest("req_g", "req_h")).when(F.col("sat_g"), F.col("req_h")).otherwise(F.col("req_g"))
    sizes = (100 * F.col("most_g") >= percent * F.col("least_h")) & (100 * F.col("most_h") >= percent * F.col("least_g"))
    links = pairs.filter((F.col("shared") >= asked) & sizes).select(F.col("g").alias("a"), F.col("h").alias("b"))
    chains = connected_components(links).select(F.col("node").alias("grp"), F.col("component").alias("chain"))
    matrix.unpersist()
    placed = held(reps.join(chains, "grp", "left").withColumn("sg", F.coalesce("chain", "grp")).select("no_id", "rep", "d1", "d2", "n", "sg"))
    more = held(placed.groupBy("sg").agg(F.count("*").alias("sets"), F.sum("n").alias("of")).filter("sets > 1").drop("sets"))
    wanted = held(lookup(placed, more, "sg").filter("of is not null"))
    opened = open_groups(wanted, docs, words, percent, block)
    # a set of one document that links with nothing is its own component; the others are looked up, salted if they are many
    own_id = F.when(~F.col("no_id"), F.col("rep"))
    classes = reps.join(opened, ["d1", "d2"], "left").withColumn("found", F.coalesce("component", own_id)).filter((F.col("copies") > 1) | ~F.col("found").eqNullSafe(own_id))
    classes = held(classes.select(F.struct("d1", "d2").alias("set"), "found", F.lit(True).alias("known")))
    out = lookup(rows.withColumn("set", F.struct("d1", "d2")), classes, "set")
    own = F.when((F.col("n") == 0) | F.col("known").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
