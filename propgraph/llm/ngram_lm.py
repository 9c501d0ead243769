"""Language-model scoring with an Elias-Fano n-gram trie.

The model is a trigram model with interpolated absolute discounting over an additive unigram model:

    P1(w)        = (c(w) + 0.1) / (N + 0.1 (V + 1))
    Pk(w | ctx)  = max(c(ctx w) - D, 0) / c(ctx) + gamma(ctx) P(k-1)(w | shorter ctx)

gamma(ctx) is what the kept n-grams of ctx leave, so that each distribution sums to one. All n-grams are kept that
occur ``KEEP`` times or more, however rare their words are; all counts are over all training text.

The trie is three levels of files, sharded by ranges of equal mass. Level 1: the words' 64-bit hashes, an Elias-Fano
sequence; a word's id is its place. Levels 2 and 3: the contexts, an Elias-Fano sequence of ids; monotone pointers to
each context's first child, and the children as one Elias-Fano sequence (context rank times range plus child). A
child of level 3 is not a word's id but its place among the children, in level 2, of the word before it: the
context-relative id. Discounted probabilities and gammas are quantised to 16 bits of their logarithm. Queries are
sorted and answered by successor search, many at a time.

Files lie in the shared folder (``spark.checkpoint.dir``), which must be a file system that executors mount: they are
memory-mapped there. Building is three passes of counting. In each, a task merges the counts of its text, up to
``MERGE`` entries at a time, and sends packed arrays to the shards. Beyond ``FAN`` shards they go by way of ``FAN``
ranges of shards, where counts are merged again before they are dealt, so that the rows sent grow with the data and
not with its square. A hot word or n-gram is one entry of each task, and a context with too much mass for a shard is
cut into several. The driver gets a few numbers of each shard; executors read these from a file beside the levels.

Defined results: a null text is empty (it has the end token alone); words are compared by 64-bit hashes; ids that are
null are trained on; repeated rows count as often as they occur; with no training rows each probability is that of
an unknown word, 1. Other columns than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import eliasfano as ef
from .common import held, new_path, small_batches
from .words import word_hashes

ADD, DISCOUNT, KEEP = 0.1, 0.75, 2
#: N-grams with a rarer word are not counted; none of them can occur KEEP times, so nothing that is kept is lost.
WORD_COUNT = KEEP
#: Tokens: of a chunk of text that is counted at a time, and of a shard of the trie. Points of mass that each shard tells the driver.
CHUNK_BYTES, SHARD_TOKENS, POINTS = 8 << 20, 4_000_000, 16
#: Entries that a task merges before it sends them; shards that it sends to at once.
MERGE, FAN = 2_000_000, 512
_RANGE, _STEPS = 12.0, 65535
#: Hashes of no word: words have no white space, and these are of texts with some.
END, START = np.uint64(0x5F2E6B1D9C3A7A01), np.uint64(0x5F2E6B1D9C3A7A03)

def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows' first columns, tokens' hashes, each row's first token) of about CHUNK_BYTES of text; texts are the last column."""
    rows, texts, size = [], [], 0

    def flush():
        data = b"\n".join(texts)
        start, h = word_hashes(data)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        words = np.diff(np.searchsorted(start, begin))
        ends = np.cumsum(words + 1) - 1
        out = np.empty(len(h) + len(texts), np.uint64)
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[is_end], out[~is_end] = END, h
        return rows, out, np.r_[0, ends[:-1] + 1]

    for b in batches:
        for *row, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows.append(row)
            texts.append(t or b"")
            size += len(texts[-1]) + 1
            if size >= CHUNK_BYTES:
                yield flush()
                rows, texts, size = [], [], 0
    if rows:
        yield flush()


# -- packed counts --------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """Differences of sorted keys, byte plane by byte plane: the high planes are zeros, which shuffles compress."""
    return np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct keys and their counts, of as many parts as have MERGE entries together."""
    own, size = [], 0
    for keys, counts in parts:
        own.append((keys, counts.astype(np.int64)))
        size += len(keys)
        if size >= MERGE:
            own = [_sum(*(np.concatenate(c) for c in zip(*own, strict=True)))]
            size = len(own[0][0])
            if size >= MERGE // 2:
                yield own[0]
                own, size = [], 0
    if own:
        yield _sum(*(np.concatenate(c) for c in zip(*own, strict=True)))


def _spread(parts: Iterator[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Merged keys and counts, a row for each shard (bounds are the shards' first keys, but the first's)."""
    for keys, counts in _merged(parts):
        cut = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
        for k in np.flatnonzero(np.diff(cut)):
            part = slice(cut[k], cut[k + 1])
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([_planes(keys[part])], pa.binary()), pa.array([counts[part].astype(np.uint32).tobytes()], pa.binary())], ["shard", "keys", "counts"])


PACKED = "shard long, keys binary, counts binary"


def _dealt(texts: DataFrame, count, shards: int, bounds) -> DataFrame:
    """The packed counts that ``count`` gives for texts, by shard; by way of ranges of shards if there are many.
    ``bounds`` gives the shards' first keys, in tasks."""
    step = -(-shards // FAN)

    def first(batches):
        yield from _spread(count(batches), bounds()[step - 1 :: step])

    def second(batches):
        parts = ((_keys(k), np.frombuffer(c, np.uint32)) for b in batches for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True))
        yield from _spread(parts, bounds())

    out = texts.mapInArrow(first, PACKED)
    return out if step == 1 else out.repartition("shard").mapInArrow(second, PACKED)


def _merge(x: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Shard, sorted keys and summed counts of a shard's rows."""
    keys = np.concatenate([_keys(v) for v in x.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(v, np.uint32) for v in x.column("counts").to_pylist()]).astype(np.int64)
    return int(x.column("shard")[0].as_py()), *_sum(keys, counts)


def _points(ids: np.ndarray, mass: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(id, mass before it, its mass) where the running mass passes equal steps: fewer of them where shards are many."""
    before = np.cumsum(mass) - mass
    steps = np.linspace(0, int(mass.sum()), max(2, min(POINTS, 65_536 // shards)), endpoint=False)
    at = np.unique(np.maximum(np.searchsorted(before, steps, "right") - 1, 0)) if len(ids) else []
    return [(int(ids[i]), int(before[i]), int(mass[i])) for i in at]


def _bounds(points: list[tuple[int, int, int]], total: int, spread: int, shards: int) -> np.ndarray:
    """First keys (id * spread + child) of shards 1.. of about equal mass; an id with more mass is cut among its children."""
    if not points:
        return np.zeros(0, np.uint64)
    ids, before, mass = (np.array(c, np.int64) for c in zip(*points, strict=True))
    out = []
    for m in (total * k // shards for k in range(1, shards)):
        i = max(0, int(np.searchsorted(before, m, "right")) - 1)
        part = min(1.0, (m - int(before[i])) / max(1, int(mass[i])))
        out.append((int(ids[i]) + (part >= 1)) * spread + (int(part * spread) if part < 1 else 0))
    return np.unique(np.array(out, np.uint64))


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * (_STEPS / _RANGE)), 0, _STEPS).astype(np.uint16)


_VALUES = 10.0 ** (-np.arange(_STEPS + 1) * (_RANGE / _STEPS))

# -- the model, as executors see it ---------------------------------------------------------------------------------

_opened: dict[str, Trie] = {}


def _slim(info: dict) -> dict:
    """``info`` for tasks: the numbers of the shards, whose number grows with the data, go to a file beside the levels."""
    arrays = {k: v for k, v in info.items() if isinstance(v, np.ndarray)}
    ef.save(f"{info['path']}/info-{info['levels']}", arrays)
    return {k: v for k, v in info.items() if k not in arrays}


class Trie:
    """Memory-mapped levels. ``info`` holds a few numbers of each shard, also memory-mapped."""

    def __init__(self, info: dict):
        self.info, self.files = ef.load(f"{info['path']}/info-{info['levels']}") | info, {}

    @staticmethod
    def of(info: dict) -> Trie:
        """The one of this process: files stay mapped from batch to batch."""
        key = f"{info['path']}:{info['levels']}"
        if key not in _opened:
            _opened.clear()
            _opened[key] = Trie(info)
        return _opened[key]

    def shard(self, level: int | str, k: int) -> dict:
        if (level, k) not in self.files:
            a = ef.load(f"{self.info['path']}/{level}-{k}")
            for name in {x.split(".")[0] for x in a if "." in x}:
                a[name] = ef.part(name, a)
            self.files[level, k] = a
        return self.files[level, k]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted distinct hashes; V and 0 for those that are not in the training text."""
        ids, counts = np.full(len(hashes), self.info["V"], np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(hashes, self.info["bounds1"])
        cut = np.r_[0, cut, len(hashes)]
        for k in np.flatnonzero(np.diff(cut)):
            if self.info["n1"][k]:
                s, part = self.shard(1, int(k)), slice(cut[k], cut[k + 1])
                at = s["word"].find(hashes[part])
                ok = at >= 0
                ids[part][ok] = at[ok] + self.info["base1"][k]
                counts[part][ok] = s["count"][at[ok]]
        return ids, counts

    def by_id(self, level: int | str, base: np.ndarray, name: str, ids: np.ndarray) -> np.ndarray:
        """``name``'s values at global places ``ids`` (any order)."""
        out = np.zeros(len(ids), np.int64)
        k = np.searchsorted(base, ids, "right") - 1
        for j in np.unique(k):
            own = k == j
            out[own] = self.shard(level, int(j))[name][ids[own] - base[j]]
        return out

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of contexts of level 2: words, or the start."""
        out = np.full(len(ids), self.info["docs"], np.int64)
        known = ids < self.info["V"]
        out[known] = self.by_id(1, self.info["base1"], "count", ids[known])
        return out

    def nodes(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(global node or -1, place among its context's children, discounted probability) of sorted keys (context * range + child)."""
        i = self.info
        node, place, p = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        spread = np.uint64(i[f"range{level}"])
        cut = np.r_[0, np.searchsorted(keys, i[f"bounds{level}"]), len(keys)]
        for k in np.flatnonzero(np.diff(cut)):
            if not i[f"n{level}"][k]:
                continue
            s, part = self.shard(level, int(k)), slice(cut[k], cut[k + 1])
            ctx, child = np.divmod(keys[part], spread)
            run = np.r_[True, ctx[1:] != ctx[:-1]]  # a context is looked up once
            own = s["context"].find(ctx[run])
            base = i[f"base{level}"][k]
            begin = np.zeros(len(own), np.int64)
            begin[own >= 0] = s["pointer"].get(own[own >= 0]).astype(np.int64) + base
            begin[own == 0] = i[f"first{level}"][k]  # the first context may begin in a shard before
            of = np.cumsum(run) - 1
            r = own[of]
            ok = np.flatnonzero(r >= 0)
            at = s["child"].find(r[ok].astype(np.uint64) * spread + child[ok])
            ok, at = ok[at >= 0], at[at >= 0]
            node[part][ok] = at + base
            place[part][ok] = at + base - begin[of[ok]]
            p[part][ok] = _VALUES[s["p"][at]]
        return node, place, p

    def gamma(self, level: int, ids: np.ndarray) -> np.ndarray:
        """What contexts leave to shorter ones; 1 for those without kept children (id -1, or an unknown word)."""
        i, out = self.info, np.ones(len(ids))
        if level == 2:
            out[ids == i["V"] + 1] = i["gamma_start"]
            known = np.flatnonzero((ids >= 0) & (ids < i["V"]))
            base, name = i["base1"], "gamma1"
        else:
            known, base, name = np.flatnonzero(ids >= 0), i["base2"], "gamma2"
        known = known[i[f"has_{name}"][np.searchsorted(base, ids[known], "right") - 1]]  # of other shards no context has kept children
        out[known] = _VALUES[self.by_id(name, base, "gamma", ids[known])]
        return out


def _sequence(t: Trie, h: np.ndarray, first: np.ndarray) -> tuple:
    """Of tokens: id, the id before (the start's at first), count, and whether both words are common enough for an n-gram that is kept."""
    u, inverse = np.unique(h, return_inverse=True)
    ids, counts = t.words(u)
    w, c = ids[inverse], counts[inverse]
    common = (c >= WORD_COUNT) | (h == END) & (c > 0)
    before, fit = np.empty_like(w), np.empty_like(common)
    before[1:], fit[1:] = w[:-1], common[:-1]
    before[first], fit[first] = t.info["V"] + 1, True
    return w, before, c, common & fit


def _bigrams(t: Trie, w: np.ndarray, before: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, place and probability of each token after the one before it."""
    node, place, p = np.full(len(w), -1, np.int64), np.zeros(len(w), np.int64), np.zeros(len(w))
    u, inverse = np.unique(before[ok].astype(np.uint64) * np.uint64(t.info["range2"]) + w[ok].astype(np.uint64), return_inverse=True)
    for out, found in zip((node, place, p), t.nodes(2, u), strict=True):
        out[ok] = found[inverse]
    return node, place, p


def _trigrams(t: Trie, node: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context of two (the node before, or -1), and the key that its trigram would have (where the token's own bigram is kept)."""
    ctx = np.r_[-1, node[:-1]] if len(node) else node
    ctx[first] = -1
    has = (ctx >= 0) & (node >= 0)
    return ctx, np.flatnonzero(has)


# -- building -------------------------------------------------------------------------------------------------------


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: the trie is memory-mapped, which needs a shared folder that executors mount")
    return path


def _write_level(trie: Trie, level: int, k: int, keys: np.ndarray, counts: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Writes a shard of level 2 or 3; gives its numbers, its contexts, and the share of each that its children take."""
    spread = np.uint64(trie.info[f"range{level}"])
    kept = counts >= KEEP
    keys, counts = keys[kept], counts[kept]
    ctx, child = np.divmod(keys, spread)
    start = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
    contexts = ctx[start].astype(np.int64)
    size = np.diff(np.r_[start, len(ctx)])
    of = trie.counts_of(contexts) if level == 2 else trie.by_id(2, trie.info["base2"], "count", contexts)
    p = (counts - DISCOUNT) / np.repeat(of, size)
    rank = np.repeat(np.arange(len(start)), size).astype(np.uint64)
    arrays = ef.named("context", ef.build(contexts)) | ef.named("pointer", ef.build(np.r_[start, len(ctx)])) | ef.named("child", ef.build(rank * spread + child))
    arrays |= {"p": _code(p)} | ({"count": counts} if level == 2 else {})
    ef.save(f"{trie.info['path']}/{level}-{k}", arrays)
    stats = {"n": len(keys), "mass": int(counts.sum()), "first": int(contexts[0]) if len(contexts) else -1, "last": int(contexts[-1]) if len(contexts) else -1, "last_start": int(start[-1]) if len(start) else 0, "contexts": len(contexts), "most": int(size.max()) if len(size) else 0}
    share = np.add.reduceat(p, start) if len(start) else np.zeros(0)
    return stats | {"points": _points(np.arange(len(keys)), counts, len(trie.info[f"bounds{level}"]) + 1)}, contexts, share


ROW = "kind string, shard long, n long, mass long, first long, last long, last_start long, contexts long, most long, points array<array<long>>, ids binary, shares binary"
_NUMBERS = ("n", "mass", "first", "last", "last_start", "contexts", "most")
_TYPES = [pa.string(), *[pa.int64()] * 8, pa.list_(pa.list_(pa.int64())), pa.binary(), pa.binary()]


def _out(rows: list[dict]) -> pa.Table:
    names = [x.split()[0] for x in ROW.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in zip(names, _TYPES, strict=True)})


def _collect(df: DataFrame, shards: int) -> list[dict]:
    """The shards' numbers, in order; those without rows have zeros."""
    empty = {"n": 0, "mass": 0, "first": -1, "last": -1, "last_start": 0, "contexts": 0, "most": 0, "points": []}
    found = {r["shard"]: r.asDict() for r in df.filter("kind = 'shard'").drop("ids", "shares").collect()}
    return [found.get(k, empty) for k in range(shards)]


def _global_points(stats: list[dict], base: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    out, mass = [], 0
    for s, b in zip(stats, base, strict=True):
        out += [(i + int(b), m + mass, own) for i, m, own in s["points"]]
        mass += s["mass"]
    return out, mass


def train(docs: DataFrame, shard_tokens: int | None = None) -> dict:
    """The model of ``docs`` (text): its files' place and their numbers, for ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    per = shard_tokens or SHARD_TOKENS
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    n_bytes, n_docs = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    shards = max(1, -(-int((n_bytes or 0) / 6) // per))
    uri = new_path(spark, "ngram-trie")
    path = _local(uri)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(uri)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    info = {"path": path, "docs": n_docs, "levels": 0}

    # level 1: words, in equal ranges of their hashes
    def count_words(batches):
        return (np.unique(h, return_counts=True) for _, h, _ in chunks(batches))

    def word_bounds() -> np.ndarray:
        return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)

    def write_words(x: pa.Table) -> pa.Table:
        k, keys, counts = _merge(x)
        ef.save(f"{path}/1-{k}", ef.named("word", ef.build(keys)) | {"count": counts})
        # kept n-grams begin with words that repeat, and END begins none
        mass = np.where((counts >= WORD_COUNT) & (keys != END), counts, 0)
        return _out([{"kind": "shard", "shard": k, "n": len(keys), "mass": int(mass.sum()), "most": int(counts.sum()), "points": _points(np.arange(len(keys)), mass, shards)}])

    words = held(_dealt(texts, count_words, shards, word_bounds).groupBy("shard").applyInArrow(write_words, ROW))
    stats = _collect(words, shards)
    n1 = np.array([s["n"] for s in stats], np.int64)
    base1 = np.cumsum(n1) - n1
    V, N = int(n1.sum()), sum(s["most"] for s in stats)
    points, mass = _global_points(stats, base1)
    points.append((V + 1, mass, n_docs))  # the start
    info |= {"levels": 1, "bounds1": word_bounds(), "n1": n1, "base1": base1, "V": V, "N": N, "range2": V + 2, "bounds2": _bounds(points, mass + n_docs, V + 2, shards)}

    def build(level: int, count) -> list[dict]:
        at, size, lower = _slim(info), len(info[f"bounds{level}"]) + 1, f"gamma{level - 1}"

        def write(x: pa.Table) -> pa.Table:
            k, keys, counts = _merge(x)
            t = Trie.of(at)
            own, contexts, share = _write_level(t, level, k, keys, counts)
            rows = [{"kind": "shard", "shard": k} | {n: own[n] for n in _NUMBERS} | {"points": [list(p) for p in own["points"]]}]
            base = t.info[f"base{level - 1}"]
            to = np.searchsorted(base, contexts, "right") - 1
            to[contexts >= at["V"] if level == 2 else np.zeros(len(to), bool)] = -1  # the start's
            for j in np.unique(to):
                rows.append({"kind": "share", "shard": int(j), "ids": contexts[to == j].tobytes(), "shares": share[to == j].tobytes()})
            return _out(rows)

        def write_gammas(x: pa.Table) -> pa.Table:
            j = int(x.column("shard")[0].as_py())
            ids = np.concatenate([np.frombuffer(v, np.int64) for v in x.column("ids").to_pylist()])
            shares = np.concatenate([np.frombuffer(v, np.float64) for v in x.column("shares").to_pylist()])
            if j < 0:
                return _out([{"kind": "start", "shard": j, "shares": np.float64(shares.sum()).tobytes()}])
            i = Trie.of(at).info
            taken = np.bincount(ids - i[f"base{level - 1}"][j], shares, minlength=int(i[f"n{level - 1}"][j]))
            ef.save(f"{path}/{lower}-{j}", {"gamma": _code(np.maximum(1 - taken, 0))})
            return _out([{"kind": "gamma", "shard": j}])

        def own_bounds() -> np.ndarray:
            return Trie.of(at).info[f"bounds{level}"]

        def counted(batches):
            return count(Trie.of(at), batches)

        found = held(_dealt(texts, counted, size, own_bounds).groupBy("shard").applyInArrow(write, ROW))
        gammas = found.filter("kind = 'share'").groupBy("shard").applyInArrow(write_gammas, ROW).select("kind", "shard", "shares").collect()
        info[f"has_{lower}"] = np.zeros(len(info[f"n{level - 1}"]), bool)
        info[f"has_{lower}"][[r["shard"] for r in gammas if r["kind"] == "gamma"]] = True
        if level == 2:
            info["gamma_start"] = 1 - sum(np.frombuffer(r["shares"], np.float64)[0] for r in gammas if r["kind"] == "start")
        stats = _collect(found, size)
        n = np.array([s["n"] for s in stats], np.int64)
        base_k, first, last = np.cumsum(n) - n, [], None  # last: (context, global start, shards it has been seen in)
        longest = 1
        for s, b in zip(stats, np.cumsum(n) - n, strict=True):
            goes_on = last is not None and s["contexts"] and s["first"] == last[0]
            first.append(last[1] if goes_on else int(b))
            if s["contexts"]:
                whole = goes_on and s["contexts"] == 1
                last = (s["last"], last[1] if whole else int(b) + s["last_start"], last[2] + 1 if whole else (2 if goes_on and s["contexts"] == 1 else 1))
                longest = max(longest, last[2] + 1)
        info[f"n{level}"], info[f"base{level}"], info[f"first{level}"], info["levels"] = n, base_k, np.array(first, np.int64), level
        info[f"most{level}"] = longest * max((s["most"] for s in stats), default=0)
        return stats

    # level 2: pairs
    def count_pairs(t: Trie, batches):
        for _, h, first in chunks(batches):
            w, before, _, ok = _sequence(t, h, first)
            yield np.unique(before[ok].astype(np.uint64) * np.uint64(t.info["range2"]) + w[ok].astype(np.uint64), return_counts=True)

    stats = build(2, count_pairs)
    points, mass = _global_points(stats, info["base2"])
    spread = max(1, info["most2"])
    info |= {"range3": spread, "bounds3": _bounds(points, mass, spread, shards)}

    # level 3: triples, as node of the first two and place of the last among the second's children
    def count_triples(t: Trie, batches):
        for _, h, first in chunks(batches):
            w, before, _, ok = _sequence(t, h, first)
            node, place, _ = _bigrams(t, w, before, ok)
            ctx, has = _trigrams(t, node, place, first)
            yield np.unique(ctx[has].astype(np.uint64) * np.uint64(t.info["range3"]) + place[has].astype(np.uint64), return_counts=True)

    build(3, count_triples)
    return info


# -- scoring --------------------------------------------------------------------------------------------------------


def score_tokens(t: Trie, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its count, the base's log10 probability, the model's."""
    w, before, c, ok = _sequence(t, h, first)
    p1 = (c + ADD) / (t.info["N"] + ADD * (t.info["V"] + 1))
    node, place, p2 = _bigrams(t, w, before, ok)
    p2 += t.gamma(2, before) * p1
    ctx, has = _trigrams(t, node, place, first)
    p3 = t.gamma(3, ctx) * p2
    u, inverse = np.unique(ctx[has].astype(np.uint64) * np.uint64(t.info["range3"]) + place[has].astype(np.uint64), return_inverse=True)
    p3[has] += t.nodes(3, u)[2][inverse]
    return c, np.log10(p1), np.log10(p3)


def score(docs: DataFrame, info: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row of ``docs`` (doc_id, text)."""

    slim = _slim(info)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trie.of(slim)
        for rows, h, first in chunks(batches):
            c, base, own = score_tokens(t, h, first)
            n = np.diff(np.r_[first, len(h)])
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), *(pa.array(np.add.reduceat(x, first)) for x in (base, own))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out() -> Column:
    """The documents that are not learned from: crc32 of the id as text is divisible by 10. A null id is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op6_ngram_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    info = train(docs.filter(~held_out()))
    out = score(docs, info)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(info["N"]).cast("long").alias("train_tokens"), "base_score", "score")
