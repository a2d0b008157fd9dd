"""Near duplicates: an exact Jaccard self-join of shingle sets with signature trees.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets link when
``100 * intersection >= 75 * union``. The join goes like this:

1. Sets are hashed (128 bits); documents of an equal set form a class, and only classes go on.
2. Each set's shingles are ordered, those that repeat in the corpus last. Sets that link share a key
   among their first ``n - ceil(0.75 n) + 1`` shingles, the leads, whatever the order; and where the
   prefix goes on by another tenth of the set, they share that much more of it. So a class that shares
   fewer keys of its prefix than that with all others together links with none and goes.
   (key, class) pairs travel as packed arrays, dealt by key; a key that very many documents hold is
   dealt in parts.
3. Classes that share a lead form a group; equal groups are done once. A group's classes form signature
   trees: leaves of a few sets, nodes with OR-combined bitmaps of their tokens and ranges of set
   size. Dual traversal drops node pairs whose sizes are too far apart, whose greatest possible
   overlap is too small, or that are in one component already. All pairs that are ever compared
   come from these traversals.
4. First each class goes with its set to the largest of its groups alone, where pairs that the
   traversal leaves are compared as it meets them: near copies grow together there, each after few
   comparisons. Groups of more than CHUNK classes are dealt in chunks, and once more in others.
5. Then, of groups whose classes are in several components still, trees of bitmaps propose for each
   component the likeliest pair, dealt in other chunks each time, while any of these pairs links.
6. At last the trees give all pairs between components that are left, in chunk pairs; none is needed
   within a group's largest component. They are compared set by set; links give components by
   star contraction over the components found before.

Bitmaps bound the overlap from above (bits in common, plus what either set has in excess of
its bits), so pruning loses no link.

Defined results: a null text counts as empty; an empty set links with nothing, its component is
the document's own id; with less than five words the whole sequence is the one shingle; rows of a null
doc_id get the smallest id that they reach, null if there is none; repeated rows stay; other
columns are ignored, whatever their names; an empty table gives no rows. Sets are compared by hashes of
48 bits, so two different shingles of a pair count as one with a chance of 1e-9 at 500 shingles a set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, few, once, staged, tidy, trim
from .common import kind_of as _kind
from .common import small as _small

K, PERCENT = 5, 75
#: By how many percent of its set a class's prefix goes on beyond the leads.
EXTRA = 10
#: Classes of a group that one tree holds; sets of a leaf and children of a node; 64-bit words of a bitmap.
CHUNK, LEAF, FANOUT, WORDS = 1024, 16, 8, 32
#: Proposing goes on while a round's likely pairs link, for so many rounds at most; it affects speed only.
TURNS = 12
#: Repeated shingles kept for the order of keys, by count; it affects speed only.
FREQUENT, LEAST_COUNT = 400_000, 4
#: A key of more documents than this is dealt in parts of as many; it affects speed only.
HOT = 20_000
#: Shingles that a worker counts together, and keys that it holds before it passes them on.
HELD, PASSED = 1_000_000, 300_000
#: Below so many hashes the tighter coding is the longer one.
FEW = 37
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33), np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < K:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.array([xxhash.xxh64_intdigest(x) for x in words], np.uint64)
    h = w[: len(w) - K + 1].copy()
    for j in range(1, K):
        h = h * _MIX[3] + w[j : len(w) - K + 1 + j]
    h ^= h >> _MIX[2]
    h *= _MIX[0]
    h ^= h >> _MIX[2]
    h *= _MIX[1]
    h ^= h >> _MIX[2]
    return np.unique(h)


def class_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def short_of(c: bytes) -> int:
    """39 bits of a class, as keys carry it. Classes that have them in common are candidates together."""
    return int.from_bytes(c[:5]) >> 1


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = s % np.uint64(64 * WORDS)
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_or.at(out, (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    return out


def needed(a, b):
    """The least overlap of linked sets of a and b tokens."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def room(n1: np.ndarray, m1: np.ndarray, n2: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """By pair: the greatest overlap that bitmaps leave room for."""
    over = np.minimum(n1 - np.bitwise_count(m1).sum(-1, dtype=np.int64), n2 - np.bitwise_count(m2).sum(-1, dtype=np.int64))
    return np.bitwise_count(m1 & m2).sum(-1, dtype=np.int64) + over


def may_link(n1: np.ndarray, m1: np.ndarray, n2: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """By pair: whether sizes and bitmaps leave room for a link."""
    return (room(n1, m1, n2, m2) >= needed(n1, n2)) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2))


def linked(s1: np.ndarray, s2: np.ndarray) -> bool:
    both = len(np.intersect1d(s1, s2, assume_unique=True))
    return 100 * both >= PERCENT * (len(s1) + len(s2) - both)


class Tree:
    """Nodes level by level, leaves first: lo, hi (range of rows), least and most tokens, bitmap, the
    most tokens in excess of bits, component (-1 if several)."""

    def __init__(self, n: np.ndarray, maps: np.ndarray, comp: np.ndarray):
        self.n, self.maps, self.comp = n, maps, comp
        self.over = n - np.bitwise_count(maps).sum(-1, dtype=np.int64)
        self.nodes: list[tuple] = []
        level = [self._node(i, min(i + LEAF, len(n)), ()) for i in range(0, len(n), LEAF)]
        while len(level) > 1:
            level = [self._node(self.nodes[g[0]][0], self.nodes[g[-1]][1], tuple(g)) for g in (level[i : i + FANOUT] for i in range(0, len(level), FANOUT))]
        self.root = level[0]

    def _node(self, lo: int, hi: int, kids: tuple) -> int:
        c = self.comp[lo:hi]
        bits = np.bitwise_or.reduce(np.stack([self.nodes[k][4] for k in kids]) if kids else self.maps[lo:hi], axis=0)
        self.nodes.append((lo, hi, int(self.n[lo:hi].min()), int(self.n[lo:hi].max()), bits, int(self.over[lo:hi].max()), int(c[0]) if (c == c[0]).all() else -1, kids))
        return len(self.nodes) - 1

    def pairs(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of self and other that may link and are in different components. self and other may
        be the same; then each pair comes once."""
        todo = [(self.root, other.root)]
        while todo:
            i, j = todo.pop()
            a, b = self.nodes[i], other.nodes[j]
            if 100 * a[3] < PERCENT * b[2] or 100 * b[3] < PERCENT * a[2] or (a[6] != -1 and a[6] == b[6]):
                continue
            if int(np.bitwise_count(a[4] & b[4]).sum()) + min(a[5], b[5]) < needed(a[2], b[2]):
                continue
            if a[7] or b[7]:
                if a[7] and (not b[7] or a[1] - a[0] >= b[1] - b[0]):
                    todo += [(k, j) for k in a[7] if self is not other or self.nodes[k][0] < b[1]]
                else:
                    todo += [(i, k) for k in b[7] if self is not other or a[0] < other.nodes[k][1]]
                continue
            x, y = np.arange(a[0], a[1]), np.arange(b[0], b[1])
            ok = may_link(self.n[x][:, None], self.maps[x][:, None, :], other.n[y][None, :], other.maps[y][None, :, :])
            ok &= self.comp[x][:, None] != other.comp[y][None, :]
            if self is other:
                ok &= x[:, None] < y[None, :]
            p, q = np.nonzero(ok)
            if len(p):
                yield x[p], y[q]

    def merged(self, sets: list[np.ndarray]) -> np.ndarray:
        """The component of each row after all pairs that may link were compared, but those whose rows
        were in one component when their turn came. Pairs within a node come before those across nodes."""
        comp, todo = self.comp.copy(), [(self.root, self.root)]
        while todo:
            i, j = todo.pop()
            a, b = self.nodes[i], self.nodes[j]
            if 100 * a[3] < PERCENT * b[2] or 100 * b[3] < PERCENT * a[2]:
                continue
            ca, cb = comp[a[0] : a[1]], comp[b[0] : b[1]]
            if (ca == ca[0]).all() and (cb == ca[0]).all():
                continue
            if i != j and int(np.bitwise_count(a[4] & b[4]).sum()) + min(a[5], b[5]) < needed(a[2], b[2]):
                continue
            if i == j and a[7]:
                todo += [(k, m) for n, k in enumerate(a[7]) for m in a[7][n + 1 :]] + [(k, k) for k in a[7]]
                continue
            if a[7] or b[7]:
                todo += [(k, j) for k in a[7]] if a[7] and (not b[7] or a[1] - a[0] >= b[1] - b[0]) else [(i, k) for k in b[7]]
                continue
            x, y = np.arange(a[0], a[1]), np.arange(b[0], b[1])
            n1, n2 = self.n[x][:, None], self.n[y][None, :]
            score = room(n1, self.maps[x][:, None, :], n2, self.maps[y][None, :, :]) / needed(n1, n2)
            fits = (score >= 1) & (100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)) & (comp[x][:, None] != comp[y])
            if i == j:
                fits &= x[:, None] < y
            p, q = np.nonzero(fits)
            for k in np.argsort(-score[p, q], kind="stable"):
                u, v = x[p[k]], y[q[k]]
                if comp[u] != comp[v] and linked(sets[u], sets[v]):
                    comp[comp == comp[v]] = comp[u]
        return comp

    def spanning(self, seed: int, best: bool) -> Iterator[tuple[int, int, float]]:
        """Rows that may link and their score, where each pair given is taken for a link: never more
        than there are components less one. best: a leaf pair's likeliest come first, else any."""
        comp, rng, todo = self.comp.copy(), np.random.default_rng(seed), [(self.root, self.root)]
        alike = lambda c, x: bool((c == x).all())
        while todo:
            i, j = todo.pop()
            a, b = self.nodes[i], self.nodes[j]
            if 100 * a[3] < PERCENT * b[2] or 100 * b[3] < PERCENT * a[2]:
                continue
            if alike(comp[a[0] : a[1]], comp[a[0]]) and alike(comp[b[0] : b[1]], comp[a[0]]):
                continue
            if int(np.bitwise_count(a[4] & b[4]).sum()) + min(a[5], b[5]) < needed(a[2], b[2]):
                continue
            if a[7] or b[7]:
                if a[7] and (not b[7] or a[1] - a[0] >= b[1] - b[0]):
                    more = [(k, j) for k in a[7] if self.nodes[k][0] < b[1]]
                else:
                    more = [(i, k) for k in b[7] if a[0] < self.nodes[k][1]]
                todo += [more[k] for k in rng.permutation(len(more))]
                continue
            x, y = np.arange(a[0], a[1]), np.arange(b[0], b[1])
            score = room(self.n[x][:, None], self.maps[x][:, None, :], self.n[y][None, :], self.maps[y][None, :, :]) / needed(self.n[x][:, None], self.n[y][None, :])
            fits = (score >= 1) & (100 * np.minimum(self.n[x][:, None], self.n[y]) >= PERCENT * np.maximum(self.n[x][:, None], self.n[y])) & (x[:, None] < y)
            if not best:
                score = 1 + rng.random(score.shape)
            while (ok := fits & (comp[x][:, None] != comp[y])).any():
                p, q = np.unravel_index(np.where(ok, score, 0).argmax(), ok.shape)
                yield int(x[p]), int(y[q]), float(score[p, q])
                comp[comp == comp[y[q]]] = comp[x[p]]


def _keys(s: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix in the order of keys, and how many of it are leads."""
    n = len(s)
    at = np.searchsorted(often, s)
    at[at == len(often)] = 0
    seen = np.where(often[at] == s, counts[at], 0) if len(often) else np.zeros(n, np.int64)
    lead = n - -(-PERCENT * n // 100) + 1
    return s[np.lexsort((s, seen))[: lead + EXTRA * n // 100]], lead


def _packed(a: np.ndarray) -> bytes:
    """The upper 48 bits of each of sorted numbers, in some 41 where there are many: five bytes of each, and of
    their top bytes, which ascend, how far each is beyond the one before, in unary."""
    k, n = a >> np.uint64(16), len(a)
    if n < FEW:
        return n.to_bytes(4, "little") + np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    steps = np.zeros(n + 256, np.uint8)
    steps[(k >> np.uint64(40)).astype(np.int64) + np.arange(n)] = 1
    return n.to_bytes(4, "little") + np.packbits(steps).tobytes() + _five(k)


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    m = (n + 256 + 7) // 8
    out = np.zeros((n, 8), np.uint8)
    if n < FEW:
        out[:, 2:] = np.frombuffer(b, np.uint8, offset=4).reshape(n, 6)
        return out.view("<u8").ravel()
    out[:, 2:7] = np.frombuffer(b, np.uint8, offset=4 + m).reshape(n, 5)
    out[:, 7] = np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8, m, 4))) - np.arange(n)
    return out.view("<u8").ravel()


def _five(a: np.ndarray) -> bytes:
    """Five bytes of each: the lower 40 bits."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _of_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n, class, short for each row; shingle, count for what repeats within some stretch)."""
    kind = _kind(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n", "class", "short", "count"]
        held, size, k = [], 0, None

        def repeated() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c > 1].view(np.int64), c[c > 1]
            none = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(u), k), none, none, pa.nulls(len(u), pa.binary()), pa.array(u), pa.array(c, pa.int64())], names)

        for b in _small(batches):
            k = b.schema.field(0).type
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            ids = [class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([short_of(c) for c in ids], pa.int64()), pa.nulls(len(sets), pa.int64())], names)
            held += sets
            size += sum(map(len, sets))
            if size > HELD:
                yield repeated()
                held, size = [], 0
        if held:
            yield repeated()

    all_ = staged(docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(tidy(run), f"doc_id {kind}, row long, n long, class binary, short long, count long"), "shingle-sets")
    return all_.where("count is null").drop("count"), all_.where("count is not null").select(F.col("short").alias("shingle"), "count")


def _parts_of(k: np.ndarray, short: np.ndarray, hot: np.ndarray, parts: np.ndarray, deal: int) -> np.ndarray:
    """Where keys of 48 bits go: by key, hot ones by key and class."""
    to = k
    if len(hot):
        at = np.minimum(np.searchsorted(hot, k), len(hot) - 1)
        to = np.where(hot[at] == k, k + (short % parts[at]) * _MIX[3], k)
    to = (to ^ (to >> np.uint64(29))) * _MIX[0]
    return ((to ^ (to >> _MIX[2])) % np.uint64(deal)).astype(np.int64)


def _shared_keys(docs: DataFrame, often: np.ndarray, counts: np.ndarray, parts: int) -> DataFrame:
    """key, short, lead for every key of two classes or more."""
    upper = lambda k: k >> np.uint64(16)
    hot, at = np.unique(upper(often[counts > HOT]), return_index=True)
    ways = -(-counts[counts > HOT][at] // HOT)
    shared = docs.sparkSession.sparkContext.broadcast((often, counts, hot, ways.astype(np.uint64)))
    deal = 4 * parts

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts, hot, ways = shared.value
        keys, marks, size = [], [], 0

        def packed() -> pa.RecordBatch:
            k, m = np.concatenate(keys), np.concatenate(marks)
            to = _parts_of(k, m >> np.uint64(1), hot, ways, deal)
            order = np.lexsort((k, to))
            k, m, to = k[order] << np.uint64(16), m[order], to[order]
            there, starts = np.unique(to, return_index=True)
            ends = np.append(starts[1:], len(to))
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([_packed(k[i:j]) for i, j in zip(starts, ends)], pa.binary()), pa.array([_five(m[i:j]) for i, j in zip(starts, ends)], pa.binary())], ["to", "keys", "marks"])

        for b in _small(batches):
            for t in b.column(0).to_pylist():
                s = shingles(t)
                if len(s):
                    own, lead = _keys(s, often, counts)
                    mark = np.full(len(own), short_of(class_of(s)) * 2 + 1, np.uint64)
                    mark[:lead] -= np.uint64(1)
                    keys.append(upper(own))
                    marks.append(mark)
                    size += len(own)
            if size > PASSED:
                yield packed()
                keys, marks, size = [], [], 0
        if keys:
            yield packed()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, ms = [], []
        for b in batches:
            ks += [upper(_unpacked(x.as_py())) for x in b.column(1)]
            ms += [_of_five(x.as_py()) for x in b.column(2)]
        if not ks:
            return
        k, m = np.concatenate(ks), np.concatenate(ms)
        del ks, ms
        order = np.lexsort((m, k))
        k, m = k[order], m[order]
        c = m >> np.uint64(1)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, lead = k[new], c[new], (m[new] & np.uint64(1)) == 0
        starts = np.flatnonzero(np.append([True], k[1:] != k[:-1]))
        sizes = np.diff(np.append(starts, len(k)))
        # of a hot key there may be one class here and more elsewhere
        many = np.repeat((sizes > 1) | np.isin(k[starts], shared.value[2]), sizes)
        cols = k[many].view(np.int64), c[many].view(np.int64), lead[many]
        for at in range(0, len(cols[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in cols], ["key", "short", "lead"])

    blobs = docs.select("text").mapInArrow(tidy(emit), "to long, keys binary, marks binary")
    return staged(blobs.repartition(parts, "to").mapInArrow(tidy(gather), "key long, short long, lead boolean"), "shared-keys")


def _groups(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """key, size, short: classes that share a lead, of those that share enough to link; equal groups once.
    What two linked classes share of their prefixes is one and a tenth of the smaller set at least."""
    n = rows.where("n > 0").groupBy("short").agg(F.min("n").alias("n"))
    enough = F.col("count") >= 1 + F.floor(F.col("n") * PERCENT * EXTRA / 10_000)
    able = shared.groupBy("short").count().join(n, "short").where(enough).select("short")
    lead = staged(few(shared.where("lead").join(able, "short", "left_semi").select("key", "short")), "leads")
    by_key = lead.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("short")).alias("x"), F.bit_xor(F.xxhash64("short", F.lit(1))).alias("y"))
    once = by_key.where("size > 1").groupBy("x", "y", "size").agg(F.min("key").alias("key")).select("key", "size")
    return staged(few(lead.join(once, "key")), "groups")


def _bloom(ids: DataFrame, c: str, words: int = 1 << 18) -> np.ndarray:
    """Bits of 64 * words places, one for each id (16 MB with the driver at most, whatever there is
    to hold); a full one lets all pass, which costs time alone."""
    h = F.xxhash64(c)
    got = ids.select(F.pmod(h, F.lit(words)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(words, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["m"].to_numpy(np.int64)
    return out


def _sets_of(docs: DataFrame, rows: DataFrame, shorts: DataFrame) -> DataFrame:
    """class, short, n, bits, tokens of the candidates: their sets, made again from one document of each; and
    what shorts has of each short besides."""
    reps = rows.where("n > 0").join(shorts, "short", "left_semi").groupBy("class").agg(F.min(F.struct("row", "doc_id")).alias("r"))
    # by id, too: of exact copies one goes on
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(reps.select(F.xxhash64("r.row", "r.doc_id").alias("one")), "one"))
    words = len(bits.value)
    names = ["class", "short", "n", "bits", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for b in _small(batches):
            h = b.column(1).to_numpy(zero_copy_only=False)
            ok = table[np.mod(h, words)] >> np.mod(h >> 32, 64) & 1
            sets = [s for s in (shingles(t) for t in b.column(0).filter(pa.array(ok.astype(bool))).to_pylist()) if len(s)]
            ids = [class_of(s) for s in sets]
            cols = [short_of(c) for c in ids], [len(s) for s in sets], [bitmap(s).tobytes() for s in sets], [_packed(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, *cols), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names)

    found = docs.select("text", F.xxhash64(F.xxhash64(F.xxhash64("text"), "doc_id")).alias("h")).mapInArrow(tidy(run), "class binary, short long, n long, bits binary, tokens binary")
    # texts that differ in case or spacing may share a set: one row a class, whose short lies where the join left it
    return staged(few(found.join(shorts, "short").dropDuplicates(["short", "class"])), "candidates")


def _only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """class, n, bits, tokens of the classes in ids (class), and of few others: sets are large, and a join would
    shuffle all of them to find these."""
    bits = sets.sparkSession.sparkContext.broadcast(_bloom(ids, "class"))
    words = len(bits.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for b in batches:
            h = b.column(4).to_numpy(zero_copy_only=False)
            ok = table[np.mod(h, words)] >> np.mod(h >> 32, 64) & 1
            yield b.select([0, 1, 2, 3]).filter(pa.array(ok.astype(bool)))

    return sets.select("class", "n", "bits", "tokens", F.xxhash64("class").alias("h")).mapInArrow(tidy(run), "class binary, n long, bits binary, tokens binary")


def _maps(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, WORDS)


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """a, b of the pairs that link."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 256):
            ok = [linked(_unpacked(x), _unpacked(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    held = _only(sets, pairs.select(F.explode(F.array("a", "b")).alias("class")))
    one = lambda c: held.select(F.col("class").alias(c), F.col("tokens").alias(f"t{c}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "ta", "tb")
    return staged(few(both.mapInArrow(tidy(exact), "a binary, b binary"), walked=True), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, root (the smallest node that it reaches) for all nodes but roots.
    Star contraction: each round is a few aggregations and joins over the links alone, until each
    node has one root and no root is a node."""
    e = staged(few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), "cc")
    while True:
        several = e.groupBy("u").count().where("count > 1").select("u")
        chained = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if not several.union(chained).limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = staged(few(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()), "cc")


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after links (staged) joined the components that roots has."""
    if not links.limit(1).count():
        return roots
    e = links
    for c in ("a", "b"):
        e = e.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
    more = components(e)
    old = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return staged(few(old.union(more)), "roots")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, size, class, comp of the groups whose classes are in several components. members: all
    groups, or what an earlier round left: components only grow, so no group comes back."""
    rows = members.select("key", "size", "class").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")
    several = rows.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
    return staged(few(rows.join(several, "key", "left_semi")), "mixed")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows whose first columns, as many as keys, are equal."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
            part = b.slice(i, j - i)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _numbers(t: pa.Table, c: str) -> np.ndarray:
    return t.column(c).combine_chunks().to_numpy(zero_copy_only=False)


def _tree(t: pa.Table) -> Tree:
    """Of columns n, bits and comp."""
    comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    return Tree(_numbers(t, "n"), _maps(t.column("bits").to_pylist()), comp)


def _largest() -> Column:
    return F.max(F.struct("size", "key")).alias("g")


def _joined(sets: DataFrame, turn: int) -> DataFrame:
    """a, b: components that the trees of each class's largest group join, b the lowest of those joined.
    sets: class, comp, n, bits, tokens, and of its largest group g (size, key)."""
    chunk = F.pmod(F.xxhash64("class", F.lit(turn)), F.ceil(F.col("g.size") / CHUNK)).cast("int")
    rows = sets.select("g.key", chunk.alias("chunk"), "comp", "n", "bits", "tokens")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2):
            tree, comps, low = _tree(t), t.column("comp").to_pylist(), {}
            if (tree.comp == tree.comp[0]).all():
                continue
            now = tree.merged([_unpacked(x) for x in t.column("tokens").to_pylist()]).tolist()
            for c, k in zip(comps, now):
                low[k] = min(low.get(k, c), c)
            out = sorted({(c, low[k]) for c, k in zip(comps, now) if c != low[k]})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    dealt = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "n", "comp")
    return staged(few(dealt.mapInArrow(tidy(walk), "a binary, b binary"), walked=True), "joined")


def _proposed(mixed: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """a, b: for each component the likeliest pair (in even turns, any) of those its groups' trees give."""
    salt = F.pmod(F.xxhash64("class", F.lit(turn)), F.ceil(F.col("size") / CHUNK)).cast("int")
    rows = mixed.join(sets.select("class", "n", "bits"), "class").select("key", salt.alias("chunk"), "class", "comp", "n", "bits")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.binary()] * 4 + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["a", "b", "ca", "cb", "score"])

        for t in _runs(batches, 2):
            tree = _tree(t)
            if (tree.comp == tree.comp[0]).all():
                continue
            classes, comp = t.column("class").to_pylist(), t.column("comp").to_pylist()
            seed = abs(t.column("key")[0].as_py()) ^ t.column("chunk")[0].as_py() ^ turn << 32
            for x, y, score in tree.spanning(seed, turn % 2 == 1):
                x, y = (x, y) if classes[x] < classes[y] else (y, x)
                out.append((classes[x], classes[y], comp[x], comp[y], score))
            if len(out) > 10_000:
                yield made()
                out.clear()
        if out:
            yield made()

    dealt = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "n", "class")
    found = dealt.mapInArrow(tidy(walk), "a binary, b binary, ca binary, cb binary, score double")
    own = found.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("score", "a", "b").alias("p"))
    return own.groupBy("c").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def _tree_pairs(mixed: DataFrame, sets: DataFrame, tested: DataFrame) -> DataFrame:
    """a, b: all pairs between components that trees leave and that were not tested. A group's largest
    component has chunks of its own, which meet those of the others only."""
    counts = mixed.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("g"), F.sum("m").alias("all"))
    rows = mixed.join(counts.select("key", "all", F.col("g.m").alias("m"), F.col("g.comp").alias("main")), "key")
    most, rest = F.ceil(F.col("m") / CHUNK).cast("int"), F.ceil((F.col("all") - F.col("m")) / CHUNK).cast("int")
    in_main, h = F.col("comp") == F.col("main"), F.xxhash64("class")
    # chunks of the others are 0 .. rest - 1, those of the largest component come after
    own = F.when(in_main, rest + F.pmod(h, most)).otherwise(F.pmod(h, rest)).cast("int")
    rows = rows.withColumns({"own": own, "upto": F.when(in_main, rest).otherwise(rest + most)}).select("key", "own", "upto", "class", "comp")
    # bitmaps come in before rows are copied to the chunk pairs, and the join is on classes, which are even
    rows = rows.join(sets.select("class", "n", "bits"), "class").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("upto") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "class", "comp", "n", "bits")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = [], {}

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["a", "b"])

        for t in _runs(batches, 3):
            own, i, j = _numbers(t, "own"), t.column("i")[0].as_py(), t.column("j")[0].as_py()
            sides = [t.filter(pa.array(own == x)) for x in sorted({i, j})]
            if not all(map(len, sides)):
                continue
            number = {c: k for k, c in enumerate(set(t.column("comp").to_pylist()))}
            if len(number) == 1:
                continue
            trees = [Tree(_numbers(x, "n"), _maps(x.column("bits").to_pylist()), np.array([number[c] for c in x.column("comp").to_pylist()])) for x in sides]
            left, right = (x.column("class").to_pylist() for x in (sides[0], sides[-1]))
            for x, y in trees[0].pairs(trees[-1]):
                out += [(min(left[p], right[q]), max(left[p], right[q])) for p, q in zip(x, y)]
                if len(out) > 10_000:
                    yield made()
                    out = []
        if out:
            yield made()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "class")
    return staged(dealt.mapInArrow(tidy(walk), "a binary, b binary").distinct().join(tested, ["a", "b"], "left_anti").transform(few), "pairs")


def near_duplicates(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id; with_row also row, the hash of the text (null for null)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, repeats = _sets(docs)
    top = repeats.groupBy("shingle").agg(F.sum("count").alias("n")).where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    often, counts = top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(often)
    groups = _groups(_shared_keys(docs, often[order], counts[order], parts), rows)
    del top, often, counts, order
    trim()
    sets = _sets_of(docs, rows, groups.groupBy("short").agg(_largest()))
    members = staged(few(groups.join(sets.select("short", "class"), "short").select("key", "size", "class")), "members")
    # each class is in one chunk, so what is joined are stars
    roots = _joined(sets.withColumn("comp", F.col("class")), 0).select(F.col("a").alias("node"), F.col("b").alias("root"))
    mixed, turn, tested = _mixed(members, roots), 0, None
    # chunks of a large group have grown apart; dealt anew, what has grown meets
    large = mixed.where(F.col("size") > CHUNK)
    if large.limit(1).count():
        own = large.groupBy("class", "comp").agg(_largest())
        roots = _grown(roots, _joined(own.join(_only(sets, own), "class"), 1))
    while True:
        turn += 1
        mixed = _mixed(mixed, roots)
        likely = _proposed(mixed, sets, turn)
        likely = staged(few(likely if tested is None else likely.join(tested, ["a", "b"], "left_anti")), "proposed")
        tested = likely if tested is None else tested.union(likely)
        found = _verified(likely, sets, "round")
        if not found.limit(1).count():
            break
        roots = _grown(roots, found)
        if turn == TURNS:
            mixed = _mixed(mixed, roots)
            break
    more = _verified(_tree_pairs(mixed, sets, tested), sets, "tree")
    roots = _grown(roots, more)
    by_class = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")).join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    by_class = by_class.withColumn("root", F.coalesce("root", "class"))
    ids = by_class.join(by_class.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("class", "component_id")
    out = rows.join(ids, "class", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *(["row", "class"] if with_row else []))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest id, then the smallest hash of the text; of
    rows alike in both the one whose other columns have the smallest digest. Documents of an empty set all
    stay but for rows alike in id and text."""
    found = near_duplicates(docs, with_row=True)
    part = lambda alone, i, k: F.struct(F.lit(alone).alias("alone"), i.alias("i"), k.alias("k"))
    own, none = F.col("row").cast("string").cast("binary"), F.col("component_id").isNull()
    group = F.when(F.col("n_shingles") == 0, part(True, F.col("doc_id"), own)).otherwise(part(False, F.col("component_id"), F.when(none, F.col("class"))))
    best = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("b")).select(F.col("b.doc_id").alias("i"), F.col("b.row").alias("r"))
    d = boxed(docs, F.xxhash64("text"))
    kept = d.join(best, F.col("id").eqNullSafe(F.col("i")) & F.col("row").eqNullSafe(F.col("r")), "left_semi")
    return once(kept).select("d.*")
