r"""Jaccard self-join of documents on word n-grams, with signature trees.

A document's set holds the 64-bit hashes of its distinct n-word shingles.
Documents with the same set form a class; classes are joined, copies are not
expanded.

1. *Dealing out.* Two sets with Jaccard t or more share an element among the
   first ``n - ceil(t n) + 1`` of each under any common order. The order puts
   shingles that are frequent last (order decides speed only), so a passage
   that many documents share rarely deals them together. All shingles of all
   documents are counted, in ``CELLS`` counters: those of one cell count as one.
   Where at least 0.6 of a set is not frequent, the first 64 of that part
   suffice: a link fails to meet there with a chance below 0.56^64 (1e-16),
   far under that of a 64-bit collision.
2. *In groups.* Under each of ``ORDERS`` orders a class falls into the group of
   its first element, so two classes with Jaccard t meet in one order with that
   chance. A group's sets form signature trees: leaves of a few sets, nodes with
   the OR of their token bitmaps and their size ranges. A dual traversal prunes
   pairs of nodes by the largest overlap they could have; what remains is
   verified exactly where it is, and a task sends on one link for each two
   components it joins, so its rows follow the classes and not their pairs.
   Groups of over a block are first compared with one block of pivots, then,
   where components are still apart, in all pairs of blocks but those within
   the group's largest component.
3. *By elements.* Elements whose classes are still not in one component deal
   out the rest in the same way, with bitmaps in place of sets; pairs that met
   in a group, or are connected already, are skipped. Bitmaps go only where a
   set meets another that it could link with by size and by the places of the
   element: what two sets share begins at one that they both were dealt out by,
   and so is no more than either has from there on. What survives is sent to
   an exact check. All links that can still join components are found here.

Words: runs of ``[^\x20\x09-\x0D]``, A-Z in lower case. With fewer than n
words the whole sequence is the one shingle; without words the set is empty
and links with nothing. Defined cases: a null ``doc_id`` has its set size and
a null component, and joins nothing; rows that share a doc_id are separate
nodes of that id; repeated rows are copies; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_few_files, prepare, read_table, row_key, stash, tidied
from .components import components

WORDS, PERCENT = 5, 75
BITMAP_WORDS, BITS_EACH = 32, 4  # 2048 bits in the trees; bits a shingle in the last test of a pair
LEAF, FANOUT = 8, 8
#: Pairs of nodes whose bitmaps are read at once: 256 bytes each, twice.
PAIRS_AT_ONCE = 1 << 14
#: Classes and shingles of a block, at most on average.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Counters of shingles over all documents, and the parts in which tasks send them on.
CELLS, PARTS = 1 << 22, 64
#: A cell is frequent that counts so many (and so many for each PER_DOCS documents); so many are kept.
FREQUENT, PER_DOCS, MAX_FREQUENT = 4, 20_000, 1 << 16
COLD_SHARE, COLD_PREFIX = 0.6, 64
#: Orders whose first elements group the classes; rows that a task compares first.
ORDERS, FIRST_ROWS = 4, 8
#: Rows of (class, row) that are broadcast, at most.
BROADCAST_ROWS = 500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURNS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(ORDERS)], _U)  # odd factors


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, _U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, over all texts at once."""
    data = b"\n".join((t or "").encode() for t in texts)
    ends = np.cumsum([len((t or "").encode()) + 1 for t in texts])
    b = np.frombuffer(data.lower() + b"\n", np.uint8)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([True], white)).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(b) + 1)
    prefix = np.zeros(len(b) + 1, _U)
    np.cumsum((b.astype(_U) + _U(1)) * power[: len(b)], out=prefix[1:])
    word = _mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(_U))
    first = np.searchsorted(start, np.concatenate(([0], ends)))
    weight = _mix(np.arange(1, n + 1, dtype=_U) * _BASE)
    m = max(0, len(word) - n + 1)
    rolled = np.zeros(m, _U)
    for k in range(n):
        rolled += word[k : k + m] * weight[k]
    rolled = _mix(rolled)
    out = []
    for i in range(len(texts)):
        a, z = first[i], first[i + 1]
        if z - a >= n:
            out.append(np.unique(rolled[a : z - n + 1]))
        elif z > a:
            out.append(_mix((word[a:z] * weight[: z - a]).sum(keepdims=True) + _U(z - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def places_of(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Where each shingle's cell is in ``frequent`` (sorted), -1 if it is not there."""
    if not len(frequent):
        return np.full(len(shingles), -1)
    cells = shingles & _U(CELLS - 1)
    at = np.minimum(np.searchsorted(frequent, cells), len(frequent) - 1)
    return np.where(frequent[at] == cells, at, -1)


def prefix_of(shingles: np.ndarray, places: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The elements that deal a set out."""
    n = len(shingles)
    need = n - -(-percent * n // 100) + 1 if n else 0
    hot = places >= 0
    cold = shingles[~hot]
    if len(cold) >= COLD_SHARE * n and len(cold) >= min(need, COLD_PREFIX):
        need = min(need, COLD_PREFIX)
    if len(cold) >= need:
        return cold[:need]
    late = shingles[hot][np.argsort(rank[places[hot]], kind="stable")]
    return np.concatenate((cold, late))[:need]


def firsts_of(shingles: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first element under each of ORDERS orders: of those not frequent
    where they are most of the set, else of all (as in a large group of copies)."""
    if not len(shingles):
        return np.zeros(ORDERS, _U)
    cold = shingles[places < 0]
    pool = cold if len(cold) >= COLD_SHARE * len(shingles) else shingles
    return pool[(pool * _TURNS[:, None]).argmin(axis=1)]


def bitmap_of(shingles: np.ndarray, bits_each: int = 0) -> np.ndarray:
    """A bit for each shingle's hash; with ``bits_each`` of them a shingle at
    least, the length a power of two."""
    words = max(BITMAP_WORDS, 1 << (len(shingles) * bits_each // 64).bit_length()) if bits_each else BITMAP_WORDS
    bits = np.zeros(words * 64, bool)
    bits[(_mix(shingles) & _U(words * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(_U)


def folded(bits: np.ndarray, words: int = BITMAP_WORDS) -> np.ndarray:
    """A long bitmap (along the last axis) at a shorter length."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def fit_by_bitmaps(i: np.ndarray, j: np.ndarray, bits: list[np.ndarray], size: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of positions can still link by their bitmaps at full length."""
    width = np.array([len(b) for b in bits])
    ok = np.zeros(len(i), bool)
    for x, y in {*zip(width[i].tolist(), width[j].tolist(), strict=True)}:
        here = np.flatnonzero((width[i] == x) & (width[j] == y))
        for part in np.array_split(here, -(-len(here) * max(x, y) // (1 << 20))):
            a, b = (folded(np.stack([bits[k] for k in side[part]]), min(x, y)) for side in (i, j))
            more = [size[side[part]] - np.bitwise_count(v).sum(axis=1) for side, v in ((i, a), (j, b))]
            ok[part] = np.bitwise_count(a & b).sum(axis=1) + np.minimum(*more) >= need_overlap(size[i[part]], size[j[part]], percent)
    return ok


def need_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Levels of nodes over sets in order of size. A node: the OR of its
    bitmaps, the most elements one of its sets has beyond its own bits, its
    size range, its component, and whether it has several of them."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, comp: np.ndarray) -> None:
        self.order = np.argsort(size, kind="stable")
        size, bits, comp = size[self.order], bits[self.order], comp[self.order]
        surplus = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, surplus, size, size, comp, np.zeros(len(size), bool))]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, surplus, low, high, comp, mixed = self.levels[-1]
            at = np.arange(0, len(low), width)
            least, most = np.minimum.reduceat(comp, at), np.maximum.reduceat(comp, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.maximum.reduceat(surplus, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                least, np.logical_or.reduceat(mixed, at) | (least != most)))
            width = FANOUT

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in node, child) of all children one level down."""
        width, below = (LEAF if level == 1 else FANOUT), len(self.levels[level - 1][0])
        kids = node[:, None] * width + np.arange(width)
        ok = kids < below
        return np.nonzero(ok)[0], kids[ok]


def possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether node i of x and node j of y can hold a link that joins components.
    Bitmaps are read for pairs that fit by size and component, a part at a time."""
    ok = (100 * x[3][i] >= percent * y[2][j]) & (100 * y[3][j] >= percent * x[2][i]) & ((x[4][i] != y[4][j]) | x[5][i] | y[5][j])
    at = np.flatnonzero(ok)
    for part in np.array_split(at, -(-len(at) // PAIRS_AT_ONCE) or 1):
        a, b = i[part], j[part]
        shared = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1)
        most = np.minimum(shared + np.minimum(x[1][a], y[1][b]), np.minimum(x[3][a], y[3][b]))
        ok[part] = most >= need_overlap(x[2][a], y[2][b], percent)
    return ok


def dual_traverse(a: SignatureTree, b: SignatureTree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a's input, in b's input) of the pairs that survive."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = possible(a.levels[la], b.levels[lb], i, j, percent)
        i, j = i[ok], j[ok]
        if len(i) == 0 or la == lb == 0:
            return a.order[i], b.order[j]
        if la >= lb:
            at, i = a.children(la, i)
            j, la = j[at], la - 1
        else:
            at, j = b.children(lb, j)
            i, lb = i[at], lb - 1


def leaf_pairs(runs: np.ndarray, size: np.ndarray, bits: np.ndarray, comp: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """What a traversal leaves of many groups (runs of positions) of one leaf
    each, all at once."""
    n, level = np.diff(runs)[:, 0], (bits, size - np.bitwise_count(bits).sum(axis=1), size, size, comp, np.zeros(len(size), bool))
    found = [np.zeros((2, 0), np.int64)]
    for k in range(2, LEAF + 1):
        one, two = np.triu_indices(k, 1)
        at = runs[n == k, :1]
        i, j = (at + one).ravel(), (at + two).ravel()
        ok = possible(level, level, i, j, percent)
        found.append(np.stack((i[ok], j[ok])))
    i, j = np.concatenate(found, axis=1)
    return i, j


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Cells that count many shingles of all documents, the most frequent last."""
    least, width = max(1, FREQUENT, FREQUENT * docs.count() / PER_DOCS), CELLS // PARTS

    def count(batches):
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            shingles = np.concatenate([*shingle_sets(batch.column(0).to_pylist(), n), np.zeros(0, _U)])
            np.add.at(counts, (shingles & _U(CELLS - 1)).astype(np.int64), 1)
        own = [(k, x.astype(np.min_scalar_type(x.max()))) for k, x in enumerate(counts.reshape(PARTS, width)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([x.itemsize for _, x in own], pa.int32()),
            pa.array([zlib.compress(x, 1) for _, x in own], pa.binary())], names=["part", "bytes", "counts"])

    def total(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, size, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(k, np.zeros(width, np.int64))
                counts[k] += np.frombuffer(zlib.decompress(x), f"u{size}")
        for k, x in counts.items():
            many = np.flatnonzero(x >= least)
            yield pa.RecordBatch.from_arrays([pa.array(k * width + many), pa.array(x[many])], names=["cell", "n"])

    counted = docs.select("text").mapInArrow(tidied(count), "part int, bytes int, counts binary").repartition("part").mapInArrow(tidied(total), "cell long, n long")
    top = counted.orderBy(F.desc("n"), "cell").limit(MAX_FREQUENT).toPandas()
    return top["cell"].to_numpy(np.int64).view(_U)[::-1]


def _sketch(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """(rid, doc_id, cls, size, bits, prefix, firsts) for each row; cls: the set's digest."""
    spark = docs.sparkSession
    by_value = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[by_value], by_value))  # MAX_FREQUENT at most

    def sketch(batches):
        import xxhash

        hot, rank = shared.value
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), n)
            size = np.array([len(x) for x in sets])
            places = np.split(places_of(np.concatenate(sets), hot), np.cumsum(size)[:-1])
            cls = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], _U).view(np.int64)
            longs = lambda rows: pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))
            dealers = [prefix_of(x, p, rank, percent) for x, p in zip(sets, places, strict=True)], [firsts_of(x, p) for x, p in zip(sets, places, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls), pa.array(size), pa.array([bitmap_of(x, BITS_EACH).tobytes() for x in sets], pa.binary()), *map(longs, dealers)],
                names=["rid", "doc_id", "cls", "size", "bits", "prefix", "firsts"])

    rows = docs.select(row_key().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(tidied(sketch), f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, cls long, size long, bits binary, prefix array<long>, "
        "firsts array<long>")


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys in rows that are sorted by them."""
    n = len(keys[0])
    change = np.zeros(max(0, n - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    at = [0, *(np.flatnonzero(change) + 1), n]
    return list(zip(at, at[1:], strict=False)) if n else []


def _whole_groups(batches, n_keys: int):
    """Tables that end where a group (the first columns) ends."""
    held: list[pa.RecordBatch] = []
    key = lambda b, i: tuple(b.column(k)[i].as_py() for k in range(n_keys))
    for batch in batches:
        if not len(batch):
            continue
        if held and key(held[-1], len(held[-1]) - 1) != key(batch, 0):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        cut = _runs(*(batch.column(k).to_numpy() for k in range(n_keys)))[-1][0]
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Of the links between positions ``a`` and ``b`` of ``sets`` (``b`` is ``a``:
    among themselves) as many as join all the components that links join. The
    first rows go first: in a group of near copies they join nearly all."""
    size = np.array([len(s) for s in sets])
    names, own = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate(([0], np.cumsum(size)))
    bits = np.stack([bitmap_of(s) for s in sets])
    comp, mark, out = comp.copy(), np.zeros(len(names), np.int32), []
    at, width = 0, FIRST_ROWS
    while at < len(a):
        part, with_ = a[at : at + width], a[at:] if b is a else b
        at, width = at + width, 4 * width
        i, j = dual_traverse(SignatureTree(size[part], bits[part], comp[part]), SignatureTree(size[with_], bits[with_], comp[with_]), percent)
        i, j = part[i], with_[j]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for x, z in _runs(i) if len(i) else ():
            one, others = i[x], j[x:z]
            others = others[comp[others] != comp[one]]  # components grow as links are found
            if not len(others):
                continue
            n = size[others]
            first = np.cumsum(n) - n
            mark[own[start[one] : start[one + 1]]] = 1
            both = np.add.reduceat(mark[own[np.repeat(start[others] - first, n) + np.arange(n.sum())]], first)
            mark[own[start[one] : start[one + 1]]] = 0
            linked = others[100 * both >= percent * (size[one] + n - both)]
            if len(linked):
                joined, which = np.unique(comp[linked], return_index=True)
                out += [(int(one), int(y)) for y in linked[which]]
                comp[np.isin(comp, joined)] = comp[one]
    return out


def _dealt(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` (keys, cls, comp, ...) of groups with several components: once
    where the group is one block, else once for each pair of blocks (left, right)
    that they are compared in; side 1 is the right block of two. Blocks of the
    group's largest component come last and are not compared with each other."""
    per = rows.groupBy(*keys, "comp").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    groups = per.groupBy(*keys).agg(F.max(F.struct("n", "w", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    groups = groups.select(*keys, F.col("main.comp").alias("main"), blocks(F.col("main.n"), F.col("main.w")).alias("mains"),
        blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("rests"), (blocks(F.col("n"), F.col("w")) == 1).alias("whole"))
    own = rows.join(groups, keys)
    hashed = lambda n: F.pmod(F.xxhash64("cls", *keys), F.col(n)).cast("int")
    in_main = F.col("comp") == F.col("main")
    own = own.withColumn("own", F.when(F.col("whole"), 0).when(in_main, F.col("rests") + hashed("mains")).otherwise(hashed("rests")))
    last = F.when(F.col("whole"), 0).when(in_main, F.col("rests") - 1).otherwise(F.col("rests") + F.col("mains") - 1)
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    kept = [c for c in rows.columns if c not in keys]
    return own.select(*keys, F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"), *kept)


def _under_pivots(rows: DataFrame) -> DataFrame:
    """``rows`` (turn, g, cls, comp, size) of groups with several classes: one
    block, or a block of pivots against each of the others."""
    groups = rows.groupBy("turn", "g").agg(F.count("*").alias("n"), F.sum("size").alias("w")).filter("n > 1")
    groups = groups.select("turn", "g", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = rows.join(groups, ["turn", "g"]).withColumn("own", F.pmod(F.xxhash64("cls", "g"), F.col("blocks")).cast("int"))
    own = own.withColumn("right", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
    return own.select("turn", "g", F.lit(0).alias("left"), "right", (F.col("own") > 0).cast("int").alias("side"), "cls", "comp", "size")


def _linked_in_groups(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join components, verified where a group's blocks meet."""
    keys = ("turn", "g", "left", "right")

    def compare(batches):
        for t in _whole_groups(batches, len(keys)):
            left, right, side, cls, comp = (t.column(c).to_numpy() for c in ("left", "right", "side", "cls", "comp"))
            found = []
            for a, z in _runs(*(t.column(c).to_numpy() for c in keys)):
                one, two = np.flatnonzero(side[a:z] == 0), np.flatnonzero(side[a:z] == 1)
                if left[a] == right[a]:
                    one = two = np.arange(z - a)
                if len(one) and len(two):
                    shingles = [np.frombuffer(x, _U) for x in t.column("view").slice(a, z - a).to_pylist()]
                    found += [(cls[a + i], cls[a + j]) for i, j in spanning_links(shingles, comp[a:z], one, two, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    slim, slim_path = stash(dealt.select(*keys, "side", "cls", "comp"), "dealt")
    n_dealt = slim.count()
    named = F.broadcast(slim) if n_dealt <= BROADCAST_ROWS else slim  # then no set is shuffled twice
    rows = sets.join(named, "cls").select(*keys, "side", "cls", "comp", "view")
    linked = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(compare), "u long, v long").distinct()
    out, path = stash(in_few_files(linked, n_dealt), "links")
    discard(dealt.sparkSession, slim_path)
    return out, path


def meetings(i: np.ndarray, j: np.ndarray, size: np.ndarray, pos: np.ndarray, comp: np.ndarray, firsts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of positions can link and have this element first in common:
    by size, by its place in both sets; in two components, met in no group."""
    a, b = size[i], size[j]
    ok = (comp[i] != comp[j]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.minimum(a - pos[i], b - pos[j]) >= need_overlap(a, b, percent))
    at = np.flatnonzero(ok)
    ok[at] = (firsts[i[at]] != firsts[j[at]]).all(axis=1)
    return ok


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (token, left, right, side, cls, comp, pos, size, firsts) that
    meet another in their blocks, without the last three columns."""
    keys = ("token", "left", "right")

    def meet(batches):
        for t in _whole_groups(batches, len(keys)):
            token, left, right, side, size, pos, comp = (t.column(c).to_numpy() for c in (*keys, "side", "size", "pos", "comp"))
            firsts = t.column("firsts").combine_chunks().flatten().to_numpy().reshape(-1, ORDERS)
            runs = np.array(_runs(token, left, right))
            n = np.diff(runs)[:, 0]
            single = (n <= LEAF) & (left[runs[:, 0]] == right[runs[:, 0]])
            keep = np.zeros(len(t), bool)

            def mark(i, j):
                ok = meetings(i, j, size, pos, comp, firsts, percent)  # noqa: B023  called at once
                keep[i[ok]] = keep[j[ok]] = True  # noqa: B023

            for k in range(2, LEAF + 1):  # most groups are one leaf
                one, two = np.triu_indices(k, 1)
                at = runs[single & (n == k), :1]
                mark((at + one).ravel(), (at + two).ravel())
            for a, z in runs[~single]:
                one, two = (a + np.flatnonzero(side[a:z] == k) for k in (0, 1)) if left[a] < right[a] else [np.arange(a, z)] * 2
                for part in np.array_split(one, len(one) * len(two) // (1 << 17) + 1):
                    mark(np.repeat(part, len(two)), np.tile(two, len(part)))
            yield from t.select([*keys, "side", "cls", "comp"]).filter(pa.array(keep)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(meet), "token long, left int, right int, side int, cls long, comp long")


def _element_candidates(rows: DataFrame, percent: int) -> DataFrame:
    """rows: token, left, right, side, cls, comp, size, bits, firsts; pairs
    (a, b) that survive the traversal, met in no group and are in two components."""
    keys = ("token", "left", "right")

    def traverse(batches):
        for t in _whole_groups(batches, len(keys)):
            token, left, right, side, cls, size, comp = (t.column(c).to_numpy() for c in (*keys, "side", "cls", "size", "comp"))
            wide = [np.frombuffer(x, _U) for x in t.column("bits").to_pylist()]
            bits = np.stack([folded(x) for x in wide])
            firsts = t.column("firsts").combine_chunks().flatten().to_numpy().reshape(-1, ORDERS)
            runs = np.array(_runs(token, left, right))
            single = (np.diff(runs)[:, 0] <= LEAF) & (left[runs[:, 0]] == right[runs[:, 0]])
            found = [leaf_pairs(runs[single], size, bits, comp, percent)]  # most groups are one leaf
            for a, z in runs[~single]:
                at = [a + np.flatnonzero(side[a:z] == k) for k in (0, 1)] if left[a] < right[a] else [np.arange(a, z)] * 2
                if len(at[0]) and len(at[1]):
                    i, j = dual_traverse(*(SignatureTree(size[k], bits[k], comp[k]) for k in at), percent)
                    found.append((at[0][i], at[1][j]))
            out = [np.zeros((0, 2), np.int64)]
            for i, j in found:
                new = (cls[i] != cls[j]) & (firsts[i] != firsts[j]).all(axis=1)
                i, j = i[new], j[new]
                ok = fit_by_bitmaps(i, j, wide, size, percent)
                out.append(np.unique(np.sort(np.stack((cls[i[ok]], cls[j[ok]]), axis=1), axis=1), axis=0))
            pair = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(traverse), "a long, b long").distinct()


def _seen(wanted: DataFrame, reps: DataFrame, docs: DataFrame, n: int, view, repeated: bool) -> DataFrame:
    """(cls, size, view): what ``view`` makes of the set of each wanted class;
    ``repeated``: whether a row may be there more than once."""
    named = reps.select("cls", "rid").join(wanted, "cls")
    if wanted.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)  # then only the wanted texts are read on, and none is shuffled

    def look(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([view(s).tobytes() for s in sets], pa.binary())], names=["cls", "size", "view"])

    seen = docs.select(row_key().alias("rid"), "text").join(named, "rid").select("cls", "text").mapInArrow(tidied(look), "cls long, size long, view binary")
    if not repeated:
        return seen
    return seen.groupBy("cls").agg(F.first(F.struct("size", "view")).alias("r")).select("cls", "r.size", "r.view")  # a repeated row gives its view again


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, repeated: bool) -> tuple[DataFrame, str]:
    """The pairs (a, b) of classes that do link, as edges (u, v), and their table."""
    spark = pairs.sparkSession
    pairs, path = stash(pairs, "pairs")
    seen, seen_path = stash(_seen(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), reps, docs, n, lambda s: s, repeated), "sets")
    side = lambda k: seen.select(F.col("cls").alias(k), F.col("view").alias(f"view_{k}"))

    def choose(batches):
        for batch in batches:
            sets = [[np.frombuffer(v, _U) for v in batch.column(k).to_pylist()] for k in (2, 3)]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)], int)
            hit = pa.array(100 * both >= percent * (np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], int) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(hit) for k in (0, 1)], names=["u", "v"])

    views = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "view_a", "view_b")
    edges, links_path = stash(views.mapInArrow(tidied(choose), "u long, v long"), "links")
    discard(spark, path, seen_path)
    return edges, links_path


def _named(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` with the component that each class is in so far."""
    if comp is None:
        return rows.withColumn("comp", F.col("cls"))
    return rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")


def join_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, class_id
    (equal for documents with the same set), rid (``row_key`` of the row), root
    (equal for rows that links join, also where rows of one id are not linked;
    NULL for a row without an id or without words)."""
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows, rows_path = stash(_sketch(docs, _frequent(docs, n), n, percent), "sketch")
    live = rows.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    classes, classes_path = stash(live.groupBy("cls").agg(F.min(F.struct("rid", "size", "bits", "firsts")).alias("r"), F.min("doc_id").alias("least"))
        .select("cls", "r.*", "least"), "classes")
    repeated = not live.groupBy("rid").count().filter("count > 1").isEmpty()

    # in groups: first against pivots, then what is still apart
    keyed = classes.select("cls", "size", F.posexplode("firsts").alias("turn", "g"))
    several = keyed.groupBy("turn", "g").agg(F.count("*").alias("n"), F.sum("size").alias("w")).filter("n > 1")
    grouped, grouped_path = stash(keyed.join(several.withColumn("large", (F.col("n") > BLOCK) | (F.col("w") > BLOCK_SHINGLES)).drop("n", "w"), ["turn", "g"]), "grouped")
    sets, sets_path = stash(_seen(grouped.select("cls").distinct(), classes, docs, n, lambda s: s, repeated).drop("size"), "sets")
    first, first_path = _linked_in_groups(_under_pivots(_named(grouped.filter("turn = 0").drop("large"), None)), sets, percent)
    comp, comp_paths = components(first)
    again = _named(grouped.filter("turn > 0 or large").drop("large"), comp)
    second, second_path = _linked_in_groups(_dealt(again, ["turn", "g"], "size"), sets, percent)
    links = first.unionByName(second)
    discard(spark, sets_path, grouped_path, *comp_paths)
    comp, comp_paths = components(links)

    # by elements whose classes are not all in one component: all that is left to compare
    elements = lambda rows: _named(rows.select("cls", "prefix"), comp).select("cls", "comp", F.posexplode("prefix").alias("pos", "token"))
    single = live.join(classes.select("cls", "rid"), ["cls", "rid"], "left_semi")
    apart, apart_path = stash(elements(single).groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token"), "apart")
    if apart.count() <= BROADCAST_ROWS:
        left = elements(live).join(F.broadcast(apart), "token").distinct()  # copies give few rows, so prefixes are not shuffled again
    else:
        left = elements(single).join(apart, "token")
    left, left_path = stash(left.withColumn("one", F.lit(1)), "elements")
    both = _meeting(_dealt(left, ["token"], "one").drop("one").join(classes.select("cls", "size", "firsts"), "cls").select(
        "token", "left", "right", "side", "cls", "comp", "pos", "size", "firsts"), percent)
    both = both.join(classes.select("cls", "size", "bits", "firsts"), "cls").select("token", "left", "right", "side", "cls", "comp", "size", "bits", "firsts")
    found, path = _verified(_element_candidates(both, percent), classes, docs, n, percent, repeated)
    roots, roots_paths = components(links.unionByName(found))
    discard(spark, apart_path, left_path, path, first_path, second_path, *comp_paths)

    least = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    named, named_path = stash(least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "root", "component_id"), "named")
    discard(spark, classes_path, *roots_paths)
    out = rows.select("rid", "doc_id", "cls", "size").join(named, "cls", "left")
    root = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("root"))
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.when(F.col("size") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"), F.col("cls").alias("class_id"), "rid", root.alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
