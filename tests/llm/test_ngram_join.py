import random
import re
import tracemalloc

import numpy as np
import pytest

from nephrolake.llm import components, ngram_join

from .fixtures import canon, documents, edges, empty


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in pairs:
        if rows[a][0] is not None and rows[b][0] is not None:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[find(a)] = find(b)
    # rows of one id are nodes of their own, joined by what they link with
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def chained(spark):
    """Chains of edits, a passage that most documents share, and groups of copies."""
    rng, out = random.Random(5), []
    word = lambda: "w%d" % rng.randrange(4000)
    passage = [word() for _ in range(60)]
    for g in range(40):
        text = [word() for _ in range(rng.choice([3, 6, 12, 40, 120, 300]))] + passage * (g % 3 > 0)
        for _ in range(rng.choice([1, 2, 6, 25])):
            out.append((len(out), " ".join(text)))
            text = list(text)
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(out)
    return spark.createDataFrame(out, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("table", [documents, edges, chained])
@pytest.mark.parametrize("frequent", [4, 10**9])
def test_against_brute_force(spark, table, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    docs = table(spark)
    got = ngram_join.join_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert canon(got) == canon(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_empty(spark):
    assert ngram_join.join_components(empty(spark)).count() == 0


def test_traversal_loses_nothing():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(12)]
    sets = [np.unique(np.concatenate((b[rng.random(200) < 0.95], rng.integers(0, 2**63, 5, dtype=np.uint64)))) for b in base for _ in range(9)]
    size, bits = np.array([len(s) for s in sets]), np.stack([ngram_join.bitmap_of(s) for s in sets])
    tree = ngram_join.SignatureTree(size, bits, np.arange(len(sets)))
    i, j = ngram_join.dual_traverse(tree, tree)
    found = {*zip(i.tolist(), j.tolist(), strict=True)}
    links = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and 100 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - o)}
    assert links <= found and len(found) < len(sets) ** 2 / 4
    runs = [(a, a + k) for a, k in ((0, 3), (3, 8), (11, 1), (12, 2), (14, 7))]  # groups of one leaf are compared at once
    i, j = ngram_join.leaf_pairs(np.array(runs), size, bits, np.arange(len(sets)))
    assert {*zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for x, z in runs for a, b in found if x <= a < b < z}


def test_bitmaps_bound_links():
    """At any lengths, bitmaps rule out no pair that links, and most that do not."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (3, 90, 700, 3000, 20_000):
        pool = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(pool[rng.random(n) < share]) for share in (0.5, 0.6, 0.8, 0.85, 0.9, 0.95, 1) for _ in range(3)]
    sets = [s for s in sets if len(s)]
    size, bits = np.array([len(s) for s in sets]), [ngram_join.bitmap_of(s, ngram_join.BITS_EACH) for s in sets]
    for s, b in zip(sets, bits, strict=True):
        assert (ngram_join.folded(b) == ngram_join.bitmap_of(s)).all()
    i, j = np.triu_indices(len(sets), 1)
    ok = ngram_join.fit_by_bitmaps(i, j, bits, size, 75)
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    link = 100 * both >= 75 * (size[i] + size[j] - both)
    assert ok[link].all() and link.sum() > 50
    assert not ok[(both < 0.5 * size[i]) & (size[i] > 50)].any()


def test_without_broadcast(spark, monkeypatch):
    docs = chained(spark)
    want = canon(ngram_join.join_components(docs).select("doc_id", "component_id").collect())
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    assert canon(ngram_join.join_components(docs).select("doc_id", "component_id").collect()) == want


def test_spanning_links():
    """Links of a task join the same components as all links, in as many rows as that takes."""
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 2**63, 150, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate((b[rng.random(150) < 0.93], rng.integers(0, 2**63, 8, dtype=np.uint64)))) for b in base for _ in range(30)]

    def parts(pairs, comp):
        comp = list(comp)
        for x, y in pairs:
            comp = [comp[x] if c == comp[y] else c for c in comp]
        return {frozenset(i for i, c in enumerate(comp) if c == k) for k in comp}

    links = lambda xs, ys: [(x, y) for x in xs for y in ys if x != y and 100 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 75 * (len(sets[x]) + len(sets[y]) - o)]
    every, half = np.arange(len(sets)), np.arange(0, len(sets), 2)
    for a, b in ((every, every), (half, half + 1)):
        for comp in (every, every // 4 * 4):
            got = ngram_join.spanning_links(sets, comp, a, a if b is a else b)
            assert set(got) <= set(links(a, b)) and parts(got, comp) == parts(links(a, b), comp)
            assert len(got) == len(set(comp.tolist())) - len(parts(got, comp))


def test_trios(spark):
    """Two near copies whose shared elements lie in a longer document that links with neither."""
    rng, out = random.Random(8), []
    words = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    for _ in range(400):
        common = words(94)
        for more in (words(110), words(10), words(10)):
            out.append((len(out), " ".join(common + more)))
    out += [(len(out) + i, " ".join(words(8))) for i in range(9000)]  # so many classes that turns end after the first
    got = ngram_join.join_components(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert sum(r.component_id == r.doc_id - 1 for r in got if r.doc_id < 1200 and r.doc_id % 3 == 2) == 400


def test_frequent_shingles_of_all_documents(spark):
    """Groups of copies come last in the order wherever they are; single texts do not."""
    text = lambda kind, i: " ".join(f"{kind}{i}x{j}" for j in range(8))
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 7), j -> concat('own', id, 'x', j))) AS text")
    docs = docs.unionByName(spark.createDataFrame([(30_000 + 60 * g + i, text("group", g)) for g in range(40) for i in range(60)], "doc_id long, text string"))
    frequent = np.sort(ngram_join._frequent(docs, 5))
    assert all((ngram_join.places_of(s, frequent) >= 0).all() for s in ngram_join.shingle_sets([text("group", g) for g in range(40)]))
    alone = np.concatenate(ngram_join.shingle_sets([text("own", i) for i in range(0, 30_000, 100)]))
    assert (ngram_join.places_of(alone, frequent) >= 0).mean() < 0.01


def test_small_groups_are_dealt_once(spark, monkeypatch):
    """A group of one block is sent on once, not as its largest component against the rest; larger ones as before."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = spark.createDataFrame([(t, 10 * t + i, 10 * t + max(i, 2), 1) for t, n in ((1, 2), (2, 4), (3, 9)) for i in range(1, n + 1)], "token long, cls long, comp long, one int")
    got = ngram_join._dealt(rows, ["token"], "one").collect()
    assert not [r for r in got if r.token == 1]  # of one component
    assert sorted((r.left, r.right, r.side, r.cls) for r in got if r.token == 2) == [(0, 0, 0, c) for c in (21, 22, 23, 24)]
    blocks = {}
    for r in (r for r in got if r.token == 3):
        blocks.setdefault((r.left, r.right), []).append(r.cls)
    assert len(blocks) > 1 and {(a, b) for x in blocks.values() for a in x for b in x if a < b} >= {(a, b) for a in range(31, 40) for b in range(max(a, 32) + 1, 40)}


def test_meetings_lose_no_link(spark):
    """Every link meets by an element that passes; rows that can link with no other are not sent on."""
    rng = np.random.default_rng(7)
    frequent = np.sort(rng.choice(ngram_join.CELLS, 3000, replace=False).astype(np.uint64))
    rank = rng.permutation(len(frequent))
    sets = []
    for n in (5, 40, 200, 900):
        for _ in range(6):
            hot = frequent[rng.integers(0, len(frequent), int(n * rng.choice([0.1, 0.8])))] | (rng.integers(0, 2**40, 1, dtype=np.uint64) << np.uint64(22))
            pool = np.unique(np.concatenate((rng.integers(0, 2**63, n - len(hot), dtype=np.uint64), hot)))
            sets += [np.unique(np.concatenate((pool[rng.random(len(pool)) < share], rng.integers(0, 2**63, n // 20, dtype=np.uint64)))) for share in (0.8, 0.9, 0.95, 1, 1)]
    sets = [s for s in sets if len(s)]
    prefixes = [ngram_join.prefix_of(s, ngram_join.places_of(s, frequent), rank) for s in sets]
    size, firsts = np.array([len(s) for s in sets]), np.arange(len(sets))[:, None].repeat(ngram_join.ORDERS, 1)
    places = {}
    for c, p in enumerate(prefixes):
        for pos, e in enumerate(p.tolist()):
            places.setdefault(e, []).append((c, pos))
    passed, met = set(), set()
    for group in places.values():
        c, pos = np.array(group).T
        i, j = np.triu_indices(len(c), 1)
        ok = ngram_join.meetings(i, j, size[c], pos, c, firsts[c])
        met |= {*zip(c[i].tolist(), c[j].tolist(), strict=True)}
        passed |= {*zip(c[i[ok]].tolist(), c[j[ok]].tolist(), strict=True)}
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for a, b in met if 100 * both(a, b) >= 75 * (size[a] + size[b] - both(a, b))}
    assert len(links) > 100 and links <= passed and len(passed) < len(met)
    rows = [(1, 10, 0, 100), (1, 11, 20, 100), (2, 10, 0, 100), (2, 12, 0, 300), (3, 10, 0, 100), (3, 11, 2, 100), (3, 12, 0, 300)]
    rows = [(t, 0, 0, 0, c, c, p, n, [c * 10 + k for k in range(ngram_join.ORDERS)]) for t, c, p, n in rows]
    df = spark.createDataFrame(rows, "token long, left int, right int, side int, cls long, comp long, pos int, size long, firsts array<long>")
    assert sorted((r.token, r.cls) for r in ngram_join._meeting(df, 75).collect()) == [(3, 10), (3, 11)]


def test_alike_sets_take_little_memory():
    """Two blocks whose sets are alike and hardly link: all pairs are compared, their bitmaps are not there at once."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 130, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, 100, replace=False)) for _ in range(2 * ngram_join.BLOCK)]
    every, (one, two) = np.arange(len(sets)), np.split(np.arange(len(sets)), 2)
    tracemalloc.start()
    try:
        got = ngram_join.spanning_links(sets, every, one, two)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    own = np.stack([np.isin(pool, s) for s in sets]).astype(int)
    both = own[one] @ own[two].T
    assert len(got) > 5 and {(a, b) for a, b in got} <= {(int(a), int(b) + len(one)) for a, b in np.argwhere(100 * both >= 75 * (200 - both))}
    assert peak < 100e6


def test_few_edges_in_few_files(spark):
    """Rounds over few edges are written in few files, however many partitions a shuffle has."""
    rng = random.Random(4)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)]
    up = list(range(3000))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got, _ = components.components(spark.createDataFrame(pairs, "u long, v long"))
        assert len(got.inputFiles()) <= 8
        assert sorted(map(tuple, got.collect())) == [(x, find(x)) for x in range(3000) if find(x) != x]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
