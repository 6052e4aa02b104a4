import numpy as np
import pytest

from nephrolake.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = [set() for _ in rows]
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], "f4").astype("f8"), np.array(rows[b][1], "f4").astype("f8")
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(links[i]), c, d is None and c is None or d == c or (d is None)))
    return sorted(out, key=repr)


def groups(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        base = rng.normal(size=16)
        rows += [base + rng.normal(size=16) * rng.choice([0.02, 0.12]) for _ in range(int(rng.choice([1, 2, 4, 30])))]
        rows += [rows[-1]] * int(rng.choice([0, 0, 3]))
    return spark.createDataFrame([(i * 3 - 50, [float(c) for c in v], 1, "x") for i, v in enumerate(rows)], SCHEMA)


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.1]), (8, [0.0, 1.0]),
        (9, [1e30, 1e29]), (10, [1e-30, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [2.0, 0.0, 0.0]), (7, [1.0, 0.0])]
    return spark.createDataFrame([(i, v, 0, "y") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("table", [groups, odd])
def test_against_brute_force(spark, table):
    df = table(spark)
    got = vector_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_small_shards_and_parts(spark, monkeypatch):
    """Many shards, and shards that are dealt into parts, find the same."""
    monkeypatch.setattr(vector_dedup, "SHARD", 150)
    monkeypatch.setattr(vector_dedup, "MAX_SHARD", 80)
    df = groups(spark)
    out = vector_dedup.near_duplicates(df).collect()
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert sum(r.n_links for r in out) >= 0.98 * sum(w[1] for w in want) and out[0].recall >= 0.98


def test_whole_table_recall(spark):
    got = vector_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], "f4").astype("f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = {r.vec_id: int(c) - 1 for r, c in zip(rows, (x @ x.T >= 0.9).sum(1), strict=True)}
    assert sum(r.n_links for r in got) >= 0.98 * sum(n.values()) and all(r.n_links <= n[r.vec_id] for r in got)


def test_empty(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruned_degree():
    x = vector_dedup._unit(np.random.default_rng(0).normal(size=(400, 8))).astype("f4")
    adj = vector_dedup.robust_prune(x)
    assert max(map(len, adj)) <= 2 * vector_dedup.DEGREE and min(map(len, adj)) >= 1


def crowds(spark):
    """Groups of more distinct near copies than a node has neighbours."""
    rng = np.random.default_rng(9)
    rows = [base + rng.normal(size=64) * 0.2 for base in rng.normal(size=(6, 64)) for _ in range(100)]
    return spark.createDataFrame([(i, [float(c) for c in v], 1, "x") for i, v in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("full", [vector_dedup.DEGREE, 1])
def test_groups_of_near_copies(spark, full, monkeypatch):
    """No edge leads from group to group: parts compared whole, and parts searched."""
    df = crowds(spark)
    x = vector_dedup._unit(np.array([r.embedding for r in df.collect()]))
    n = (x @ x.T >= 0.9).sum(1) - 1
    assert n.min() > vector_dedup.NEAR
    monkeypatch.setattr(vector_dedup, "MIN_RECALL", 0)  # the graph alone
    adj = vector_dedup.robust_prune(x.astype("f4"))
    wide = np.repeat(np.arange(len(x))[:, None], max(map(len, adj)), axis=1)
    for i, a in enumerate(adj):
        wide[i, : len(a)] = a
    monkeypatch.setattr(vector_dedup, "DEGREE", full)
    q, _ = vector_dedup.range_search(x.astype("f4"), wide, 0.9 - 1e-5, vector_dedup.BEAM)
    assert len(q) >= 0.98 * n.sum()
    monkeypatch.undo()
    got = vector_dedup.near_duplicates(df).collect()
    assert sum(r.n_links for r in got) >= 0.98 * n.sum() and all(r.n_links <= n[r.vec_id] for r in got)


def test_all_pairs_where_the_graph_fails(spark, monkeypatch):
    """Below the least recall, all pairs are compared."""
    monkeypatch.setattr(vector_dedup, "range_search", lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    monkeypatch.setattr(vector_dedup, "MAX_SHARD", 250)
    monkeypatch.setattr(vector_dedup, "SHARD", 150)
    df = crowds(spark)
    x = vector_dedup._unit(np.array([r.embedding for r in df.collect()]))
    n = (x @ x.T >= 0.9).sum(1) - 1
    out = vector_dedup.near_duplicates(df).collect()
    assert {r.vec_id: r.n_links for r in out} == {i: int(c) for i, c in enumerate(n)} and out[0].recall == 1


def test_many_lengths(spark):
    """More lengths than could be searched one by one, two near copies of each."""
    rows = [(2 * k + i, [1.0] * k + [0.5 + 0.1 * i], 0, "z") for k in range(1, 1300) for i in (0, 1)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, i - i % 2) for i, *_ in rows}


def test_one_large_group(spark):
    """A group of near copies over the size of a part: counted once, in bounded memory."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [base + rng.normal(size=32) * 0.05 for _ in range(2000)] + list(rng.normal(size=(200, 32)))
    got = vector_dedup.near_duplicates(spark.createDataFrame([(i, [float(c) for c in v], 0, "z") for i, v in enumerate(rows)], SCHEMA)).collect()
    x = vector_dedup._unit(np.array(rows, "f4"))
    n = (x @ x.T >= 0.9).sum(1) - 1
    assert n[:2000].min() == 1999 and sum(r.n_links for r in got) >= 0.98 * n.sum() and all(r.n_links <= n[r.vec_id] for r in got)
    assert {r.component_id for r in got if r.vec_id < 2000} == {0}


def test_crowded_groups_lose_no_pair():
    """An original with its near copies: it can't lead back to all of them, and to some nothing else led."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=64)
    crowd = [base, *(base + rng.normal(size=64) * s for s in rng.choice([0.02, 0.12], 230))]
    x = vector_dedup._unit(np.array(crowd + list(rng.normal(size=(600, 64))))).astype("f4")
    adj = vector_dedup.robust_prune(x)
    wide = np.repeat(np.arange(len(x))[:, None], max(map(len, adj)), axis=1)
    for i, a in enumerate(adj):
        wide[i, : len(a)] = a
    q, o = vector_dedup.range_search(x, wide, 0.9 - 1e-5, vector_dedup.BEAM)
    true = x @ x.T >= 0.9 - 1e-5
    np.fill_diagonal(true, False)
    assert {*zip(q.tolist(), o.tolist(), strict=True)} == {*zip(*(k.tolist() for k in np.nonzero(true)), strict=True)}


def test_wider_search_keeps_its_shards_small(spark, monkeypatch):
    """When the audit asks for more overlap, there are more centroids, not larger shards; all pairs come last."""
    seen, links = [], vector_dedup._links

    def failing(nodes, kmeans, overlap, beam, watched):
        seen.append((len(kmeans), overlap, beam))
        found, path = links(nodes, kmeans, overlap, beam, watched)
        return (found if beam is None else found.filter("false")), path

    monkeypatch.setattr(vector_dedup, "_links", failing)
    monkeypatch.setattr(vector_dedup, "SHARD", 150)
    got = vector_dedup.near_duplicates(crowds(spark)).select("n_links", "recall").collect()
    assert seen == [(8, 2, 16), (16, 4, 32), (1, 1, None)]
    assert got[0].recall == 1 and min(r.n_links for r in got) > 48
