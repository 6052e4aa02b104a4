"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node that knows how many it stands for. Centroids are
fitted on a bounded sample; every node goes to its nearest ``OVERLAP`` cluster
shards. Each shard builds a graph: near neighbours, robust-pruned to a bounded
degree, and the spanning trees of what lies within the range, whose edges lead
both ways: in a crowd of near copies the bound on edges back would leave nodes
to which none leads, and their pairs would be lost. The shards' adjacency lists
are united by node, and every node searches its shards' part of the united
graph: each connected part greedily from its medoid and from the node itself,
then on through all that lies within the range. Found pairs are verified in double precision. A task sends on a count
and a component for each node, never its links: a pair is counted only in the
smallest shard that both ends are in. A sample of nodes is searched by brute
force over all vectors to audit the counted links. Below ``MIN_RECALL`` the
overlap, the centroids and the beam are doubled, so that shards keep their size,
and once that costs as much, all pairs are compared.

A shard over twice ``MAX_SHARD`` nodes is dealt into parts of that size; every
two parts build and search a graph together, so that none of its pairs is lost.
Vectors of each length are compared among themselves; lengths of few vectors
are a shard each, all in one run.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components links with nothing; one of another length links with none of the
rest; a null ``vec_id`` has links like any other and the component of those it
links with; rows that share an id are vectors of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, prepare, read_table, stash, tidied
from .components import components

MIN_COSINE, MIN_RECALL = 0.9, 0.98
#: Vectors that centroids are fitted on, nodes of a shard, centroids at most, nodes of a part.
SAMPLE, SHARD, MAX_CENTROIDS, MAX_SHARD = 20_000, 1200, 4096, 1500
OVERLAP, NEAR, DEGREE, SLACK, BEAM, QUERIES = 2, 48, 24, 1.2, 16, 128
AUDIT = 128
#: Steps of a search that are taken at once.
STEPS = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    top = np.abs(x).max(axis=1, keepdims=True)  # norms neither overflow nor vanish
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds if k > 1 else 1):
        own = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c.astype("f4")


def reach_trees(x: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Edges of the trees that span what pairs within ``reach`` connect, by the nearest pairs."""
    best, above, todo, out = np.full(len(x), -2, "f4"), np.zeros(len(x), np.int64), np.ones(len(x), bool), []
    for _ in range(len(x)):
        i = int(np.where(todo, best, -3).argmax())
        if best[i] >= reach:
            out.append((int(above[i]), i))
        todo[i] = False
        s = x @ x[i]
        nearer = todo & (s > best)
        best[nearer], above[nearer] = s[nearer], i
    return out


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row of unit vectors: a candidate stays unless one
    already kept is nearer to it than it is to the node, by ``SLACK``; and its
    neighbours in the trees of ``reach_trees``, however many."""
    n = len(x)
    k = min(NEAR, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    out: list[set[int]] = []
    linked: list[np.ndarray] = []
    reach = MIN_COSINE - 1e-5
    for at in range(0, n, 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        linked.append(at + np.flatnonzero(s.max(axis=1) >= reach))
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(s, near, axis=1)
        order = np.argsort(-sims, axis=1)
        near, dist = np.take_along_axis(near, order, axis=1), 1 - np.take_along_axis(sims, order, axis=1)
        # all candidates' distances to each other, then the choice for all nodes in step
        cand = x[near]
        between = 1 - np.einsum("nid,njd->nij", cand, cand)
        alive = np.ones(near.shape, bool)
        kept = np.zeros(near.shape, bool)
        for i in range(k):
            take = alive[:, i] & (kept.sum(axis=1) < DEGREE)
            kept[take, i] = True
            cut = take[:, None] & (SLACK * between[:, i] <= dist)
            cut[:, : i + 1] = False
            alive &= ~cut
        out += [set(row[m].tolist()) for row, m in zip(near, kept, strict=True)]
    some = np.concatenate(linked)
    for i, j in reach_trees(x[some], reach):
        out[some[i]].add(int(some[j]))
        out[some[j]].add(int(some[i]))
    for i, row in enumerate([list(r) for r in out]):  # edges lead back
        for j in row:
            if len(out[j]) < 2 * DEGREE:
                out[j].add(i)
    return [np.fromiter(r, np.int64, len(r)) for r in out]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _mutual(n: int, q: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in both directions: a link found from one end holds for both."""
    hit = np.zeros((n, n), bool)  # n: nodes of two parts at most
    hit[q, o] = True
    hit |= hit.T
    np.fill_diagonal(hit, False)
    return np.nonzero(hit)


def all_pairs(x: np.ndarray, others: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows and which of ``others`` (positions) lie within ``reach``."""
    hits = [np.nonzero(x[at : at + 1024] @ x[others].T >= reach) for at in range(0, len(x), 1024)]
    return np.concatenate([a + 1024 * i for i, (a, _) in enumerate(hits)]), others[np.concatenate([b for _, b in hits])]


def _walk(x: np.ndarray, part: np.ndarray, degree: np.ndarray, edges: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of x as a query, what it finds in ``part`` (positions, with
    degrees and edges, one after the other, of their own): best first from the part's medoid, and from the
    query itself where it lies there, through all within ``reach`` and ``beam``
    nodes beyond it."""
    inside = x[part]
    n = len(part)
    own = np.full(len(x), -1)
    own[part] = np.arange(n)
    start = int((inside @ inside.mean(axis=0)).argmax())
    first = np.cumsum(degree) - degree
    found_q, found_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(x), QUERIES):
        q = x[at : at + QUERIES]
        m = len(q)
        sims = np.full((m, n), -2, "f4")
        open_ = np.full((m, n), -2, "f4")  # sims of seen nodes that are not expanded yet
        live = np.arange(m)
        sims[:, start] = open_[:, start] = q @ inside[start]
        self_ = own[at : at + QUERIES]
        here = np.flatnonzero(self_ >= 0)
        sims[here, self_[here]] = open_[here, self_[here]] = 1
        beyond = np.zeros(m, np.int64)
        while len(live):
            # all seen nodes within reach are expanded; where there are none, the best of the others
            within = open_[live] >= reach
            r, c = np.nonzero(within)
            r, rest = live[r], live[~within.any(axis=1)]
            best = open_[rest].argmax(axis=1)
            go = (open_[rest, best] > -2) & (beyond[rest] < beam)
            rest, best = rest[go], best[go]
            beyond[rest] += 1
            live = np.union1d(r, rest)
            r, c = np.concatenate((rest, r[:STEPS])), np.concatenate((best, c[:STEPS]))
            open_[r, c] = -2
            d = degree[c]
            key = np.repeat(r, d) * n + edges[np.repeat(first[c] - np.cumsum(d) + d, d) + np.arange(d.sum())]
            key = np.unique(key[sims.ravel()[key] <= -2])
            r, c = key // n, key % n
            sims[r, c] = open_[r, c] = np.einsum("kd,kd->k", inside[c], q[r])
        a, b = np.nonzero(sims >= reach)
        found_q.append(a + at)
        found_x.append(part[b])
    return np.concatenate(found_q), np.concatenate(found_x)


def range_search(x: np.ndarray, adjacency: np.ndarray, reach: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row as a query, a search of each connected part of the graph:
    near copies can be all of each other's nearest, and no edge then leads out of
    their group. Parts no larger than what a search looks at are compared whole.
    adjacency: (n, degree), short rows filled with the node itself."""
    n, width = adjacency.shape
    root = _roots(n, np.repeat(np.arange(n), width), adjacency.ravel())
    name, size = np.unique(root, return_counts=True)
    small = size <= beam * DEGREE
    q, o = all_pairs(x, np.flatnonzero(np.isin(root, name[small])), reach)
    found = [(q, o)]
    local = np.zeros(n, np.int64)
    for r in name[~small]:
        part = np.flatnonzero(root == r)
        local[part] = np.arange(len(part))
        true = adjacency[part] != part[:, None]
        found.append(_walk(x, part, true.sum(axis=1), local[adjacency[part][true]], reach, beam))
    return _mutual(n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _exact(vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have the cosine, in double precision."""
    u = _unit(vectors)
    return np.concatenate([(u[a[i : i + 65536]] * u[b[i : i + 65536]]).sum(axis=1) >= MIN_COSINE for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)


def _links(nodes: DataFrame, kmeans: np.ndarray | None, overlap: int, beam: int | None, watched: np.ndarray) -> tuple[DataFrame, str]:
    """(node, others: rows linked in pairs counted here, root: its component's
    name here, near: the nodes of those pairs for ``watched`` nodes), a row for
    each node and pair of parts of a shard, and its table. Without centroids
    each length is a shard; without a beam, all pairs of a shard are compared."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(kmeans)  # MAX_CENTROIDS at most

    def deal(batches):
        for batch in batches:
            v = _matrix(batch.column(1))
            s = _unit(v).astype("f4") @ shared.value.T
            k = min(overlap, s.shape[1])
            shard = np.argsort(-s, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(v)), k)
            yield pa.RecordBatch.from_arrays([pa.array(shard.ravel().astype("i8")),
                pa.array([*np.sort(shard, axis=1).astype("i8")], pa.list_(pa.int64())).take(pa.array(at)), *(batch.column(c).take(pa.array(at)) for c in range(3))],
                names=["shard", "shards", "node", "v", "n"])

    if kmeans is None:
        dealt = nodes.select(F.size("v").cast("long").alias("shard"), F.array(F.size("v").cast("long")).alias("shards"), "node", "v", "n")
    else:
        dealt = nodes.select("node", "v", "n").mapInArrow(tidied(deal), "shard long, shards array<long>, node long, v array<double>, n long")
    dealt, dealt_path = stash(dealt, "dealt")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("size"))
    # a shard too large for a task: its nodes are dealt into parts, and every two parts meet; two would be the shard again
    dealt = dealt.join(sizes, "shard").withColumn("parts", F.when(F.col("size") > 2 * MAX_SHARD, F.ceil(F.col("size") / MAX_SHARD)).otherwise(1).cast("int"))
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0))
    own = dealt.select("shard", "shards", "node", "v", "n", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    keys = ["shard", "left", "right"]
    own = own.select("shard", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "shards", "node", "v", "n", "part")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy()
        adj = robust_prune(_unit(np.stack(pdf["v"])).astype("f4"))
        return pd.DataFrame({"node": node, "edges": [node[a] for a in adj]})

    if beam is None:
        ready = own
    else:
        edges = own.groupBy(*keys).applyInPandas(build, "node long, edges array<long>")
        united = edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
        ready = own.join(united, "node")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        node, v = pdf["node"].to_numpy(), np.stack(pdf["v"])
        x = _unit(v).astype("f4")
        if beam is None:
            a, b = _mutual(len(node), *all_pairs(x, np.arange(len(node)), MIN_COSINE - 1e-5))
        else:
            width = max(1, max(map(len, pdf["edges"])))
            adj = np.repeat(np.arange(len(node))[:, None], width, axis=1)
            for i, e in enumerate(pdf["edges"]):
                local = np.searchsorted(node, np.asarray(e)[np.isin(e, node)])
                adj[i, : len(local)] = local
            a, b = range_search(x, adj, MIN_COSINE - 1e-5, beam)
        sure = _exact(v, a, b)
        a, b = a[sure], b[sure]
        root = _roots(len(node), a, b)
        mine = _counted_here(np.stack(pdf["shards"]), pdf["part"].to_numpy(), pdf["shard"][0], pdf["left"][0], pdf["right"][0], a, b)
        a, b = a[mine], b[mine]
        others = np.bincount(a, pdf["n"].to_numpy()[b], len(node)).astype("i8")
        near: list = [None] * len(node)
        for i in np.flatnonzero(np.isin(node, watched)):
            near[i] = node[b[a == i]]
        return pd.DataFrame({"node": node, "others": others, "root": node[root], "near": near})

    out, path = stash(ready.groupBy(*keys).applyInPandas(search, "node long, others long, root long, near array<long>"), "near")
    discard(spark, dealt_path)
    return out, path


def _counted_here(shards: np.ndarray, part: np.ndarray, shard: int, left: int, right: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether this is the smallest shard that both positions of a pair are in,
    and these are their parts of it."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 65536):
        i, j = a[at : at + 65536], b[at : at + 65536]
        common = np.where((shards[i][:, :, None] == shards[j][:, None, :]).any(axis=2), shards[i], np.iinfo("i8").max).min(axis=1)
        out[at : at + 65536] = (common == shard) & (np.minimum(part[i], part[j]) == left) & (np.maximum(part[i], part[j]) == right)
    return out


def true_links(nodes: DataFrame, count: int = AUDIT) -> tuple[np.ndarray, DataFrame, str]:
    """A sample of nodes, all their links by brute force over all nodes as
    (node, other), and the table that these are written to."""
    spark = nodes.sparkSession
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(count).select("node", "v").toPandas()
    size = picked["v"].map(len)
    groups = {n: (picked["node"][size == n].to_numpy(), _unit(np.stack(picked["v"][size == n]))) for n in size.unique()}
    shared = spark.sparkContext.broadcast(groups)  # a sample of fixed size

    def brute(batches):
        for batch in batches:
            length = np.array([len(v) for v in batch.column(1)])
            found = [np.zeros((0, 2), np.int64)]
            for n, (ids, q) in shared.value.items():
                at = pa.array(np.flatnonzero(length == n))
                if len(at):
                    node = batch.column(0).take(at).to_numpy()
                    i, j = np.nonzero(_unit(_matrix(batch.column(1).take(at))) @ q.T >= MIN_COSINE)
                    found.append(np.stack((ids[j], node[i]), axis=1)[node[i] != ids[j]])
            pair = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["node", "other"])

    true, path = stash(nodes.select("node", "v").mapInArrow(tidied(brute), "node long, other long"), "audit")
    return picked["node"].to_numpy(), true, path


def _searched(nodes: DataFrame, sample: np.ndarray | None = None, count: int = 0) -> tuple[DataFrame, str, float]:
    """What ``_links`` finds once the audit is content, its table, the recall.
    With a ``sample`` of the ``count`` nodes there are centroids, else none."""
    spark = nodes.sparkSession
    watched, true, true_path = true_links(nodes)
    total = true.count()
    overlap, beam = OVERLAP, BEAM
    fitted = lambda: None if sample is None else centroids(sample, min(MAX_CENTROIDS, -(-count * overlap // SHARD)))
    kmeans = fitted()
    while True:
        found, path = _links(nodes, kmeans, overlap, beam, watched)
        got = found.filter(F.col("near").isNotNull()).select("node", F.explode("near").alias("other"))
        recall = true.join(got, ["node", "other"], "left_semi").count() / total if total else 1.0
        if recall >= MIN_RECALL:
            discard(spark, true_path)
            return found, path, recall
        discard(spark, path)
        if beam is None:
            raise RuntimeError(f"recall {recall} after all pairs were compared")
        if kmeans is None or overlap * overlap >= len(kmeans):  # all pairs cost no more than wider shards
            kmeans, overlap, beam = None if kmeans is None else kmeans[:1], 1, None
        else:
            overlap, beam = 2 * overlap, 2 * beam
            kmeans = fitted()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall (as audited)."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows, rows_path = stash(rows.withColumn("ok", F.coalesce(finite, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.xxhash64("v"))), "vectors")
    nodes, nodes_path = stash(rows.filter("ok").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"),
        F.min("v").alias("v")).withColumnRenamed("key", "node"), "nodes")
    few = SHARD // OVERLAP
    length = F.size("v")
    counts = {r["k"]: r["n"] for r in nodes.groupBy(length.alias("k")).agg(F.count("*").alias("n")).filter(F.col("n") > few).collect()}  # lengths in common use
    runs = []
    for k, count in sorted(counts.items()):
        own = nodes.filter(length == k)
        share = max(1, min(1_000_003, int(1_000_003 * SAMPLE / count)))
        sample = own.filter(F.pmod("node", F.lit(1_000_003)) < share).orderBy("node").limit(SAMPLE).select("v").toPandas()["v"]
        sample = _unit(np.stack(sample if len(sample) else own.limit(1).toPandas()["v"])).astype("f4")
        runs.append(_searched(own, sample, count))
    rest = nodes.filter(~length.isin(*counts)) if counts else nodes
    if not rest.isEmpty():
        runs.append(_searched(rest))
    if not runs:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    linked, paths, recall = runs[0][0], [r[1] for r in runs], min(r[2] for r in runs)
    for found, _, _ in runs[1:]:
        linked = linked.unionByName(found)
    sums = linked.groupBy("node").agg(F.sum("others").alias("others"))
    roots, root_paths = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v"))
    named = nodes.select("node", "n", "least").join(sums, "node", "left").join(roots, "node", "left").select("node", "n", "least",
        F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "node").alias("root"))
    named, _ = stash(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("key"), "n", "others", "component_id"), "named")
    discard(spark, nodes_path, *paths, *root_paths)
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
