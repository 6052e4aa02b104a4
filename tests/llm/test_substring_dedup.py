import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from nephrolake.llm import substring_dedup

from .fixtures import canon, documents, edges, empty, written


def brute(rows, length=50):
    least = {}
    for d, text in rows:
        data = (text or "").encode()
        if d is not None:
            for s in range(len(data) - length + 1):
                w = data[s : s + length]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        if d is not None:
            for s in range(len(data) - length + 1):
                if least[data[s : s + length]] < d:
                    gone[s : s + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(data) else 0
        out.append((d, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def tangled(spark):
    """Shared passages at all offsets, nested and touching, copies, periods and NUL bytes."""
    rng = random.Random(9)
    piece = lambda n: "".join(rng.choice("abcd ü\0") for _ in range(n))
    stock = [piece(rng.choice([45, 49, 50, 51, 80, 300])) for _ in range(12)] + ["xy" * 60, "z" * 140]
    rows = []
    for i in range(160):
        rows.append((rng.randrange(10**6), "".join(rng.choice(stock)[rng.choice([0, 0, 1,
            7]) :] if rng.random() < 0.6 else piece(rng.randrange(90)) for _ in range(rng.randrange(1, 7)))))
    rows += [(i + 1, rows[i][1]) for i in range(5)] + [rows[0], (rows[1][0], rows[2][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def some_documents(spark):
    return documents(spark).limit(120)


@pytest.mark.parametrize("table", [some_documents, edges, tangled])
def test_against_brute_force(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_SUFFIXES", 500)
    path = written(table(spark), tmp_path, "documents")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = substring_dedup.query(spark, path).collect()
    assert canon(got) == canon(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_without_broadcast(spark, tmp_path, monkeypatch):
    path = written(tangled(spark), tmp_path, "documents")
    want = canon(substring_dedup.query(spark, path).collect())
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", -1)
    assert canon(substring_dedup.query(spark, path).collect()) == want


def test_empty(spark):
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_front_coding_round_trip():
    rng = np.random.default_rng(0)
    m = rng.integers(97, 99, (300, 20)).astype(np.uint8)
    m = m[np.lexsort(m.T[::-1])]
    lcp, rest = substring_dedup.front_code(m)
    assert (substring_dedup.front_decode(lcp, rest, 20) == m).all() and len(rest) < m.size


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 8])
def test_loser_tree(runs, monkeypatch):
    rng = np.random.default_rng(runs)
    tables = []
    for r in range(runs):
        m = rng.integers(97, 99, (0 if r == 5 else 40 * r + 1, 12)).astype(np.uint8)
        tables.append(m[np.lexsort(m.T[::-1])])
    known = defaultdict(int)
    real = substring_dedup._extend

    def extend(a, b, h):
        assert a[:h] == b[:h]
        known[h] += 1
        return real(a, b, h)

    monkeypatch.setattr(substring_dedup, "_extend", extend)
    run, row, lcp = substring_dedup.merge_runs([(t.tobytes(), substring_dedup.front_code(t)[0]) for t in tables], 12)
    got = [tables[a][b].tobytes() for a, b in zip(run, row, strict=True)]
    assert got == sorted(t.tobytes() for m in tables for t in m)
    assert lcp[0] == 0 and all(real(a, b, 0) == h for a, b, h in zip(got, got[1:], lcp[1:], strict=False))
    if runs > 2:
        assert sum(v for k, v in known.items() if k) > 0


def test_anchors_of_very_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (900, 10, 2300, 60)]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    want = substring_dedup.anchors(data, ends)
    kept = substring_dedup._POSITION
    monkeypatch.setattr(substring_dedup, "_POSITION", np.uint64(511))
    got = substring_dedup.anchors(data, ends)
    assert kept > 511 and len(want[0]) and {*want[0]} == {*got[0]}
