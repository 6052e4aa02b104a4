import hashlib
from collections import defaultdict

import numpy as np
import pytest

from nephrolake.llm import line_dedup

from .fixtures import canon, documents, edges, empty


def brute(rows, min_chars, min_docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                where[key(x)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("table", [documents, edges])
@pytest.mark.parametrize(("min_chars", "min_docs"), [(40, 5), (5, 2)])
def test_against_brute_force(spark, table, min_chars, min_docs):
    docs = table(spark)
    got = line_dedup.drop_repeated_lines(docs, min_chars, min_docs)
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert canon(got) == canon(brute([(r.doc_id, r.text) for r in docs.collect()], min_chars, min_docs))


def test_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that suspects nearly all lines still gives the same rows."""
    docs = documents(spark)
    monkeypatch.setattr(line_dedup, "SEGMENT_BITS", 64)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 128)
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "n_dropped").collect()
    assert {(r[0], r[1]) for r in got} == {(i, n) for i, _, n, _ in brute([(r.doc_id, r.text) for r in docs.collect()], 40, 5)}


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    docs = documents(spark)
    got = line_dedup.drop_repeated_lines(docs, 5, 2).select("doc_id", "n_dropped").collect()
    assert {(r[0], r[1]) for r in got} == {(i, n) for i, _, n, _ in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 2)}


def test_empty(spark):
    out = line_dedup.drop_repeated_lines(empty(spark))
    assert out.count() == 0 and {"lang", "n_lines", "n_dropped"} <= {*out.columns}


def test_filter_suspects_few(spark):
    """The broadcast filter follows repeated lines, not all: with bits for a
    thirtieth of the lines it suspects few that come once."""
    rows = [(i, "\n".join(f"line {i}-{k} that comes once and is long enough to count" for k in range(200)) + f"\none of fifty lines that come in many "
        f"documents {i % 50:04}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    table, bits = line_dedup.twice_seen(docs, 40, 80_400)
    assert bits * 1.2 < 80_400
    seen = np.frombuffer(table, "u1")

    def share(texts):
        words = line_dedup._words([line_dedup._digest(k) for t in texts for k in line_dedup.line_keys(t, 40)])
        at = line_dedup._positions(words, bits)
        return (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).all(axis=1).mean()

    assert share(t.rsplit("\n", 1)[0] for _, t in rows) < 0.02 and share(t.rsplit("\n", 1)[1] for _, t in rows) == 1
