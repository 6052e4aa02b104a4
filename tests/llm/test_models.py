"""Language identification and the quality model: held-out accuracy and edges."""

import numpy as np
from pyspark.sql import functions as F

from nephrolake.llm import language_id, quality_model

from .fixtures import documents, edges, empty, written

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, tmp_path):
    net = language_id.fit_on_documents(documents(spark))
    rows = language_id.predict(edges(spark), net).collect()
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)), r.doc_id
    assert language_id.predict(empty(spark), net).count() == 0
    # no labels: nothing can be named
    assert {r.lang_pred for r in language_id.query(spark, written(edges(spark), tmp_path, "documents")).collect()} == {"und"}


def test_inputs_of_a_prediction(spark):
    """The same text has the same answer whatever its id, source and lang."""
    net = language_id.fit_on_documents(documents(spark))
    docs = documents(spark).limit(30)
    moved = docs.withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    key = lambda d: sorted((r.text, r.lang_pred, r.score) for r in language_id.predict(d, net).collect())
    assert key(docs) == key(moved)


def test_windows_cover_the_text():
    text = "äb" * 1000
    x = language_id.windows_of(text.encode())
    assert x.tobytes().rstrip(b"\0") == text.encode() and x.shape[1] == language_id.WINDOW


def test_tables_match_the_filters():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b"], [rng.normal(size=(w, 256, 16)).astype("f4") for w in language_id.WIDTHS], rng.normal(size=48).astype("f4"),
        rng.normal(size=(48, 2)).astype("f4"), np.zeros(2, "f4"))
    x = rng.integers(0, 256, (5, 256)).astype(np.uint8)
    z = np.concatenate([sum(p[j][x[:, j : 256 - w + 1 + j]] for j in range(w)).max(axis=1) for w, p in zip(language_id.WIDTHS, net.filters, strict=True)], axis=1)
    want = language_id._softmax(np.maximum(z + net.bias, 0) @ net.out)
    assert np.allclose(language_id.Scorer(net).probabilities(x), want, atol=1e-4)


def test_language_against_brute_force(spark):
    """The query's answers from plain filters over every window of every text; copies tie."""
    data = "/root/testdata/sf0.001"
    docs = documents(spark).select("doc_id", "text", "lang")
    net = language_id.fit_on_documents(docs)
    want = {}
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            want[r.doc_id] = ("und", 0.0)
            continue
        data_ = r.text.encode()
        x = language_id.windows_of(data_)
        z = np.concatenate([sum(p[j][x[:, j : 256 - w + 1 + j]] for j in range(w)).max(axis=1) for w, p in zip(language_id.WIDTHS, net.filters, strict=True)], axis=1)
        prob = language_id._softmax(np.maximum(z + net.bias, 0) @ net.out + net.out_bias)
        size = np.array([len(data_[i : i + 256]) for i in range(0, len(data_), 256)])
        mean = (prob * size[:, None]).sum(axis=0) / size.sum()
        want[r.doc_id] = (net.languages[int(mean.argmax())], float(mean.max()))
    rows = language_id.query(spark, data).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-3


def test_quality_against_brute_force(spark):
    """The query's scores from its own tables, looked up one by one; copies tie."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet").filter(~language_id.held_out(4, 2))
    model = quality_model.fit(quality_model.measure(docs), labels)
    want = {}
    for r in docs.collect():
        x = quality_model.features_of(r.text)
        z = model.base + sum(t[sum(v >= e for e in edge)] for v, edge, t in zip(x, model.edges, model.tables, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            z += t[sum(x[i] >= e for e in model.pair_edges[i]), sum(x[j] >= e for e in model.pair_edges[j])]
        want[r.doc_id] = 1 / (1 + np.exp(-z))
    rows = quality_model.query(spark, data).collect()
    assert len(rows) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-9 for r in rows)


def test_repeats_at_any_distance():
    words = ["w%d" % i for i in range(23)]
    at = quality_model.FEATURES.index("repeat_fives")
    for gap in range(5):
        text = " ".join(words + ["g%d" % i for i in range(gap)] + words)
        assert quality_model.features_of(text)[at] > 0.3
    assert quality_model.features_of(" ".join(words))[at] == 0


def test_quality_sample_follows_ids(spark):
    """With labels of documents that are not there the sample is still full, and ties in ids are kept apart."""
    measured = quality_model.measure(documents(spark))
    ids = [r.doc_id for r in documents(spark).select("doc_id").collect()]
    labels = spark.createDataFrame([(i, i % 2) for i in [*ids, *range(10**6, 10**6 + 4000)]], "doc_id long, quality int")
    seen = []
    real, quality_model.train = quality_model.train, lambda x, y: seen.append(len(y))
    try:
        quality_model.fit(measured, labels, 50)
    finally:
        quality_model.train = real
    assert seen == [50]


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_model.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    order = s.argsort().argsort() + 1.0
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc >= 0.95
    assert np.mean((s >= 0.7) == (y == 1)) >= 0.95 and all(r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_edges(spark):
    measured = quality_model.measure(edges(spark))
    rows = quality_model.score(measured, None).collect()
    assert len(rows) == edges(spark).count() and {r.score for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 0), (9, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality_model.fit(measured, labels)
    assert all(0 <= r.score <= 1 for r in quality_model.score(measured, model).collect())
    assert quality_model.score(quality_model.measure(empty(spark)), model).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    assert np.mean((quality_model.train(x, y).score(x) > 0.5) == y) > 0.9
