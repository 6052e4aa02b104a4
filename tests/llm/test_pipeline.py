from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from nephrolake.llm import packing

from . import test_line_dedup, test_ngram_join
from .fixtures import DATA, edges, empty


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, at = {}, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(i)))
        kept[name], at = at, spark.read.parquet(str(tmp_path / str(i)))
    text = lambda name: {r.doc_id: r.text for r in kept[name].collect()}
    raw, named, lines, unique, clean = (text(n) for n, _ in corpus_pipeline.STAGES)
    assert named == {i: t for i, t in raw.items() if any(c.isalpha() for c in t)}
    want = test_line_dedup.brute([*named.items()], 40, 5)
    assert {i: n for i, n, *_ in want} == {i: t.count("\n") + 1 for i, t in named.items()}
    dropped = {i: k for i, _, k, _ in want}
    assert {i: named[i].count("\n") - lines[i].count("\n") if lines[i] else None for i in named} == {i: (k if lines[i] else None) for i, k in dropped.items()}
    groups = test_ngram_join.brute([*lines.items()])
    assert unique.keys() == {c for _, _, c in groups} and all(unique[i] == lines[i] for i in unique)
    assert clean.keys() == unique.keys()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = defaultdict(int)
    for r in at.collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}


def test_edges_and_empty(spark):
    for table in (edges(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, DATA).count() >= 0


def test_nothing_to_learn_from(spark):
    """Without a label, only documents without a letter go."""
    docs = spark.createDataFrame([(1, "plain words", None), (2, "12 \u00bd \u00b2 _", None), (3, None, None), (4, "\u00e9", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()} == {1, 4}


def test_one_id_on_several_texts(spark):
    """Texts under one id that are not linked stay; of linked ones the least id does."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black brown")
    docs = spark.createDataFrame([(5, a), (5, b), (9, b), (7, c), (7, c + " "), (3, ""), (3, None)], "doc_id long, text string")
    kept = [(r.doc_id, (r.text or "").strip()) for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()]
    assert sorted(kept) == [(3, ""), (3, ""), (5, a), (5, b), (7, c)]


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == packing.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).columns and out.count() > 200
