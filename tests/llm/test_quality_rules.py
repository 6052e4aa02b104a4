import re
from collections import Counter

import pytest

from nephrolake.llm import quality_rules

from .fixtures import canon, documents, edges, empty, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]",
        text)), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


@pytest.mark.parametrize("table", [documents, edges])
def test_counts(spark, table, tmp_path):
    docs = table(spark)
    got = quality_rules.query(spark, written(docs, tmp_path, "documents")).collect()
    assert canon(tuple(r)[:-1] for r in got) == canon((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in got)


def test_line_rules(spark):
    good = "Plain sentences of words that mean well, and end as they should do. " * 3
    texts = {1: good, 2: "Home | News | Sport | Weather | Mail | More\n" * 2 + "x", 3: good + "\nAll rights reserved.\n" + good, 4: "&&& ### $$$ a b c d e f g h i j k l\nword"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    assert rows[1].clean_text == good and "reserved" not in rows[3].clean_text
    assert rows[2].clean_text == "x" and not rows[2].kept and not rows[4].kept


def test_clean_documents_stay(spark):
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id")
    rows = quality_rules.measure(good).filter("not base_failed").collect()
    assert sum(r.kept for r in rows) >= 0.98 * len(rows)


def test_empty(spark):
    assert quality_rules.measure(empty(spark)).count() == 0
