import hashlib
import re

import pytest

from nephrolake.llm import pii

from .fixtures import documents, edges, empty, written

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
RULES = {
    "email": EMAIL,
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def sure(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in hit.split(".")),
            "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def brute(text):
    spans = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, rule) in enumerate(RULES.items()) if k != "email" or "@" in text for m in rule.finditer(text) if sure(k, m[0])]
    return [x[2] for x in sorted(spans)]


@pytest.mark.parametrize("table", [documents, edges])
def test_base_spans(spark, table, tmp_path):
    docs = table(spark)
    if table is edges:
        docs = docs.filter("doc_id is distinct from 12")  # brute force is quadratic there
    got = pii.query(spark, written(docs, tmp_path, "documents"))
    want = sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(",".join(brute(r.text or "")).encode()).hexdigest()) for r in docs.collect())
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in rows) == want
    for r in rows:
        kinds = [x.split(":")[0] for x in r.spans.split(",") if x]
        assert [kinds.count(k) for k in RULES] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_long_runs_and_added_kinds(spark):
    rows = {r.doc_id: r.spans for r in pii.find_pii(edges(spark)).collect()}
    assert [s.kind for s in rows[12]] == ["email"] and rows[11] == []
    kinds = {s.kind for s in rows[14]}
    assert {"iban", "local_phone"} <= kinds
    near = {s.kind: s.score for s in rows[13]}
    assert near["email"] > pii.PRIOR["email"] and near["phone"] > pii.PRIOR["phone"] and near["card"] == pii.PRIOR["card"]


def test_redact_and_empty(spark):
    text = {r.doc_id: r.text for r in pii.redact(edges(spark)).collect()}
    assert text[13] == "mail me: <EMAIL>, call <PHONE> or pay <CARD> from <IP> not 1.2.3.256"
    assert text[3].startswith("a line") and text[6] is None
    assert pii.find_pii(empty(spark)).count() == 0


def test_many_spans_in_one_text(spark):
    """Time follows the text: 40,000 addresses, numbers and accounts in one."""
    import time

    line = "mail a.{0}@b{0}.org, call +49 30 {1}, from 10.0.0.{2}; iban DE89 3704 0044 0532 0130 00 or 4111 1111 1111 1111\n"
    texts = ["".join(line.format(i, 1234567 + i, i % 300) for i in range(8000)), "é@b.c a@b.cd " * 20_000, "DE89 3704 0044 0532 0130 00 +49 30 1234567@x.de;" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    df.count()
    start = time.time()
    rows = {r.doc_id: r for r in pii.redact(df).collect()}
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert time.time() - start < 60
    for i, t in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in spans[i] if s.rank < len(pii.BASE)] == brute(t)
    assert sum(s.kind == "iban" for s in spans[0]) == 8000 and not any(s.kind == "local_phone" for s in spans[0])
    assert rows[1].text == "é@b.c <EMAIL> " * 20_000
    first = line.format(1, 1234568, 1).replace("a.1@b1.org", "<EMAIL>").replace("+49 30 1234568", "<PHONE>").replace("10.0.0.1;",
        "<IP>;").replace("DE89 3704 0044 0532 0130 00", "<IBAN>").replace("4111 1111 1111 1111", "<CARD>")
    assert rows[0].text.split("\n")[1] == first[:-1]


def test_running(spark):
    import itertools

    for n in (0, 1, 63, 64, 65, 200, 5000):
        x = [(7 * i * i) % 11 - 3 for i in range(n)]
        df = spark.createDataFrame([(x,)], "x array<int>")
        got = df.select(pii._running(pii.F.col("x"), pii._sum, 0).alias("s"), pii._running(pii.F.col("x"), pii.F.greatest, -9).alias("m")).first()
        assert got.s == [*itertools.accumulate(x)] and got.m == [*itertools.accumulate(x, max)]
