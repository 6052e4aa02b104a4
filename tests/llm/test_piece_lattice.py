import random

import public_tokenizers
import pytest

from nephrolake.llm import piece_lattice

from .fixtures import canon, documents, edges, empty

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return piece_lattice.lattice(MODEL)


def everything(model, s):
    """(score, ids) of every segmentation of a marked text."""
    if not s:
        return [(0, ())]
    out = []
    for j in range(1, len(s) + 1):
        head = s[:j]
        if head in model.known:
            i, v = model.known[head]
            out += [(v + w, (i, *r)) for w, r in everything(model, s[j:])]
    if s[0] not in model.known:
        data = (piece_lattice.SPACE if s[0] == piece_lattice.LITERAL else s[0]).encode()
        out += [(model.byte_score * len(data) + w, (*(model.byte_ids[b] for b in data), *r)) for w, r in everything(model, s[1:])]
    return out


def test_n_best_against_all_segmentations(model):
    rng = random.Random(1)
    texts = ["", "a", " ", "  a", "\n", "ab\ncd", "▁x", "the hat", "é́\U0001f600",
        "aaaa aa"] + ["".join(rng.choice("aeinrst \n▁é日") for _ in range(rng.randrange(1, 11))) for _ in range(150)]
    for n in (1, 2, 4, 9):
        for text, (ids, score, more) in zip(texts, model.encode(texts, n), strict=True):
            marked = piece_lattice.SPACE + text.replace(piece_lattice.SPACE, piece_lattice.LITERAL).replace(" ", piece_lattice.SPACE) if text else ""
            every = everything(model, marked)
            want = sorted((s for s, _ in every), reverse=True)[:n]
            assert [score, *(s for s, _ in more)] == want, text
            got = [(score, tuple(ids.tolist())), *((s, tuple(x.tolist())) for s, x in more)]
            assert {*got} <= {*every} and len({*got}) == len(got)
            assert all(model.decode(x) == text for _, x in got)


def test_search_and_numpy_pass_agree(model):
    words = [piece_lattice.SPACE + w for w in "segmentation of some longer words internationalization".split()]
    for w in words:
        found = model.search(w, 3)
        assert found == sorted(found, key=lambda x: -x[0])
        if len(w) <= piece_lattice.SHORT:
            ids, score, _ = model.encode([w[1:]], 1)[0]
            assert score == found[0][0] and sum(model.scores[model.ids == i][0] for i in ids) == score


@pytest.mark.parametrize("table", [documents, edges])
def test_whole_tables_round_trip(spark, table):
    docs = table(spark)
    rows = piece_lattice.encode(docs, MODEL, keep_ids=True).cache()
    assert all(r.restored for r in rows.collect())
    back = piece_lattice.decode(rows, MODEL).collect()
    assert canon((r.doc_id, r.text) for r in back) == canon((r.doc_id, r.text or "") for r in docs.collect())


def test_empty(spark):
    assert piece_lattice.encode(empty(spark), MODEL).count() == 0
