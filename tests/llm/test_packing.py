import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nephrolake.llm import packing

from .fixtures import documents, edges, empty

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def whole(docs):
    tok = Tokenizer.from_file(VOCAB)
    return [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("table", [documents, edges])
def test_pieces_rebuild_documents(spark, table):
    docs = table(spark)
    rows = packing.pack(docs, VOCAB, keep_ids=True).collect()
    want, got = defaultdict(list), defaultdict(list)
    for doc, ids in whole(docs):
        want[doc].append(ids)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and 0 < r.length <= 1024 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    for doc, texts in want.items():
        assert sum(map(len, texts)) == sum(len(x[1]) for x in got[doc])
        if len(texts) == 1:
            assert [i for x in sorted(got[doc]) for i in x[1]] == texts[0] and {x[2] for x in got[doc]} == {len(texts[0])}


def test_empty_and_bad_length(spark):
    assert packing.pack(empty(spark), VOCAB).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), VOCAB, max_length=1000)


def test_cuts():
    assert packing.cuts(2 * 8 + 5, 8) == [(0, 8), (8, 8), (16, 4), (20, 1)]
    for n in range(200):
        assert sum(x[1] for x in packing.cuts(n, 16)) == n


def test_same_ids_as_the_tokenizers_library():
    """The fast path against the library itself: documents, odd Unicode, entries of the vocabulary."""
    import json
    import random

    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng, tok, enc = random.Random(7), Tokenizer.from_file(path), packing.encoder(path)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    pool = [*" \t\n\r\x0b\u00a0\u2028'", *"abcXYZ0189.,!?|<>#", "\u00e9", "e\u0301", "\u05d0", "\u4e2d", "\U0001f600", "\u200d", "\ufeff", "'s", "'LL", "\u0130", "\u00df"]
    texts += ["".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(3000)]
    names = [*json.load(open(path, encoding="utf-8"))["model"]["vocab"]]
    texts += ["".join(rng.choices(names, k=4)) for _ in range(500)]
    for text in filter(None, texts):
        assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids, text[:80]
