"""Packing by power-of-two decomposition.

Each document is tokenised, ended by one separator id and cut into pieces
whose lengths are powers of two (full sequences first, then the binary digits
of the remainder). A piece is a sequence of its own, kept in the bucket of
its length: no sequence crosses documents and none needs padding.

Defined cases: a null or empty text gives one piece with the separator alone;
a null ``doc_id`` is kept as null; repeated rows give their pieces once each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, read_table, stash, tidied

MAX_LENGTH = 1024
#: Offsets (one row per task and bucket) are broadcast up to this many rows.
BROADCAST_ROWS = 50_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: a byte that prints is
    itself, the others follow from code point 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder for a byte-level BPE file of the tokenizers library.

    The merges run in tiktoken over the vocabulary of that file, which gives
    the same ids several times faster; a text that spells a special token goes
    to the tokenizers library itself.
    """

    def __init__(self, vocab_json: str) -> None:
        import tiktoken

        with open(vocab_json, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._slow = vocab_json, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self.path)
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def cuts(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens, longest first."""
    out = [(s, max_length) for s in range(0, n - n % max_length, max_length)]
    at, rest = n - n % max_length, n % max_length
    size = max_length
    while rest:
        if rest & size:
            out.append((at, size))
            at, rest = at + size, rest ^ size
        size >>= 1
    return out


def pack(docs: DataFrame, vocab_json: str, max_length: int = MAX_LENGTH, separator: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ``ids`` if asked for. Sequence ids run without
    gaps through the buckets, longest first. ``max_length``: a power of two."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    spark = prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long" + ", ids array<int>" * keep_ids

    def cut(batches):
        enc, part, counts = encoder(vocab_json), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows, ids_of, crc, ids_out = [], [], [], []
            doc_ids = batch.column(0)
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*(enc.encode(text) if text else ()), separator], dtype="<u4")
                for start, length in cuts(len(ids), max_length):
                    nth = counts[length] = counts.get(length, 0) + 1
                    rows.append((start, length, len(ids), nth - 1))
                    ids_of.append(i)
                    crc.append(zlib.crc32(ids[start : start + length].tobytes()))
                    if keep_ids:
                        ids_out.append(ids[start : start + length].astype("int32"))
            start, length, tokens, nth = np.array(rows, dtype="int64").reshape(-1, 4).T
            columns = [doc_ids.take(pa.array(ids_of, pa.int64())), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens),
                pa.array(np.full(len(nth), part, dtype="int64")), pa.array(nth)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    pieces, _ = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(cut), schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before, base = 0, F.lit(0).cast("long")
    for row in sorted(pieces.groupBy("length").agg(F.count("*").alias("n")).collect(), reverse=True):  # a row for each power of two
        base = F.when(F.col("length") == row["length"], F.lit(before).cast("long")).otherwise(base)
        before += row["n"]
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", (base + F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("first"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    out = pieces.join(offsets, ["length", "part"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
