r"""Line dedup with once-seen and twice-seen Bloom filters.

Pass 1 sends 64-bit hashes of each document's distinct long lines to the
segment of the once-seen filter that they belong to; a hash that is there
already goes into the twice-seen filter. The once-seen filter grows with the
lines and stays dealt out over the tasks; the twice-seen filter holds repeated
lines only and is broadcast, with at most ``MAX_BITS`` bits, whatever the
input; beyond that more lines are suspected, with the same result. Pass 2
shuffles only the lines that the twice-seen filter suspects; an exact count by
document confirms them and picks the keeper. Pass 3 drops the confirmed lines.

A line's key: the line stripped of ``[\x20\x09-\x0D]`` at both ends, A-Z in
lower case. Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents stay only in the largest doc_id that holds them (all
its copies there).

Defined cases: null or empty text is one empty line; a row with a null doc_id
is left as it is and counts for nothing; rows that share a doc_id count as
one document and each loses the same keys; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, n_parts, prepare, read_table, stash, tidied

MIN_CHARS, MIN_DOCS = 40, 5
STRIP = b" \t\n\x0b\x0c\r"
#: Confirmed lines that are broadcast, at most.
BROADCAST_ROWS = 500_000
#: Bits a line, hash functions, least bits of a segment, bits of the twice-seen filter at most.
BITS_PER_LINE, PROBES, SEGMENT_BITS, MAX_BITS = 16, 3, 1 << 16, 1 << 29
#: Most bits of a segment of the once-seen filter, hashes that a task holds before it sends them.
MOST_SEGMENT_BITS, HELD = 1 << 24, 1 << 19
#: About so many bytes of text to a long line; only the filters' size depends on it.
BYTES_PER_LINE = 256


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None for keys that are too short to matter."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(STRIP)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(key.lower() if long else None)
    return out


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _words(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of each digest."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)[:, 0]


def _positions(words: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each word."""
    a, b = words * np.uint64(0x9E3779B97F4A7C15), (words >> np.uint64(29)) | np.uint64(1)
    a ^= a >> np.uint64(32)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def filter_bits(lines: int, least: int = SEGMENT_BITS, most: int = MAX_BITS) -> int:
    """A power of two with about BITS_PER_LINE bits a line, within bounds."""
    return min(most, max(least, 1 << (max(1, lines) * BITS_PER_LINE - 1).bit_length()))


def _by_part(kind: int, words: np.ndarray, parts: int):
    """(part, kind, words of that part) for each part that has any."""
    part = (words >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, words = part[order], words[order]
    for p, chunk in zip(np.unique(part), np.split(words, np.flatnonzero(np.diff(part)) + 1), strict=False):
        yield int(p), kind, chunk.tobytes()


def twice_seen(docs: DataFrame, min_chars: int, lines: int) -> tuple[bytes, int]:
    """The twice-seen filter over all documents, as a bitmap, and its bits.
    ``lines``: about how many there are; only the first filter's size depends on it."""
    spark = docs.sparkSession
    segments = max(n_parts(spark), -(-lines * BITS_PER_LINE // MOST_SEGMENT_BITS))
    bits = filter_bits(-(-lines // segments), 1 << 13, MOST_SEGMENT_BITS)

    def send(batches):
        digests: list[bytes] = []

        def rows():
            words, times = np.unique(_words(digests), return_counts=True)
            out = [*_by_part(0, words[times == 1], segments), *_by_part(1, words[times > 1], segments)] if len(words) else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()),
                pa.array([r[2] for r in out], pa.binary())], names=["segment", "kind", "words"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                digests += {_digest(k) for k in line_keys(text, min_chars) if k is not None}
            if len(digests) >= HELD:
                yield rows()
                digests.clear()
        yield rows()

    def pick(batches):
        at, once = None, None
        for batch in batches:
            out = []
            for segment, kind, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != at:
                    at, once = segment, np.zeros(bits, bool)
                words = np.frombuffer(words, "<u8")
                place = _positions(words, bits)
                again = once[place].all(axis=1) | (kind == 1)
                once[place] = True
                out.append(words[again])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out if len(x)], pa.binary()), pa.array([len(x) for x in out if len(x)], pa.int64())],
                names=["words", "n"])

    sent = docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(tidied(send), "segment long, kind int, words binary")
    again, path = stash(sent.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(tidied(pick), "words binary, n long"), "again")
    size = filter_bits(again.agg(F.sum("n")).first()[0] or 0)

    def set_bits(batches):
        for batch in batches:
            rows = []
            for words in batch.column(0).to_pylist():
                place = np.unique(_positions(np.frombuffer(words, "<u8"), size))
                segment = place // np.uint64(SEGMENT_BITS)
                rows += [(int(s), (chunk % np.uint64(SEGMENT_BITS)).astype("<u2").tobytes())
                    for s, chunk in zip(np.unique(segment), np.split(place, np.flatnonzero(np.diff(segment)) + 1), strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["segment", "at"])

    def merge(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.setdefault(s, np.zeros(SEGMENT_BITS, bool))[np.frombuffer(at, "<u2")] = True
        out = [(s, zlib.compress(np.packbits(t, bitorder="little").tobytes(), 1)) for s, t in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["segment", "bits"])

    merged = again.select("words").mapInArrow(tidied(set_bits), "segment long, at binary").repartition(min(size // SEGMENT_BITS, n_parts(spark)),
        "segment").mapInArrow(tidied(merge), "segment long, bits binary")
    table = bytearray(size // 8)
    for row in merged.toLocalIterator():  # at most MAX_BITS in all
        at = row["segment"] * SEGMENT_BITS // 8
        table[at : at + SEGMENT_BITS // 8] = zlib.decompress(row["bits"])
    discard(spark, path)
    return bytes(table), size


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` cleaned and with n_lines and n_dropped added."""
    spark = prepare(docs.sparkSession)
    sc = spark.sparkContext
    slim = docs.select("doc_id", "text")
    total = slim.select(F.sum(F.octet_length("text"))).first()[0] or 0
    table, bits = twice_seen(slim, min_chars, total // BYTES_PER_LINE)
    seen = sc.broadcast(zlib.compress(table, 1))
    del table
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def suspects(batches):
        table = np.frombuffer(zlib.decompress(seen.value), dtype="u1")
        for batch in batches:
            ids, owner, digests = batch.column(0), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {_digest(k) for k in line_keys(text, min_chars) if k is not None}
                digests += own
                owner += [i] * len(own)
            at = _positions(_words(digests), bits)
            hit = np.flatnonzero((table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).all(axis=1))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(owner, dtype="int64")[hit])), pa.array([digests[k] for k in hit], pa.binary())], names=["doc_id", "line"])

    found, _ = stash(slim.filter(F.col("doc_id").isNotNull()).mapInArrow(tidied(suspects), f"doc_id {id_type}, line binary"), "lines")
    # rows that share a doc_id are one document: ids are counted, not rows
    repeated = found.dropDuplicates(["line", "doc_id"]).groupBy("line").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    repeated, _ = stash(repeated, "repeated")  # written, so that the join's other side is a plain shuffle that can be split where a line is hot
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    drops = found.join(repeated, "line").filter(F.col("doc_id") < F.col("keeper")).groupBy("doc_id").agg(F.collect_set("line").alias("__drop"))
    out = docs.withColumnRenamed("doc_id", "__id").join(drops, F.col("__id") == F.col("doc_id"), "left").drop("doc_id").withColumnRenamed("__id", "doc_id")
    return _cleaned(out, docs, min_chars)


def _cleaned(joined: DataFrame, docs: DataFrame, min_chars: int) -> DataFrame:
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def clean(batches):
        for batch in batches:
            drop = batch.column(batch.schema.get_field_index("__drop")).to_pylist()
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), drop, strict=True):
                if not gone:
                    texts.append(text)
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = set(gone)
                keys, parts = line_keys(text, min_chars), text.split("\n")
                kept = [p for p, k in zip(parts, keys, strict=True) if k is None or _digest(k) not in gone]
                texts.append("\n".join(kept))
                n_lines.append(len(parts))
                n_dropped.append(len(parts) - len(kept))
            columns = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.select(*names, "__drop").mapInArrow(tidied(clean), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
rep AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS gone FROM keyed k LEFT JOIN rep r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
