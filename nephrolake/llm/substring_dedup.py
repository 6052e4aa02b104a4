"""Exact substring dedup by a distributed merge sort of suffixes.

A byte of a document goes if a string of ``LENGTH`` bytes that covers it also
starts in a document with a smaller id (all judged on the input).

1. Whole copies of a smaller document are found by digest; they go whole.
2. *Which suffixes.* Every window of LENGTH bytes names the start of its least
   hashed gram of ``GRAM`` bytes; equal windows name the same one, so suffixes
   at these starts, with what lies to their left, stand for all windows.
   Fingerprints of the grams are exchanged first; a suffix whose gram is in no
   other document never enters the sort.
3. *Runs.* A task sorts its suffixes (the bytes from the start on, then those
   before it, backwards), settles those that equal one of a smaller document
   in the same task, so that a common passage is sent once for a task, and sends each range of the order as one front-coded
   run: common prefix length with the one before, and the rest.
4. *Merge.* A task for each range merges the runs with a loser tree that knows
   each loser's common prefix with the last winner. Unequal prefixes decide
   without a look at the strings, equal ones are compared from there on, so
   known prefixes are never compared again. The merged order comes with its
   LCP array, which numbers the classes of equal windows at each offset; the
   smallest id of each class decides.
5. The covered spans go back to the documents and are cut.

Defined cases: a null text counts as empty; a row with a null ``doc_id`` keeps
all its bytes and counts for nothing; rows that share a doc_id never count
against each other; repeated rows are cut alike; an empty table gives no rows;
other columns are ignored. ``doc_id`` must be integral.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, n_parts, prepare, read_table, stash, tidied

LENGTH, GRAM = 50, 20
#: Entries that a task gathers before it sends them; key lists that are broadcast.
FLUSH_GRAMS, FLUSH_SUFFIXES, BROADCAST_ROWS = 4_000_000, 400_000, 500_000
SAMPLE_A_TASK, MAX_SPLITTERS = 200, 20_000

_U = np.uint64
_POSITION = _U((1 << 28) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, _U)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = eight[:n] * _U(0x9E3779B97F4A7C15)
    for at in (*range(8, GRAM - 7, 8), GRAM - 8):
        h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93) + eight[at : at + n]
    return _mix(h)


def anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) of the grams that the windows of the texts
    name; ``ends``: where each text ends in ``data``."""
    if len(data) > int(_POSITION):  # more positions than the key has room for: overlapping parts, in which each window lies whole
        step, found = int(_POSITION) - LENGTH, []
        for s in range(0, len(data), step):
            where, fp = anchors(data[s : s + step + LENGTH - 1], np.minimum(np.maximum(ends - s, 0), step + LENGTH - 1))
            found.append((where + s, fp))
        where, at = np.unique(np.concatenate([w for w, _ in found]), return_index=True)
        return where, np.concatenate([f for _, f in found])[at]
    h = gram_hashes(data)
    span = LENGTH - GRAM + 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=_U)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(h) - span + 1], least[span - width : span - width + len(h) - span + 1])
    at = np.arange(len(least))
    inside = at + LENGTH <= ends[np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)]
    named = (least[inside] & _POSITION).astype(np.int64)
    named = named[np.concatenate(([True], named[1:] != named[:-1]))] if len(named) else named
    return named, h[named]


def _joined(texts: list[bytes]):
    """Runs of texts with no more bytes than positions have bits, as (first, data, ends)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > int(_POSITION) // 8:
            yield at, b"".join(texts[at:i]), np.cumsum([len(x) for x in texts[at:i]])
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, b"".join(texts[at:]), np.cumsum([len(x) for x in texts[at:]])


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _five(fp: np.ndarray) -> np.ndarray:
    """The low 40 bits as bytes."""
    return fp.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _from_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _batch_of(kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _fingerprints(docs: DataFrame, parts: int) -> DataFrame:
    """(part, docs, tags, counts, grams) for each task and part; and, as part
    -1, a sample of where suffixes start."""
    kinds = [("part", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())]

    def send(doc, tag, fp):
        part = (fp >> _U(40)) % _U(parts)
        order = np.argsort(part, kind="stable")
        doc, tag, fp, part = doc[order], tag[order], fp[order], part[order]
        cut = np.searchsorted(part, np.arange(parts + 1))
        rows = []
        for p in range(parts):
            d, t, f = doc[cut[p] : cut[p + 1]], tag[cut[p] : cut[p + 1]], fp[cut[p] : cut[p + 1]]
            if len(d):
                first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
                ids = d[first]
                rows.append((p, _pack(np.diff(ids, prepend=0).astype("<i8")), _pack(t[first]), _pack(np.diff(np.append(first, len(d))).astype("<u4")), _five(f).tobytes()))
        return _batch_of(kinds, rows)

    def make(batches):
        held, size, rng = [], 0, np.random.default_rng(0)
        sample = []
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<u2")
            for at, data, ends in _joined([t.encode() for t in batch.column(2).to_pylist()]):
                where, fp = anchors(data, ends)
                owner = np.searchsorted(ends, where, side="right") + at
                held.append((ids[owner], tags[owner], fp))
                size += len(fp)
                for p in where[rng.integers(0, len(where), 4)] if len(where) else ():
                    sample.append(data[p : p + 8])
            if size >= FLUSH_GRAMS:
                yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))
        if sample:
            chosen = rng.permutation(len(sample))[:SAMPLE_A_TASK]
            yield _batch_of(kinds, [(-1, b"".join(sample[i] for i in chosen), None, None, None)])

    return docs.select("doc_id", "tag", "text").mapInArrow(tidied(make), "part int, docs binary, tags binary, counts binary, grams binary")


def _shared_grams(sent: DataFrame, parts: int) -> DataFrame:
    """(doc_id, tag, grams) of the fingerprints that another document has too."""
    kinds = [("doc_id", pa.int64()), ("tag", pa.int32()), ("grams", pa.binary())]

    def match(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    yield _batch_of(kinds, [(None, -1, row[0])])
                else:
                    rows.setdefault(part, []).append(row)
        for own in rows.values():
            docs, tags, grams = [], [], []
            for d, t, c, g in own:
                n = _unpack(c, "<u4")
                docs.append(np.repeat(np.cumsum(_unpack(d, "<i8")), n))
                tags.append(np.repeat(_unpack(t, "<u2"), n))
                grams.append(_from_five(g))
            own.clear()
            doc, tag, gram = np.concatenate(docs), np.concatenate(tags), np.concatenate(grams)
            order = np.argsort(gram, kind="stable")
            g, d = gram[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            hit = np.sort(order[np.repeat(several, np.diff(np.append(first, len(g))))])  # back in order of runs and documents
            doc, tag, gram = doc[hit], tag[hit], gram[hit]
            if len(hit):
                first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))))
                five = _five(gram)
                for s in range(0, len(first), 4096):
                    f = first[s : s + 4096]
                    e = np.append(f[1:], first[s + 4096] if s + 4096 < len(first) else len(doc))
                    yield _batch_of(kinds, [(int(doc[a]), int(tag[a]), five[a:z].tobytes()) for a, z in zip(f, e, strict=True)])

    return sent.repartition(parts, "part").mapInArrow(tidied(match), "doc_id long, tag int, grams binary")


def front_code(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the row before, the rest of all rows) of sorted rows of bytes."""
    differ = strings[1:] != strings[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    lcp = np.concatenate(([0], lcp)).astype(np.uint8)[: len(strings)]
    return lcp, strings[np.arange(strings.shape[1]) >= lcp[:, None]]


def front_decode(lcp: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width) >= lcp[:, None]
    out = np.zeros(own.shape, np.uint8)
    out[own] = rest
    row = np.arange(len(lcp))[:, None]
    source = np.maximum.accumulate(np.where(own, row, 0), axis=0)
    return out[source, np.arange(width)]


def _extend(a: bytes, b: bytes, h: int) -> int:
    """The common prefix of a and b, known to be h at least."""
    n = len(a)
    while h < n:
        x, y = a[h : h + 16], b[h : h + 16]
        if x != y:
            return h + (8 * len(x) - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8
        h += 16
    return n


def merge_runs(runs: list[tuple[bytes, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted runs (rows of bytes end to end, common prefixes) with a
    loser tree: (run, row in it, common prefix with the one before) in order."""
    k = 1 << max(0, len(runs) - 1).bit_length()
    data, lcps, left, at = [r[0] for r in runs], [r[1].tolist() for r in runs], [len(r[1]) for r in runs], [0] * len(runs)
    head = [d[:width] for d in data]
    # a node holds its loser and that one's common prefix with the winner; -1: a run that has ended
    loser, known = [0] * k, [0] * k

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            r = node - k
            return r, 0 if r < len(runs) and left[r] else -1
        (a, ha), (b, hb) = play(2 * node), play(2 * node + 1)
        if hb < 0 or ha < 0:
            win, lose, h = (a, b, hb) if hb < 0 else (b, a, ha)
            loser[node], known[node] = lose, -1 if min(ha, hb) < 0 else h
            return win, max(ha, hb)
        h = _extend(head[a], head[b], 0)
        win, lose = (a, b) if h == width or head[a][h] < head[b][h] else (b, a)
        loser[node], known[node] = lose, h
        return win, 0

    r, h = play(1) if k > 1 else (0, 0 if left and left[0] else -1)
    total = sum(left)
    out_run, out_row, out_lcp = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total, np.int16)
    n = 0
    while h >= 0:
        i = at[r]
        out_run[n], out_row[n], out_lcp[n] = r, i, h
        n += 1
        i += 1
        at[r] = i
        if i < left[r]:
            h = lcps[r][i]
            head[r] = data[r][i * width : i * width + width]
        else:
            h = -1
        node = (r + k) >> 1
        while node:
            other = known[node]
            if other > h:
                r, loser[node] = loser[node], r
                h, known[node] = other, h
            elif other == h and h >= 0:
                o = loser[node]
                a, b = head[r], head[o]
                c = _extend(a, b, h)
                if c < width and a[c] > b[c]:
                    loser[node], r = r, o
                known[node] = c
            node >>= 1
    return out_run[:n], out_row[:n], out_lcp[:n]


def _suffix_runs(docs: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Front-coded runs (range, lcp, rest, doc, tag, at, before, after)."""
    kinds = [("range", pa.int32()), ("lcp", pa.binary()), ("rest", pa.binary()), ("doc", pa.binary()), ("tag", pa.binary()), ("at", pa.binary()),
        ("before", pa.binary()), ("after", pa.binary())]
    shared = docs.sparkSession.sparkContext.broadcast(splitters)
    reach = LENGTH - GRAM

    def send(parts, spread):
        strings, doc, tag, at, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(np.ascontiguousarray(strings).view(f"S{LENGTH + reach}")[:, 0], kind="stable")
        strings, doc, tag, at, before, after = (x[order] for x in (strings, doc, tag, at, before, after))
        # of equal suffixes with equal surroundings only those of the smallest document are sent; the others are covered here
        lcp, _ = front_code(strings)
        new = np.concatenate(([True], (lcp[1:] < strings.shape[1]) | (before[1:] != before[:-1]) | (after[1:] != after[:-1])))
        first = np.flatnonzero(new)
        known = doc > np.minimum.reduceat(doc, first)[np.cumsum(new) - 1]
        span = known & (before.astype(np.int64) + after >= LENGTH)
        own = _by_doc(doc[span], tag[span], at[span].astype(np.int64) - before[span], at[span] + np.minimum(after[span].astype(np.int64), LENGTH))
        strings, doc, tag, at, before, after = (x[~known] for x in (strings, doc, tag, at, before, after))
        head = np.ascontiguousarray(strings[:, :8]).view(">u8")[:, 0].astype(_U)
        cut = np.searchsorted(head, shared.value, side="left")
        rows = []
        if own:
            rows.append((-1 - spread, None, None, *(_pack(np.concatenate([np.atleast_1d(r[k]) for r in own]).astype("<i8")) for k in range(4)),
                _pack(np.array([len(r[2]) for r in own], "<i8"))))
        for p, (a, z) in enumerate(zip([0, *cut], [*cut, len(head)], strict=True)):
            if a < z:
                lcp, rest = front_code(strings[a:z])
                rows.append((p, _pack(lcp), _pack(rest), doc[a:z].astype("<i8").tobytes(), tag[a:z].tobytes(), at[a:z].astype("<u4").tobytes(),
                    before[a:z].tobytes(), after[a:z].tobytes()))
        return _batch_of(kinds, rows)

    def make(batches):
        held, size = [], 0
        for batch in batches:
            ids, tags, grams = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("<u2"), batch.column(3).to_pylist()
            for first, data, ends in _joined([t.encode() for t in batch.column(2).to_pylist()]):
                where, fp = anchors(data, ends)
                owner = np.searchsorted(ends, where, side="right")
                cut = np.searchsorted(owner, np.arange(len(ends) + 1))
                low = fp & _U((1 << 40) - 1)
                keep = np.zeros(len(where), bool)
                for i in range(len(ends)):
                    a, z = cut[i], cut[i + 1]
                    if a < z:
                        keep[a:z] = np.isin(low[a:z], _from_five(b"".join(grams[first + i])))
                where, owner = where[keep], owner[keep]
                if not len(where):
                    continue
                begin = np.concatenate(([0], ends[:-1]))[owner]
                padded = np.frombuffer(b"\0" * reach + data + b"\0" * LENGTH, np.uint8)
                for s in range(0, len(where), 100_000):
                    w, o, b = where[s : s + 100_000], owner[s : s + 100_000], begin[s : s + 100_000]
                    before, after = np.minimum(w - b, reach).astype(np.uint8), np.minimum(ends[o] - w, LENGTH).astype(np.uint8)
                    strings = np.concatenate((padded[(w + reach)[:, None] + np.arange(LENGTH)], padded[(w + reach - 1)[:, None] - np.arange(reach)]), axis=1)
                    strings[:, :LENGTH][np.arange(LENGTH) >= after[:, None]] = 0
                    strings[:, LENGTH:][np.arange(reach) >= before[:, None]] = 0
                    held.append((strings, ids[first + o], tags[first + o], w - b, before, after))
                    size += len(w)
                    if size >= FLUSH_SUFFIXES:
                        yield send(held, TaskContext.get().partitionId())
                        held, size = [], 0
        if size:
            yield send(held, TaskContext.get().partitionId())

    return docs.mapInArrow(tidied(make), "range int, lcp binary, rest binary, doc binary, tag binary, at binary, before binary, after binary")


def covered(lcp: np.ndarray, strings: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """[row, d]: whether the window from d bytes before the suffix on is in a
    document with a smaller id. Rows come in the merged order with its LCPs."""
    n, reach = len(doc), LENGTH - GRAM
    left = np.ascontiguousarray(strings[:, LENGTH:])
    order = np.argsort(left.view(f"S{reach}")[:, 0], kind="stable")
    left_lcp, _ = front_code(left[order])
    out = np.zeros((n, reach + 1), bool)
    rank = np.empty(n, np.int64)
    for d in range(reach + 1):
        right = np.cumsum(lcp < LENGTH - d)
        rank[order] = np.cumsum(left_lcp < d)
        ok = np.flatnonzero((before >= d) & (after >= LENGTH - d))
        key = right[ok] * np.int64(n + 1) + rank[ok]
        by = np.argsort(key)
        k = key[by]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        if len(first):
            d_doc = doc[ok][by]
            least = np.repeat(np.minimum.reduceat(d_doc, first), np.diff(np.append(first, len(k))))
            out[ok[by], d] = least < d_doc
    return out


def _covered_spans(runs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, tag, starts, ends) of the covered spans."""
    kinds = [("doc_id", pa.int64()), ("tag", pa.int32()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
    width = 2 * LENGTH - GRAM

    def spans(own):
        coded = [(_unpack(r[0], np.uint8), _unpack(r[1], np.uint8)) for r in own]
        tables = [front_decode(c, rest, width) for c, rest in coded]
        run, row, lcp = merge_runs([(t.tobytes(), c) for t, (c, _) in zip(tables, coded, strict=True)], width)
        start = np.cumsum([0, *(len(t) for t in tables)])
        at = start[run] + row
        strings = np.concatenate(tables)[at]
        doc, tag, where, before, after = (np.concatenate([np.frombuffer(r[i], kind) for r in own])[at] for i, kind in ((2, "<i8"), (3, "<u2"), (4, "<u4"), (5, "u1"), (6, "u1")))
        # suffixes that share their gram with another document's
        group = np.cumsum(lcp < GRAM) - 1
        first = np.flatnonzero(lcp < GRAM)
        if not len(first):
            return
        keep = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))[group]
        if not keep.any():
            return
        lcp = np.where(np.concatenate(([True], group[1:] != group[:-1])), 0, lcp)[keep]  # whole groups stay, so neighbours stay
        strings, doc, tag, where, before, after = (x[keep] for x in (strings, doc, tag, where, before, after))
        hit = covered(lcp, strings, doc, before, after)
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, d0 = np.nonzero(edge == 1)
        _, d1 = np.nonzero(edge == -1)
        begin, end = where[row].astype(np.int64) - (d1 - 1), where[row].astype(np.int64) - d0 + LENGTH
        yield from told(_by_doc(doc[row], tag[row], begin, end))

    def told(found):
        for s in range(0, len(found), 4096):
            yield _batch_of(kinds, found[s : s + 4096])

    def merge(batches):
        own: dict[int, list] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(part, []).append(row)
        for part in sorted(own):
            if part >= 0:
                yield from spans(own.pop(part))
            else:
                for _, _, doc, tag, starts, ends, count, *_ in own.pop(part):
                    cut = np.concatenate(([0], np.cumsum(_unpack(count, "<i8"))))
                    begin, end = _unpack(starts, "<i8"), _unpack(ends, "<i8")
                    yield from told([(int(d), int(t), begin[a:z], end[a:z]) for d, t, a, z in zip(_unpack(doc, "<i8"), _unpack(tag, "<i8"), cut, cut[1:], strict=False)])

    return runs.repartition(ranges, "range").mapInArrow(tidied(merge), "doc_id long, tag int, starts array<long>, ends array<long>")


def _by_doc(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple]:
    """(doc, tag, starts, ends): the spans of each document, united."""
    order = np.lexsort((begin, tag, doc))
    d, t, begin, end = doc[order], tag[order], begin[order], end[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))) if len(d) else []
    return [(int(d[a]), int(t[a]), *_united(begin[a:z], end[a:z])) for a, z in zip(first, np.append(first[1:], len(d)).astype(int), strict=True)] if len(d) else []


def _united(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans given in order of their starts."""
    top = np.maximum.accumulate(end)
    new = np.concatenate(([True], begin[1:] > top[:-1]))
    return begin[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (start and end of each removed
    run), kept (binary: the remaining bytes)."""
    spark = prepare(docs.sparkSession)
    parts = n_parts(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a tag of the text keeps rows apart that share an id
    tagged = docs.withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(65536)).cast("int"))
    digests, digests_path = stash(tagged.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", "tag",
        F.unhex(F.sha2("text", 256)).alias("sha")), "digests")
    least, least_path = stash(digests.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "least")
    if least.count() <= BROADCAST_ROWS:
        least = F.broadcast(least)
    copies, copies_path = stash(digests.join(least, "sha").filter("doc_id > least").select("doc_id", "tag").distinct(), "copies")
    small = copies.count() <= BROADCAST_ROWS
    own = tagged.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).join(F.broadcast(copies) if small else copies, ["doc_id", "tag"], "left_anti")

    grams, grams_path = stash(_shared_grams(_fingerprints(own, parts), parts), "grams")
    sample = np.concatenate([np.frombuffer(r[0], ">u8") for r in grams.filter("tag = "
        "-1").select("grams").limit(MAX_SPLITTERS // SAMPLE_A_TASK).collect()] or [np.zeros(0, ">u8")]).astype(_U)
    splitters = np.unique(np.quantile(sample.astype("f8"), np.arange(1, parts) / parts).astype(_U)) if len(sample) else np.zeros(0, _U)
    by_doc = grams.filter("tag >= 0").groupBy("doc_id", "tag").agg(F.collect_list("grams").alias("grams"))
    runs = _suffix_runs(own.join(by_doc, ["doc_id", "tag"]).select("doc_id", "tag", "text", "grams"), splitters)
    found, found_path = stash(_covered_spans(runs, parts), "spans")
    discard(spark, grams_path, digests_path, least_path)

    by_doc = found.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    whole = copies.select("doc_id", "tag", F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("array<long>").alias("ends"))
    cuts, _ = stash(by_doc.unionByName(whole).withColumn("cut", F.lit(True)), "cuts")
    discard(spark, found_path, copies_path)
    keys = cuts.select("doc_id", "tag")
    small = keys.count() <= BROADCAST_ROWS
    # only documents that lose something are shuffled
    hit = tagged.join(F.broadcast(keys) if small else keys, ["doc_id", "tag"], "left_semi").join(cuts, ["doc_id", "tag"])
    rest = tagged.join(F.broadcast(keys) if small else keys, ["doc_id", "tag"], "left_anti")

    def cut(batches):
        for batch in batches:
            kept, spans = [], []
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                if starts is None:
                    kept.append(b"")
                    spans.append([{"start": 0, "end": len(data)}])
                    continue
                s, e = np.array(starts), np.array(ends)
                order = np.argsort(s, kind="stable")
                s, e = _united(s[order], e[order])
                kept.append(b"".join(data[a:z] for a, z in zip([0, *e], [*s, len(data)], strict=True)))
                spans.append([{"start": int(a), "end": int(z)} for a, z in zip(s, e, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in batch.column(1).to_pylist()], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])

    shape = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    changed = hit.select("doc_id", "text", "starts", "ends").mapInArrow(tidied(cut), shape)
    same = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"))
    return changed.unionByName(same)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
