"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

A text's pieces form a lattice. Forward Viterbi gives each position the best
score from the start, which is the exact heuristic of a backward A-star search:
complete paths leave its queue best first. No piece crosses the start of a run
of spaces or a character that is in no piece, so the lattice falls apart there
into segments whose scores add up: the best segmentation joins the segments'
best ones, and the next ones differ from it in the few segments with the
smallest loss. The forward pass runs in numpy over all distinct short segments
of a batch (with the best and the second score of every position); the search
runs on the segments that can matter to the N best, and on long ones.

Scores are integers (log probabilities times ``SCALE``), so sums are exact. A
unigram model's scores are taken as they are; a BPE model has ranks in place of
scores, and rank r counts as a probability in proportion to 1 / (r + 2).
Characters that are no piece fall back to bytes. A space is ``U+2581`` inside
pieces, and one stands before each text; a ``U+2581`` of the text itself goes
to bytes, so that decoding gives back every text.

Defined cases: a null or empty text has no pieces, score 0 and no alternatives;
rows are independent, so null or repeated ids keep one row each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, read_table, tidied

N_BEST, SCALE = 4, 1 << 16
#: Longest segment of the numpy pass, characters scored at once, segments remembered.
SHORT, CHUNK_CHARS, REMEMBER = 16, 1_000_000, 100_000
SPACE, LITERAL = "▁", "\ud800"  # a lone surrogate can't be in a text
NEVER = -(1 << 60)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


class _Table:
    """Piece numbers by the hash of their characters, in two hashed arrays."""

    BITS = 19

    def __init__(self, keys: np.ndarray) -> None:
        for salt in range(1, 200):
            self.salt = _U((2 * salt + 1) * int(_BASE) % (1 << 64))
            self.key, self.value = np.zeros((2, 1 << self.BITS), _U), np.full((2, 1 << self.BITS), -1, np.int32)
            first, second = self._slots(keys)
            _, at = np.unique(first, return_index=True)
            rest = np.setdiff1d(np.arange(len(keys)), at)
            if len(np.unique(second[rest])) == len(rest):
                for t, slots, own in ((0, first, at), (1, second, rest)):
                    self.key[t, slots[own]], self.value[t, slots[own]] = keys[own], own
                return
        raise ValueError("no arrangement of the pieces found")

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = h * self.salt
        return x >> _U(64 - self.BITS), (x ^ (h >> _U(21))) & _U((1 << self.BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        first, second = self._slots(h)
        out = np.where(self.key[0][first] == h, self.value[0][first], -1)
        other = self.key[1][second] == h
        return np.where(other & (out < 0), self.value[1][second], out)


class Lattice:
    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        raw = {i: sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        ranks = all(s <= 0 and s == int(s) for s in raw.values())
        total = log(sum(1 / (r + 2) for r in range(n)))
        score = {i: -log(min(-s, n) + 2) - total if ranks else s for i, s in raw.items()}
        pieces = sorted((sp.id_to_piece(i), i, round(SCALE * s)) for i, s in score.items())
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = min(p[2] for p in pieces) - 10 * SCALE
        self.known = {p: (i, s) for p, i, s in pieces}
        self.longest = max(len(p) for p, _, _ in pieces)
        self.plain = {c for p, _, _ in pieces for c in p}
        self.bytes_of = [b""] * n
        for p, i, _ in pieces:
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        hashes = np.zeros(len(pieces), _U)
        for k, (p, _, _) in enumerate(pieces):
            for c in p:
                hashes[k : k + 1] = hashes[k : k + 1] * _BASE + _U(ord(c) + 1)
        self.table = _Table(hashes)
        self.ids, self.scores = np.array([p[1] for p in pieces], np.int32), np.array([p[2] for p in pieces], np.int64)
        self.in_pieces = np.zeros(0x110000, bool)
        self.in_pieces[[ord(c) for c in self.plain]] = True
        self.found: dict[str, list] = {}

    # ---- one segment

    def _edges(self, s: str) -> list[list[tuple[int, tuple[int, ...], int]]]:
        """By end: (start, ids, score) of the pieces that end there."""
        out = [[] for _ in range(len(s) + 1)]
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                hit = self.known.get(s[i:j])
                if hit is not None:
                    out[j].append((i, (hit[0],), hit[1]))
            if s[i] not in self.known:
                data = (SPACE if s[i] == LITERAL else s[i]).encode()
                out[i + 1].append((i, tuple(self.byte_ids[b] for b in data), self.byte_score * len(data)))
        return out

    def search(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a segment, as (score, ids)."""
        edges, forward = self._edges(s), [0]
        for j in range(1, len(s) + 1):
            forward.append(max((forward[i] + v for i, _, v in edges[j]), default=NEVER))
        queue, out, k = [(-forward[-1], 0, len(s), 0, None)], [], 0
        while queue and len(out) < n:
            _, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for i, ids, v in edges[at]:
                k += 1
                heapq.heappush(queue, (-(forward[i] + v + done), k, i, done + v, (ids, path)))
        return out

    def best_of(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        if len(s) > 4 * SHORT:
            return self.search(s, n)
        if s not in self.found or len(self.found[s]) < n:
            if len(self.found) >= REMEMBER:
                self.found.clear()
            self.found[s] = self.search(s, n)
        return self.found[s][:n]

    # ---- many segments

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For segments of one length (rows of characters): best score, loss of
        the second, and the best path as (pieces, their number); and whether a
        row can't be told here."""
        n, size = codes.shape
        best, second = np.full((size + 1, n), NEVER, np.int64), np.full((size + 1, n), NEVER, np.int64)
        back, piece = np.zeros((size + 1, n), np.int8), np.zeros((size + 1, n), np.int32)
        best[0] = 0
        h, odd = np.zeros((size, n), _U), np.zeros(n, bool)
        for j in range(1, size + 1):
            h[:j] = h[:j] * _BASE + (codes[:, j - 1].astype(_U) + _U(1))
            hit = self.table.find(h[:j])
            odd |= hit[j - 1] < 0  # a character that is no piece itself
            value = np.where(hit >= 0, self.scores[hit], NEVER)
            path = np.maximum(best[:j] + value, NEVER)
            top = path.argmax(axis=0)
            col = np.arange(n)
            best[j], back[j], piece[j] = path[top, col], top, self.ids[hit[top, col]]
            runner = np.maximum(second[:j] + value, NEVER)
            path[top, col] = runner[top, col]
            second[j] = np.maximum(path.max(axis=0), runner.max(axis=0))
        ids, count, at = np.zeros((size, n), np.int32), np.zeros(n, np.int64), np.full(n, size)
        while (live := at > 0).any():
            ids[size - 1 - count[live], np.flatnonzero(live)] = piece[at[live], live]
            count[live] += 1
            at[live] = back[at[live], live]
        return best[size], np.where(second[size] > NEVER // 2, best[size] - second[size], -1), ids, count, odd

    def _segments(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of the segments; ``first``: where texts start."""
        space, alone = codes == ord(SPACE), ~self.in_pieces[codes]
        new = alone.copy()
        new[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
        new[first] = True
        return np.flatnonzero(new)

    def encode(self, texts: list[str | None], n_best: int = N_BEST) -> list[tuple[np.ndarray, int, list[tuple[int, np.ndarray]]]]:
        """(ids, score, alternatives as (score, ids)) of each text."""
        marked = [SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE) if t else "" for t in texts]
        text = "".join(marked)
        ends = np.cumsum([len(m) for m in marked])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(codes):
            return [(np.zeros(0, np.int32), 0, []) for _ in texts]
        firsts = np.concatenate(([0], ends[:-1]))
        start = self._segments(codes, np.unique(firsts[firsts < len(codes)]))
        size = np.diff(np.append(start, len(codes)))
        n = len(start)
        # equal segments are looked at once
        power = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(codes), _BASE))))
        inverse = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(len(codes), _INVERSE))))
        total = np.concatenate(([_U(0)], np.cumsum((codes.astype(_U) + _U(1)) * power[:-1], dtype=_U)))
        key = _mix((total[start + size] - total[start]) * inverse[start] + size.astype(_U) * _U(0xD6E8FEB86659FD93))
        _, at, same = np.unique(key, return_index=True, return_inverse=True)
        m = len(at)
        best, loss, count = np.zeros(m, np.int64), np.full(m, -1, np.int64), np.zeros(m, np.int64)
        flats: list[tuple[np.ndarray, np.ndarray]] = []  # (segments, their ids end to end)
        slow = size[at] > SHORT
        for length in range(1, SHORT + 1):
            own = np.flatnonzero(size[at] == length)
            if len(own):
                b, d, ids, c, odd = self.forward(codes[start[at[own]][:, None] + np.arange(length)])
                ok = ~odd
                best[own], loss[own], count[own] = b, d, c
                slow[own[odd]] = True
                keep = (np.arange(length)[:, None] >= length - c) & ok
                flats.append((own[ok], ids.T[keep.T]))
        by_hand, ids_of = np.flatnonzero(slow), []
        for k in by_hand:
            found = self.best_of(text[start[at[k]] : start[at[k]] + size[at[k]]], 2)
            best[k], count[k], loss[k] = found[0][0], len(found[0][1]), found[0][0] - found[1][0] if len(found) > 1 else -1
            ids_of += found[0][1]
        flats.append((by_hand, np.array(ids_of, np.int32)))
        where, flat, used = np.zeros(m, np.int64), np.concatenate([f for _, f in flats]), 0
        for own, ids in flats:
            where[own] = used + np.concatenate(([0], np.cumsum(count[own])[:-1])) if len(own) else 0
            used += len(ids)
        per = count[same]
        upto = np.concatenate(([0], np.cumsum(per)))
        ids = flat[np.repeat(where[same] - upto[:-1], per) + np.arange(upto[-1])]
        sums = np.concatenate(([0], np.cumsum(best[same])))
        cut = np.searchsorted(start, np.concatenate(([0], ends)))
        out = []
        for i in range(len(texts)):
            a, z = cut[i], cut[i + 1]
            own, score = ids[upto[a] : upto[z]], int(sums[z] - sums[a])
            out.append((own, score, self._alternatives(text, own, score, a, loss[same[a:z]], start, size, upto, n_best) if z > a else []))
        return out

    def _alternatives(self, text, ids, score, a, losses, start, size, upto, n_best):
        """The next best after the best: changes in the segments with the smallest losses."""
        can = np.flatnonzero(losses >= 0)
        if len(can) > n_best - 1:
            can = can[np.argpartition(losses[can], n_best - 2)[: n_best - 1]] if n_best > 1 else can[:0]
        mixes = [(0, ())]
        for k in sorted(can.tolist()):
            s = text[start[a + k] : start[a + k] + size[a + k]]
            found = self.best_of(s, n_best)
            mixes = heapq.nsmallest(n_best, [(d + found[0][0] - v, (*c, (k, p)) if p is not found[0][1] else c) for d, c in mixes for v, p in found], key=lambda x: x[0])
        out = []
        for d, changes in mixes[1:]:
            parts, at = [], 0
            for k, p in changes:
                parts += [ids[at : upto[a + k] - upto[a]], np.array(p, np.int32)]
                at = upto[a + k + 1] - upto[a]
            out.append((score - d, np.concatenate([*parts, ids[at:]])))
        return out

    def decode(self, ids) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data[1:].decode() if data else ""


_lattices: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def encode(docs: DataFrame, model_file: str, n_best: int = N_BEST, keep_ids: bool = False) -> DataFrame:
    """One row per row: doc_id, n_pieces, ids_crc32, score, alternatives (score
    and crc32 of the next best), restored (decoding gives the text), and ``ids``
    if asked for."""
    prepare(docs.sparkSession)
    other = pa.list_(pa.struct([("score", pa.float64()), ("ids_crc32", pa.int64())]))
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, score double, alternatives array<struct<score:double,ids_crc32:long>>, restored boolean" + ", ids array<int>" * keep_ids
    crc = lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4"))

    def run(batches):
        model = lattice(model_file)
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), []
            for group in _groups(texts):
                for text, (ids, score, more) in zip(group, model.encode(group, n_best), strict=True):
                    own = ids.tolist()
                    rows.append((len(own), crc(ids), score / SCALE, [{"score": s / SCALE, "ids_crc32": crc(x)} for s, x in more], model.decode(own) == (text or ""),
                        own if keep_ids else None))
            kinds = [pa.int64(), pa.int64(), pa.float64(), other, pa.bool_(), pa.list_(pa.int32())][: 5 + keep_ids]
            names = ["n_pieces", "ids_crc32", "score", "alternatives", "restored", "ids"][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), shape)


def _groups(texts: list):
    run, chars = [], 0
    for t in texts:
        run.append(t)
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text of its ids."""

    def run(batches):
        model = lattice(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
