"""Quality classifier: a generalised additive model with pairwise terms.

Each feature is cut into quantile bins. Cyclic boosting visits one feature at
a time and adds a shallow tree over its bins, fitted to what is left of the
log loss, so that a feature ends as a look-up table; pairs of features that
explain most of the rest get a coarser table each, boosted the same way. A
score is the sum of the look-ups through a logistic function.

Features are counts and shares over the whole text. Defined cases: a null
text counts as empty, and empty texts have a score like any other; without
labels to learn from every score is 0.5; a null ``doc_id`` carries no label;
repeated rows score alike; an empty table gives no rows; other columns pass
through.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, read_table, stash, tidied
from .language_id import held_out

FEATURES = (
    "log_words", "word_length", "letters", "upper", "digits", "symbols", "shouts", "stops", "other_bytes", "lines_a_word", "distinct_words",
    "top_word", "repeat_lines", "repeat_fives", "squeezed", "bars", "open_lines",
)
#: Labelled rows that are learnt from, at most.
MAX_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 120, 60, 0.15, 3, 1.0
THRESHOLD = 0.7

_LOWER, _UPPER = bytes(range(97, 123)), bytes(range(65, 91))
_HIGH = bytes(range(128, 256))


def features_of(text: str | None) -> tuple[float, ...]:
    data = (text or "").encode()
    n = max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / n
    words = data.split()
    k = max(1, len(words))
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    fives = [*zip(*(words[i:] for i in range(5)), strict=False)]
    upper = share(_UPPER)
    return (
        float(np.log1p(len(words))), sum(map(len, words)) / k, share(_LOWER) + upper, upper, share(b"0123456789"), share(b"#*$%&|<>"), share(b"!?"), share(b".,;:"),
        share(_HIGH), len(lines) / k, len(count) / k,
        max(count.values(), default=0) / k, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(fives)) / max(1, len(fives)) if fives else 0.0,
        len(zlib.compress(data, 1)) / n, share(b"|"), sum(x.rstrip()[-1:] not in b".!?:" for x in lines) / max(1, len(lines)),
    )


@dataclass
class Additive:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with LEAVES leaves on the bins' gradient sums."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    while len(parts) < LEAVES:
        best = None
        for a, z in parts:
            cut = np.arange(a + 1, z)
            if len(cut):
                gain = _gain(cg[cut] - cg[a], ch[cut] - ch[a]) + _gain(cg[z] - cg[cut], ch[z] - ch[cut]) - _gain(cg[z] - cg[a], ch[z] - ch[a])
                at = int(gain.argmax())
                if best is None or gain[at] > best[0]:
                    best = (gain[at], a, int(cut[at]), z)
        if best is None or best[0] <= 1e-9:
            break
        parts.remove((best[1], best[3]))
        parts += [(best[1], best[2]), (best[2], best[3])]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the values of the best tree of one cut in each direction."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    best, out = 0.0, np.zeros_like(g)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            cells = [(slice(0, a), slice(0, b), cg[a, b], ch[a, b]), (slice(a, None), slice(0, b), cg[-1, b] - cg[a, b], ch[-1, b] - ch[a, b]),
                     (slice(0, a), slice(b, None), cg[a, -1] - cg[a, b], ch[a, -1] - ch[a, b]),
                     (slice(a, None), slice(b, None), cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b])]
            gain = sum(_gain(c[2], c[3]) for c in cells)
            if gain > best:
                best, out = gain, np.zeros_like(g)
                for r, c, gs, hs in cells:
                    out[r, c] = gs / (hs + RIDGE)
    return best, out


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    p = np.clip(y.mean(), 0.01, 0.99)
    model = Additive(float(np.log(p / (1 - p))), [_edges(c, BINS) for c in x.T], [])
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            prob = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(b, y - prob, len(t)), np.bincount(b, prob * (1 - prob), len(t)))
            t += step
            z += step[b]
    model.pair_edges = [_edges(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
    wide = [len(e) + 1 for e in model.pair_edges]
    flat = lambda i, j: coarse[i] * wide[j] + coarse[j]
    grid = lambda v, i, j: np.bincount(flat(i, j), v, wide[i] * wide[j]).reshape(wide[i], wide[j])
    prob = 1 / (1 + np.exp(-z))
    gains = sorted(((_quadrants(grid(y - prob, i, j), grid(prob * (1 - prob), i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            prob = 1 / (1 + np.exp(-z))
            step = RATE * _quadrants(grid(y - prob, i, j), grid(prob * (1 - prob), i, j))[1]
            t += step
            z += step[coarse[i], coarse[j]]
    return model


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with ``features`` in place of ``text``."""
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "features")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def count(batches):
        for batch in batches:
            found = [features_of(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "features"])

    return docs.select(*names, "text").mapInArrow(tidied(count), schema)


def fit(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Additive | None:
    """Learn from the rows with a label 0 or 1; beyond ``max_rows`` of them,
    those whose hashed ids come first."""
    order = F.xxhash64("doc_id")
    marks = labels.select("doc_id", F.col("quality").alias("__y")).filter(F.col("__y").isin(0, 1))
    share, picked = (2.0 * max_rows + 50) / max(1, marks.count()), None
    while True:
        # first the rows that can be in the sample, by the share of the order's range, then exactly
        near = (order.cast("double") / 2.0**63).between(-1.0, -1.0 + 2.0 * min(1.0, share))
        rows = measured.select("doc_id", "features").filter(near).join(marks.filter(near), "doc_id")
        picked = rows.orderBy(order, "doc_id", "features").limit(max_rows).select("features", "__y").toPandas()
        if len(picked) >= max_rows or share >= 1:
            break
        share *= 8  # labels of documents that are not there
    if len(picked) == 0:
        return None
    return train(np.array(picked["features"].tolist()), picked["__y"].to_numpy(float))


def score(measured: DataFrame, model: Additive | None) -> DataFrame:
    names = [c for c in measured.columns if c not in ("features", "score", "predicted")]
    schema = T.StructType([measured.schema[c] for c in names] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def add(batches):
        for batch in batches:
            x = np.array(batch.column(batch.schema.get_field_index("features")).to_pylist(), float).reshape(-1, len(FEATURES))
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(s), pa.array((s >= THRESHOLD).astype("i4"))],
                names=[*names, "score", "predicted"])

    return measured.select(*names, "features").mapInArrow(tidied(add), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured, _ = stash(measure(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "features")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(4, 2))
    out = score(measured, fit(measured, labels))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
