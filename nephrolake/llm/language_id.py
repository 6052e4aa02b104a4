"""Language identification by a byte convolutional network.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows,
max pooling keeps each filter's strongest answer, and a softmax layer names
the language. The network is trained in numpy on a bounded sample of labelled
documents and applied to all windows of every whole text; a document's answer
is the mean of its windows' probabilities, weighted by their bytes.

Defined cases: a text that is null or holds no letter is ``und`` with score
0.0; with no labelled rows to learn from every document is ``und``; rows are
independent, so null or repeated ids keep one row each; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, read_table, tidied

#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The sample that is learnt from: documents of a language, windows of one.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 1200, 3
EPOCHS, BATCH, RATE = 3, 64, 0.004
#: Windows that are scored at once.
CHUNK = 512
WORDLIKE = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # by width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam over minibatches. Through max pooling a gradient reaches only the
    bytes under each filter's strongest position."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS
    params = [rng.normal(0, 0.3, (w, 256, f)).astype("f4") for w in WIDTHS] + [np.zeros(f * len(WIDTHS), "f4"),
        rng.normal(0, 0.1, (f * len(WIDTHS), k)).astype("f4"), np.zeros(k, "f4")]
    for p in params[: len(WIDTHS)]:
        p[:, 0] = 0  # padding says nothing
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = 1 / np.maximum(np.bincount(y, minlength=k), 1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            xb, yb, n = x[rows], y[rows], len(rows)
            pooled, best = [], []
            for w, p in zip(WIDTHS, params, strict=False):
                z = sum(p[j][xb[:, j : WINDOW - w + 1 + j]] for j in range(w))
                top = z.argmax(axis=1)
                best.append(top)
                pooled.append(np.take_along_axis(z, top[:, None], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + params[-3]
            h = np.maximum(z, 0)
            d = _softmax(h @ params[-2] + params[-1])
            d[np.arange(n), yb] -= 1
            d *= (weight[yb] * len(y) / k / n)[:, None].astype("f4")
            grads = [np.zeros_like(p) for p in params]
            grads[-1], grads[-2] = d.sum(0), h.T @ d
            dz = (d @ params[-2].T) * (z > 0)
            grads[-3] = dz.sum(0)
            for i, w in enumerate(WIDTHS):
                part, cols = dz[:, i * f : (i + 1) * f], np.arange(f)[None, :].repeat(n, 0)
                for j in range(w):
                    under = np.take_along_axis(xb, best[i] + j, axis=1)
                    np.add.at(grads[i][j], (under, cols), part)
                grads[i][:, 0] = 0
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


class Scorer:
    """A network with the filters of neighbouring bytes summed into tables of
    byte pairs, so that a filter of width w takes about w / 2 look-ups."""

    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, []
        for p in net.filters:
            pairs = [(p[j][:, None] + p[j + 1][None, :]).reshape(65536, -1) for j in range(0, len(p) - 1, 2)]
            self.tables.append((len(p), pairs, p[-1] if len(p) % 2 else None))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.languages)), "f4")
        for at in range(0, len(x), CHUNK):
            xb = x[at : at + CHUNK]
            pair = (xb[:, :-1].astype(np.uint16) << 8) | xb[:, 1:]
            pooled = []
            for w, tables, last in self.tables:
                n = WINDOW - w + 1
                z = tables[0].take(pair[:, :n], axis=0)
                for i, t in enumerate(tables[1:], 1):
                    z += t.take(pair[:, 2 * i : 2 * i + n], axis=0)
                if last is not None:
                    z += last.take(xb[:, w - 1 : w - 1 + n], axis=0)
                pooled.append(z.max(axis=1))
            h = np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0)
            out[at : at + CHUNK] = _softmax(h @ self.net.out + self.net.out_bias)
        return out


def has_letter(text: str) -> bool:
    """Word characters that are no digits hold letters, and a few numerals."""
    return any(m.group().isalpha() for m in WORDLIKE.finditer(text))


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Network | None:
    """Learn from (text, lang) rows; ``__order`` decides which rows a language
    gives when it has more than ``docs_per_language``."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # first the rows that can be in the sample, by the share of the order's range, then exactly
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (2.0 * docs_per_language + 50) / n))))
    near = rows.filter((F.col("__order").cast("double") / 2.0**63).between(-1.0, -1.0 + 2.0 * share[F.col("lang")]))
    window = Window.partitionBy("lang").orderBy("__order", "windows")
    sample = near.select("lang", "__order", "text").mapInArrow(tidied(_sampled), "lang string, __order long, windows binary")  # texts stay where they are
    picked = sample.withColumn("__n", F.row_number().over(window)).filter(F.col("__n") <= docs_per_language).select("lang", "__n", "windows").toPandas()
    languages = sorted(counts)
    x, y = [], []
    for lang, _, data in sorted(picked.itertuples(index=False, name=None)):
        some = np.frombuffer(data, np.uint8).reshape(-1, WINDOW)
        x.append(some)
        y += [languages.index(lang)] * len(some)
    if not y:
        return None
    return train(np.concatenate(x), np.array(y), languages)


def _sampled(batches):
    """The windows of a text that are learnt from, none if it holds no letter."""
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            all_windows = windows_of(text.encode()) if has_letter(text) else np.zeros((0, WINDOW), np.uint8)
            at = np.unique(np.linspace(0, max(0, len(all_windows) - 1), WINDOWS_PER_DOC).round().astype(int))[: len(all_windows)]
            out.append(all_windows[at].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["lang", "__order", "windows"])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with lang_pred and score added."""
    spark = prepare(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(net)  # its size does not follow the data

    def score(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            langs, scores = [], []
            for group in _groups(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                datas = [t.encode() if scorer is not None and t and has_letter(t) else None for t in group]
                views = [windows_of(d) for d in datas if d is not None]
                probs = scorer.probabilities(np.concatenate(views)) if views else None
                at = 0
                for d in datas:
                    if d is None:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    n = -(-len(d) // WINDOW)
                    weight = np.full(n, float(WINDOW))
                    weight[-1] = len(d) - WINDOW * (n - 1)
                    mean = (probs[at : at + n] * weight[:, None]).sum(axis=0) / weight.sum()
                    at += n
                    langs.append(shared.value.languages[int(mean.argmax())])
                    scores.append(float(min(1.0, mean.max())))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(tidied(score), schema)


def _groups(texts: list, chars: int = 2_000_000):
    """Texts in runs of about so many characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def held_out(mod: int, rest: int):
    """Whether crc32 of the doc_id as text leaves this rest (a null id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit_on_documents(docs: DataFrame) -> Network | None:
    return fit(docs.filter(~held_out(5, 0)).select("text", "lang", F.xxhash64("doc_id").alias("__order")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit_on_documents(docs))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
