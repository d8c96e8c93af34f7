"""Language ID: a byte convolutional network (several filter widths, max pooling over a window, softmax), trained in numpy.

A text is cut into fixed windows of bytes, all of them, the last one padded with zeros. Every window is scored and the
text's distribution is the mean over its windows, weighted by their bytes. Null texts and texts without a letter are `und`
with score 0. Ties of languages go to the smaller name. Empty tables give empty results; where no labelled row exists,
every text is `und`. Columns of the input are kept; `lang_pred` and `score` replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh
from .words import text_bytes

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 24
#: The bound of the training sample: so many documents of each language, so many windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 250, 4
EPOCHS, BATCH, RATE = 8, 64, 0.02
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of every window, and offsets into them by text."""
    counts = -(-np.diff(offs) // WINDOW)
    to = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    return offs[text] + (np.arange(to[-1]) - to[text]) * WINDOW, to


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows as rows of folded bytes, zeros beyond end."""
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < end[:, None]
    return np.where(inside, _FOLD[data[np.minimum(at, max(0, len(data) - 1))]], 0).astype(np.uint8)


@dataclass
class Model:
    langs: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS), the filters over one-hot bytes
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @cached_property
    def pairs(self) -> list[tuple[np.ndarray, ...]]:
        """For each width, what pairs of bytes (and a last single byte) add to its filters."""
        result = []
        for f in self.filters:
            both = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(f) - 1, 2)]
            result.append((*both, f[-1]) if len(f) % 2 else tuple(both))
        return result

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        pair = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        outs = []
        for width, tables in zip(WIDTHS, self.pairs, strict=True):
            n = WINDOW - width + 1
            total = tables[0].take(pair[:, :n], 0)
            for k, t in enumerate(tables[1:], 1):
                total += t.take(pair[:, 2 * k : 2 * k + n] if t.shape[0] == 65536 else rows[:, 2 * k : 2 * k + n], 0)
            outs.append(total.max(1))
        return np.maximum(np.concatenate(outs, 1) + self.bias, 0)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str], seed: int = 7) -> Model:
    """Adam on the cross-entropy; the gradient of max pooling goes to the position that won."""
    rng = np.random.default_rng(seed)
    k = len(WIDTHS) * FILTERS
    model = Model(langs, [(rng.standard_normal((w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS], np.zeros(k, np.float32), (rng.standard_normal((k, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32))
    params = [*model.filters, model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(labels) / (len(langs) * np.maximum(1, np.bincount(labels, minlength=len(langs))))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            x, y = rows[pick].astype(np.int64), labels[pick]
            best, where = [], []
            for w, f in zip(WIDTHS, model.filters, strict=True):
                n = WINDOW - w + 1
                a = sum(f[j].take(x[:, j : j + n], 0) for j in range(w))
                i = a.argmax(1)
                where.append(i)
                best.append(np.take_along_axis(a, i[:, None, :], 1)[:, 0])
            pre = np.concatenate(best, 1) + model.bias
            h = np.maximum(pre, 0)
            z = h @ model.out + model.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z *= (weight[y] / len(y))[:, None].astype(np.float32)
            dh = (z @ model.out.T) * (pre > 0)
            grads = []
            for n_w, (w, i) in enumerate(zip(WIDTHS, where, strict=True)):
                g = np.zeros((w, 256, FILTERS), np.float32)
                d = dh[:, n_w * FILTERS : (n_w + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, i + j, 1), np.arange(FILTERS)[None, :]), d)
                grads.append(g)
            grads += [dh.sum(0), h.T @ z, z.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _windows(batches):
    """Evenly spaced windows of each text, as binary rows."""
    for b in batches:
        data, offs = text_bytes(b.column("text"))
        begin, to = windows_of(data, offs)
        ids, langs, out = [], [], []
        for i, (doc, lang) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), strict=True)):
            n = to[i + 1] - to[i]
            for k in sorted({int((j + 0.5) * n / SAMPLE_WINDOWS) for j in range(SAMPLE_WINDOWS)} if n else ()):
                at = begin[to[i] + k : to[i] + k + 1]
                ids.append(doc), langs.append(lang), out.append(cut(data, at, offs[i + 1 : i + 2]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["doc_id", "lang", "bytes"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Train on at most sample_docs labelled documents of each language, picked by a hash of doc_id; None without labels. Of rows that share
    doc_id and language the least text stands for all."""
    known = labelled(docs.select("doc_id", "lang", "text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * sample_docs / max(1, n))))])
    u = (F.xxhash64("doc_id", F.lit(11)).bitwiseAND(F.lit((1 << 32) - 1))) / F.lit(float(1 << 32))
    picked = known.filter(u < F.element_at(share, F.col("lang"))).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    picked = arrow_map(picked, _windows, "doc_id long, lang string, bytes binary").collect()
    docs_of: dict[str, dict[int, None]] = {}
    for r in sorted(picked, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["doc_id"])):
        docs_of.setdefault(r["lang"], {})[r["doc_id"]] = None
    chosen = {(lang, d) for lang, ids in docs_of.items() for d in list(ids)[:sample_docs]}
    picked = sorted((r["lang"], r["doc_id"], bytes(r["bytes"])) for r in picked if (r["lang"], r["doc_id"]) in chosen)
    if not picked:
        return None
    langs = sorted({r[0] for r in picked})
    rows = np.frombuffer(b"".join(r[2] for r in picked), np.uint8).reshape(-1, WINDOW)
    return train(rows, np.array([langs.index(r[0]) for r in picked]), langs)


def scores(model: Model, data: np.ndarray, offs: np.ndarray, block: int = 48) -> np.ndarray:
    """Mean distribution of every text over all its windows, weighted by their bytes."""
    begin, to = windows_of(data, offs)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(to))
    end = offs[text + 1]
    probs = np.zeros((len(begin), len(model.langs)), np.float32)
    for at in range(0, len(begin), block):
        probs[at : at + block] = model.probabilities(cut(data, begin[at : at + block], end[at : at + block]))
    held = np.minimum(WINDOW, end - begin)
    total = np.zeros((len(offs) - 1, len(model.langs)))
    np.add.at(total, text, probs * held[:, None])
    return total / np.maximum(1, np.diff(offs))[:, None]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    letters = fresh(docs, "_letter")
    names_in = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for b in batches:
            letter = np.array(b.column(letters).to_pylist(), bool)
            names, best = np.array([UNKNOWN] * b.num_rows, object), np.zeros(b.num_rows)
            if model is not None and b.num_rows:
                mean = scores(model, *text_bytes(b.column("text")))
                top = mean.argmax(1)
                names = np.where(letter, np.array(model.langs, object)[top], UNKNOWN)
                best = np.where(letter, np.minimum(1.0, mean[np.arange(len(top)), top]), 0.0)
            kept = [b.column(c) for c in names_in]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names.tolist(), pa.string()), pa.array(best, pa.float64())], [*names_in, "lang_pred", "score"])

    return arrow_map(docs.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))), predict, schema)
