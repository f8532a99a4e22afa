"""Language of texts by a byte convolutional network, trained and applied in numpy.

A window of WINDOW bytes goes through filters of several widths over learned byte vectors; each filter's maximum over the
window feeds a softmax over the languages. Training takes a bounded sample: at most SAMPLE texts of each language, those
with the smallest hash of their id, two stretches of each. Prediction takes all windows of every whole text (the last one
filled up with spaces), averages their logits and gives the softmax of the average.

ASCII letters are lower-cased and other ASCII bytes become spaces. Null texts and texts without a letter are `und` with
score 0; so is every text if nothing could be learned. Ties go to the first language in order. Repeated rows are learned
from and predicted one by one. An empty table gives an empty table. Only doc_id, text and lang are read, doc_id and lang
only to choose what to learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligo.llm.common import chunks, ragged, text_bytes

c = F.col

WINDOW = 256
SAMPLE = 400  # texts of a language to learn from
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
VECTOR = 12
EPOCHS = 8
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
_CHUNK = 1 << 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vectors: np.ndarray  # byte, VECTOR
    filters: dict[int, np.ndarray]  # width: (width, VECTOR, FILTERS)
    bias: np.ndarray  # of all filters
    weights: np.ndarray  # all filters, languages
    offset: np.ndarray  # languages


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, a row each, and how many each text has (none for an empty one)."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    out = np.full(int(count.sum()) * WINDOW, 32, np.uint8)
    out[ragged((np.cumsum(count) - count) * WINDOW, sizes)] = _CLASS[data]
    return out.reshape(-1, WINDOW), count


def _convolve(model: Model, rows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Each filter's maximum over the window, before bias, and where it is. Filters are tables over bytes here."""
    best, where = [], {}
    for width, filters in model.filters.items():
        size = WINDOW - width + 1
        total = (model.vectors @ filters[0]).astype(np.float32)[rows[:, :size]]
        for j in range(1, width):
            total += (model.vectors @ filters[j]).astype(np.float32)[rows[:, j:j + size]]
        where[width] = total.argmax(axis=1) if model.languages == [] else None
        best.append(total.max(axis=1))
    return np.concatenate(best, axis=1), where


def logits(model: Model, rows: np.ndarray) -> np.ndarray:
    """Per window and language, in bounded blocks of windows."""
    out = np.zeros((len(rows), len(model.languages)))
    for at in range(0, len(rows), 256):
        best, _ = _convolve(model, rows[at:at + 256])
        out[at:at + 256] = np.maximum(best + model.bias, 0) @ model.weights + model.offset
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Model:
    """Adam on the cross entropy of windows; languages weigh the same, however many windows each has."""
    rng = np.random.default_rng(seed)
    p = {"vectors": rng.normal(0, 0.5, (256, VECTOR)), "bias": np.zeros(FILTERS * len(WIDTHS)),
         "weights": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "offset": np.zeros(len(languages))}
    p |= {w: rng.normal(0, 1 / np.sqrt(w * VECTOR), (w, VECTOR, FILTERS)) for w in WIDTHS}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = (len(rows) / len(languages) / np.maximum(np.bincount(labels, minlength=len(languages)), 1))[labels]
    for _ in range(EPOCHS):
        order, loss = rng.permutation(len(rows)), 0.0
        for at in range(0, len(rows), BATCH):
            some = order[at:at + BATCH]
            g, cost = _gradient(p, rows[some], labels[some], weight[some])
            loss, step = loss + cost, step + 1
            for k in p:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        if loss / len(rows) < 1e-3:
            break
    return Model(languages, p["vectors"], {w: p[w] for w in WIDTHS}, p["bias"], p["weights"], p["offset"])


def _gradient(p: dict, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
    n = np.arange(len(rows))
    trial = Model([], p["vectors"], {w: p[w] for w in WIDTHS}, p["bias"], p["weights"], p["offset"])
    best, where = _convolve(trial, rows)
    pooled = np.maximum(best + p["bias"], 0)
    chance = softmax(pooled @ p["weights"] + p["offset"])
    cost = float(-(weight * np.log(chance[n, labels] + 1e-12)).sum())
    chance[n, labels] -= 1
    d = chance * weight[:, None] / len(rows)
    g = {"weights": pooled.T @ d, "offset": d.sum(0)}
    back = (d @ p["weights"].T) * (pooled > 0)
    g["bias"], g["vectors"] = back.sum(0), np.zeros_like(p["vectors"])
    for i, w in enumerate(WIDTHS):
        own = back[:, i * FILTERS:(i + 1) * FILTERS]
        seen = rows[n[:, None, None], where[w][:, :, None] + np.arange(w)]  # window, filter, place: the bytes at the maximum
        g[w] = np.einsum("nf,nfwd->wdf", own, p["vectors"][seen])
        np.add.at(g["vectors"], seen, own[:, :, None, None] * p[w].transpose(2, 0, 1)[None])
    return g, cost


def learn(docs: DataFrame, seed: int = 1) -> Model | None:
    """A model from ``docs`` (doc_id, text, lang), or None if they hold no labelled text with a letter."""
    size = F.char_length("text")
    some = docs.filter(c("lang").isNotNull() & c("text").rlike(r"\p{L}")).select(
        "lang", "doc_id", F.xxhash64("doc_id").alias("h"),
        F.array(*(F.substring("text", (F.floor(size * part) + 1).cast("int"), F.lit(WINDOW)) for part in (0.1, 0.6))).alias("texts"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "texts")
    found = some.withColumn("n", F.row_number().over(order)).filter(c("n") <= SAMPLE).orderBy("lang", "n").collect()
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    rows, count = windows(pa.array([t for r in found for t in r["texts"]]))
    labels = np.repeat([languages.index(r["lang"]) for r in found for _ in r["texts"]], count)
    return train(rows, labels, languages, seed)


def _predict(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", _CHUNK):
            language, score = np.full(chunk.num_rows, UNKNOWN, object), np.zeros(chunk.num_rows)
            known = chunk.column("known").to_numpy(zero_copy_only=False).astype(bool)
            if model is not None and known.any():
                rows, count = windows(chunk.column("text").filter(pa.array(known)))
                ends = np.cumsum(count)
                total = np.add.reduceat(logits(model, rows), ends - count, axis=0) / count[:, None]
                chance = softmax(total)
                language[known] = np.array(model.languages, object)[chance.argmax(1)]
                score[known] = chance.max(1)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(language, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])
    return predict


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every document. The model, some thousand numbers, goes along with the tasks."""
    known = F.coalesce(c("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", known.alias("known")).mapInArrow(
        _predict(model), "doc_id long, lang_pred string, score double")


def held_out(doc_id=None):
    """A third of the documents, by a checksum of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32((c("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
