"""Language identification by a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes (neighbours overlap by the
widest filter less one byte, so no byte sequence is missed).  Filters of
several widths run over the bytes, each keeps its highest response in the
window, and a softmax layer turns these into log probabilities; a document's
are the mean over its windows, weighted by their bytes.

A filter of width ``w`` over one-hot bytes is a sum of ``w`` table rows, so the
first layer is a look-up; tables of two neighbouring bytes are added up once
per worker.  Training takes a bounded sample: at most ``MAX_DOCS`` labelled
documents, the same number for each language, picked by a hash of the id, and
``WINDOWS_PER_DOC`` windows spread over each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import small

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16               # per width
MAX_DOCS = 4000            # labelled documents in training
WINDOWS_PER_DOC = 8
EPOCHS, BATCH, RATE = 4, 256, 0.01
OVERLAP = max(WIDTHS) - 1
UNKNOWN = "und"


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, zero-padded, and the bytes that each adds."""
    step = WINDOW - OVERLAP
    n = max(1, -(-max(0, len(text) - OVERLAP) // step))
    raw = np.zeros((n - 1) * step + WINDOW, np.uint8)
    raw[:len(text)] = np.frombuffer(text, np.uint8)
    weight = np.full(n, step, np.int64)
    weight[-1] = max(1, len(text) - (n - 1) * step)
    return np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[::step], weight


def has_letter(text: str) -> bool:
    """Whether any character is a letter."""
    return any(map(str.isalpha, text))


class ByteConvNet:
    """Filters, their bias, and a softmax layer; ``labels`` in code-point order."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.weight = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def responses(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Responses of the filters of the k-th width at each place, before the bias."""
        places = WINDOW - WIDTHS[k] + 1
        out = self.tables[k][0][rows[:, :places]]
        for j in range(1, WIDTHS[k]):
            out += self.tables[k][j][rows[:, j:j + places]]
        return out

    def train(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam on the cross entropy; only the place of a filter's highest response gets its gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.weight, self.shift]
        mean = [np.zeros_like(p) for p in params]
        var = [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                x, n = rows[pick], len(pick)
                found, best = [], []
                for k in range(len(WIDTHS)):
                    r = self.responses(x, k)
                    at = r.argmax(axis=1)
                    best.append(at)
                    found.append(np.take_along_axis(r, at[:, None], 1)[:, 0] + self.bias[k])
                pooled = np.concatenate(found, axis=1)
                active = np.maximum(pooled, 0)
                logits = active @ self.weight + self.shift
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), target[pick]] -= 1
                p /= n
                back = (p @ self.weight.T) * (pooled > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = back[:, k * FILTERS:(k + 1) * FILTERS]
                    table = np.zeros_like(self.tables[k])
                    for j in range(w):
                        byte = np.take_along_axis(x, best[k] + j, 1)
                        np.add.at(table[j], (byte, np.arange(FILTERS)[None, :]), g)
                    grads.append(table)
                grads += [back.sum(axis=0).reshape(self.bias.shape), active.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, v in zip(params, grads, mean, var):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)

    def pairs(self) -> list:
        """Per width, the tables of neighbouring byte pairs (the last may be of one byte)."""
        out = []
        for k, w in enumerate(WIDTHS):
            t = self.tables[k]
            parts = [(t[j][:, None] + t[j + 1][None]).reshape(65536, FILTERS) for j in range(0, w - 1, 2)]
            out.append((parts, t[w - 1] if w % 2 else None))
        return out

    def log_probabilities(self, rows: np.ndarray, pairs: list | None = None) -> np.ndarray:
        """Log probability of each label for each window."""
        pairs = pairs or self.pairs()
        out = np.empty((len(rows), len(self.labels)), np.float32)
        for i in range(0, len(rows), 64):
            x = rows[i:i + 64]
            two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
            pooled = []
            for k, (parts, one) in enumerate(pairs):
                places = WINDOW - WIDTHS[k] + 1
                r = parts[0].take(two[:, :places], axis=0)
                for j, part in enumerate(parts[1:], 1):
                    r += part.take(two[:, 2 * j:2 * j + places], axis=0)
                if one is not None:
                    r += one.take(x[:, WIDTHS[k] - 1:WIDTHS[k] - 1 + places], axis=0)
                pooled.append(r.max(axis=1) + self.bias[k])
            logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.weight + self.shift
            logits -= logits.max(axis=1, keepdims=True)
            out[i:i + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def training_windows(docs: DataFrame, id_col: str, text_col: str, label_col: str, max_docs: int) -> tuple:
    """(rows, labels) of at most ``max_docs * WINDOWS_PER_DOC`` windows, balanced over the labels."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                           F.col(label_col).cast("string").alias("name")) \
        .where("name IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy(F.col("name").alias("label")).count()
    n_labels = counts.count()
    if not n_labels:
        return np.zeros((0, WINDOW), np.uint8), []
    share = F.lit(max_docs // n_labels + 1) / F.col("count")
    unit = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = labelled.join(small(counts), F.col("name") == F.col("label")).where(unit < share) \
        .select(F.col("text").cast("binary").alias("text"), "label")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, label = [], []
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, _ = windows(text)
                for i in np.unique(np.linspace(0, len(rows) - 1, WINDOWS_PER_DOC).astype(int)).tolist():
                    raw.append(rows[i].tobytes())
                    label.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(label, pa.string())],
                                             names=["row", "label"])

    # equal texts add nothing; the order makes the run repeatable
    found = picked.mapInArrow(cut, "row binary, label string").groupBy("row").agg(F.min("label").alias("label")) \
        .orderBy(F.xxhash64("row")).limit(max_docs * WINDOWS_PER_DOC).toPandas()
    rows = np.frombuffer(b"".join(bytes(x) for x in found["row"]), np.uint8).reshape(-1, WINDOW)
    return rows, found["label"].tolist()


def train_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                      max_docs: int = MAX_DOCS, epochs: int = EPOCHS) -> ByteConvNet | None:
    """A network for the labels of ``docs``; None if no row has a text and a label."""
    rows, labels = training_windows(docs, id_col, text_col, label_col, max_docs)
    if not len(rows):
        return None
    names = sorted(set(labels))
    net = ByteConvNet(names)
    place = {n: i for i, n in enumerate(names)}
    net.train(rows, np.array([place[x] for x in labels]), epochs)
    return net


def predict_language(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing could be learned.  The whole text is read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)      # a few hundred KB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pairs = model.pairs() if model else None
        for batch in batches:
            label, score = [], []
            for text in batch.column(1).to_pylist():
                if model is None or text is None or not has_letter(text):
                    label.append(UNKNOWN)
                    score.append(0.0)
                    continue
                rows, weight = windows(text.encode("utf-8", "replace"))
                mean = np.zeros(len(model.labels))
                for i in range(0, len(rows), 4096):
                    mean += weight[i:i + 4096] @ model.log_probabilities(rows[i:i + 4096], pairs).astype(np.float64)
                mean /= weight.sum()
                p = np.exp(mean - mean.max())
                best = int(p.argmax())
                label.append(model.labels[best])
                score.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())],
                names=["id", "lang_pred", "score"])

    schema = f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
