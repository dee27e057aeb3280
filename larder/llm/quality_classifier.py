"""Document quality by logistic regression on hashed word n-grams, trained by FTRL-proximal.

A text is read whole.  Its words (no space, tab, LF, VT, FF or CR in them) give
single words and pairs of neighbours, once by their letters (A-Z lower-cased)
and once by their form: which character classes follow one another, and
whether the word repeats its predecessor, so that words never seen in training still
count.  Each n-gram is hashed to one of ``2 ** BITS`` weights and valued by the
logarithm of one plus its count; a text's values have length one, and its score is the
logistic function of their dot product with the weights.

The regression sees at most ``max_docs`` labelled documents, chosen by a hash
of the id (a bounded sample, about 10 KB each); everything is scored.  Follow-the-regularised-leader
keeps two sums per weight and gets the weight from them when it is used, so
n-grams that never matter stay at zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import slices, small

BITS = 18
MAX_DOCS = 6000            # labelled documents in training
UPDATES = 24_000           # examples shown in training, in whole rounds over the sample
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.0005
CACHE = 150_000            # words whose hashes a worker remembers
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_PAIR, _FORM, _FORM_PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x27BB2EE687B0B0FD)
_REPEAT = np.uint64(0x2545F4914F6CDD1D)
# one class for each byte: upper case, lower case (bytes of other scripts too), digit; other signs are their own class
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
               for b in range(256))


def word_form(word: bytes) -> bytes:
    """Character classes in order, each run written once."""
    out = bytearray()
    for b in word.translate(_CLASS):
        if not out or out[-1] != b:
            out.append(b)
    return bytes(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


class Features:
    """Hashed n-gram values of texts; word hashes are remembered up to a bound."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct places, their values); both empty without words."""
        words = (text or b"").split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.lower()), xxhash.xxh64_intdigest(word_form(w))
        both = np.array([known[w] for w in words], np.uint64)
        letters, form = both[:, 0], both[:, 1].copy()
        form[1:][letters[1:] == letters[:-1]] = _REPEAT
        grams = np.concatenate([_mix(letters), _mix(letters[:-1] * _M1 + letters[1:] + _WORD_PAIR),
                                _mix(form + _FORM), _mix(form[:-1] * _M1 + form[1:] + _FORM_PAIR)])
        place, count = np.unique(grams >> np.uint64(64 - self.bits), return_counts=True)
        value = np.log1p(count)
        return place.astype(np.int32), (value / math.sqrt(value @ value)).astype(np.float32)


class FtrlRegression:
    """Logistic regression by per-coordinate follow-the-regularised-leader; the last place is the constant."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, place=slice(None)) -> np.ndarray:
        z, n = self.z[place], self.n[place]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, place: np.ndarray, value: np.ndarray, label: int) -> float:
        """One example; the probability of label 1 before it was learned."""
        place = np.append(place, 1 << self.bits)
        value = np.append(value.astype(np.float64), 1.0)
        w = self.weights(place)
        p = float(logistic(w @ value))
        g = (p - label) * value
        n = self.n[place]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[place] += g - sigma * w
        self.n[place] = n + g * g
        return p

    def train(self, examples: list[tuple[np.ndarray, np.ndarray, int]], updates: int = UPDATES, seed: int = 13) -> None:
        """Rounds over the examples in random order until ``updates`` of them were learned."""
        rng = np.random.default_rng(seed)
        for _ in range(-(-updates // max(1, len(examples)))):
            for i in rng.permutation(len(examples)).tolist():
                self.update(*examples[i])


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def training_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                      max_docs: int, bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and label of about ``max_docs`` labelled documents at most, in an order set by their ids."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(F.col(id_col).cast("string").alias("key")) \
        .agg((F.avg((F.col(label_col) == 1).cast("int")) >= 0.5).cast("int").alias("label"))
    share = max_docs / max(marked.count(), 1)
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = small(marked.where(unit < share), 2 * max_docs)        # the sample's own size, whatever the labels'
    source = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("binary").alias("text")) \
        .join(picked, "key").select("key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in slices(batches):
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([p.tobytes() for p, _ in found], pa.binary()),
                 pa.array([v.tobytes() for _, v in found], pa.binary())], names=["key", "label", "place", "value"])

    rows = source.mapInArrow(run, "key string, label int, place binary, value binary").collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(r["key"]), r["key"], bytes(r["place"]), bytes(r["value"])))
    return [(np.frombuffer(r["place"], np.int32), np.frombuffer(r["value"], np.float32), r["label"]) for r in rows]


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", max_docs: int = MAX_DOCS, updates: int = UPDATES,
                  bits: int = BITS) -> FtrlRegression:
    """A regression for ``labels.label_col = 1`` on the documents that have a label.

    Rows of ``labels`` with a null id or label teach nothing; of several labels
    of one id the majority counts (1 on a tie).  Repeated documents are repeated
    examples.  Without any example every score is one half.
    """
    model = FtrlRegression(bits)
    model.train(training_examples(docs, labels, id_col, text_col, label_col, max_docs, bits), updates)
    return model


def score_quality(docs: DataFrame, model: FtrlRegression, text_col: str = "text",
                  score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1 (0 to 1), as last column.

    Each row is scored by itself: repeated rows get equal scores, a null, empty
    or blank text the score of the constant alone.  A column that is called ``score_col``
    before is replaced.  Whole texts are read, a batch of a few megabytes at a time.
    """
    kept = [c for c in docs.columns if c != score_col]
    plain = docs.select(*kept).toDF(*[f"c{i}" for i in range(len(kept))])
    source = plain.withColumn("text", F.col(f"c{kept.index(text_col)}").cast("binary"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights(), model.bits))   # 2 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bits = shared.value
        features = Features(bits)
        for batch in slices(batches):
            score = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                place, value = features(t)
                score.append(float(logistic(weights[place] @ value + weights[-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())],
                                             names=[*batch.schema.names[:-1], "score"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema).toDF(*kept, score_col)


def held_out(key: Column, folds: int) -> Column:
    """True where the CRC-32 of the id as text is a multiple of ``folds``; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))
