"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored, tidy
from .words import LETTERED, Texts, mix, pieces, span_hashes, words

U64 = np.uint64
#: Byte classes: 0 white space and controls, 1 letters, digits and all beyond ASCII, 2 punctuation.
_KINDS = np.where(LETTERED, 1, 2).astype(np.uint8)
_KINDS[:0x21] = 0


def features(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-gram occurrences in ``texts`` and their bounds by row.

    Words (A-Z lower-cased) and punctuation runs are tokens. Of each token: the unigram, the bigram with the next,
    and the pattern of itself among the next two (whether it occurs there again). A text without tokens has one
    feature of its own.
    """
    found = words(texts, _KINDS)
    h = span_hashes(texts.buf, found.start, found.end, fold=True)
    row = found.row
    next_in = np.zeros((2, len(h)), dtype=bool)
    for k in (1, 2):
        next_in[k - 1, :-k] = row[k:] == row[:-k]
    after = np.roll(h, -1)
    same = sum(((h == np.roll(h, -k)) & next_in[k - 1]).astype(np.int64) << (k - 1) for k in (1, 2)).astype(np.uint64)
    with np.errstate(over="ignore"):
        grams = np.stack([
            mix(h + U64(1)),
            np.where(next_in[0], mix(h * U64(3) + after * U64(5)), U64(3)),
            mix(same + U64(5 << 40)),
        ], axis=1)
    empty = np.flatnonzero(found.counts == 0)
    out = (grams >> U64(64 - bits)).astype(np.int32).ravel()
    first = found.first * grams.shape[1]
    if len(empty):
        out = np.insert(out, first[empty], 0)
        first = first + np.concatenate([[0], np.cumsum(found.counts == 0)])
    return out, first


class Ftrl:
    """FTRL-proximal logistic regression; the value of a feature is its share of the text's occurrences
    times ``scale``. The bias is learned alike, without regularisation."""

    def __init__(self, bits: int = 18, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3, scale: float = 8.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2, self.scale = bits, alpha, beta, l1, l2, scale
        self.z = np.zeros(1 << bits)
        self.n = np.zeros(1 << bits)
        self.bias = self.bias_z = self.bias_n = 0.0

    def _weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self._weights(i)
        g = 1 / (1 + np.exp(-np.clip(w @ x + self.bias, -35, 35))) - y
        step = g * x
        self.z[i] += step - (np.sqrt(self.n[i] + step**2) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += step**2
        self.bias_z += g - (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / self.alpha * self.bias
        self.bias_n += g * g
        self.bias = -self.bias_z * self.alpha / (self.beta + np.sqrt(self.bias_n))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, seed: int = 7) -> "Ftrl":
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                self.learn(*examples[k])
        return self

    def model(self) -> tuple[np.ndarray, float, float, int]:
        return self._weights(np.arange(len(self.z))).astype(np.float32), self.bias, self.scale, self.bits


def score_texts(texts: Texts, model: tuple[np.ndarray, float, float, int]) -> np.ndarray:
    weights, bias, scale, bits = model
    i, first = features(texts, bits)
    margin = np.zeros(len(texts))
    total = np.concatenate([[0.0], np.cumsum(weights[i], dtype=np.float64)])
    margin = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1) * scale + bias
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, rows: int, id_col: str = "doc_id", text_col: str = "text", cost: F.Column | None = None, most: int = 0) -> DataFrame:
    """``id, text, label`` of at most ``rows`` labelled documents: those with the smallest hash of the id. With
    ``cost`` (of the column ``text``), only the first of them in that order, as far as their costs together do not exceed ``most``
    (one at least).

    ``train`` is a condition on ``id_col``. Null ids and labels are left out; of several labels of an id
    the largest counts. The ids (bounded by ``rows``) are broadcast, so that the documents aren't shuffled, and the
    sample is written to the shared folder.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))
    space = 1 << 31
    chosen = chosen.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(space)))
    # of many labels, those with a hash twice as large as the sample takes need not be sorted
    chosen = chosen.where(F.col("h") < min(space, -(-2 * rows * space // max(1, chosen.count())))).orderBy("h", "id").limit(rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    sample = stored(sample.select("id", "text", "label", "h"), "sample")
    if cost is not None:
        total = 0
        for n, r in enumerate(sample.groupBy("h", "id").agg(F.sum(cost).alias("cost")).orderBy("h", "id").collect()):  # a row for each of the sample's ids
            total += r.cost or 0
            if n and total > most:
                sample = sample.where((F.col("h") < r.h) | ((F.col("h") == r.h) & (F.col("id") < r.id)))
                break
    return sample.drop("h")


#: Bytes of features that the training task may hold: 8 for each bucket of a text, about twice its bytes.
FEATURE_BYTES = 256 << 20


@tidy
def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train=None, rows: int = 12_000, bits: int = 18, epochs: int = 3, feature_bytes: int = FEATURE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float, float, int]:
    """The model from a sample of at most ``rows`` labelled documents, with about ``feature_bytes`` of features at most. Executors make features, one task
    runs the updates over those of the sample in order of ids, and the driver gets the weights.

    Of several labels of an id the largest counts, and repeated rows of it are an example each; null ids and labels are left out. Null and empty
    texts have one feature of their own; very long ones are taken whole, with 8 bytes for each of their
    buckets (2 MB at most). Without labelled rows the model predicts 0.5. Other columns are not read.
    """
    cost = F.least(2 * F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(8 << bits)).cast("long")
    sample = labelled_sample(docs, labels, label, F.lit(True) if train is None else train, rows, id_col, text_col, cost, feature_bytes)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                i, first = features(texts, bits)
                ids, counts = [], []
                for r in range(len(texts)):
                    u, n = np.unique(i[first[r] : first[r + 1]], return_counts=True)
                    ids.append(u.astype("<i4").tobytes())
                    counts.append(n.astype("<i4").tobytes())
                part = batch.slice(texts.low, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["id", "label", "i", "n"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, examples, order = Ftrl(bits=bits), [], np.random.default_rng(7)
        for batch in batches:  # views of the batches' buffers, of which none is copied or joined with others
            labels = batch.column(1).to_pylist()
            for y, ids, counts in zip(labels, batch.column(2), batch.column(3)):
                examples.append((np.frombuffer(ids.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i4"), int(y > 0)))
        for _ in range(epochs):
            for k in order.permutation(len(examples)):
                ids, counts, y = examples[k]
                model.learn(ids, counts / counts.sum() * model.scale, y)
        weights, bias, *_ = model.model()
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([float(bias)])], names=["weights", "bias"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = sample.mapInArrow(featurise, f"id {kind}, label int, i binary, n binary").repartition(1).sortWithinPartitions("id", "i", "n", "label")
    got = made.mapInArrow(fit, "weights binary, bias double").collect()
    if not got:
        return Ftrl(bits=bits).model()
    return np.frombuffer(bytes(got[0].weights), np.float32), got[0].bias, Ftrl(bits=bits).scale, bits


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float, float, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of each row of ``docs``: the probability of label 1, from the whole text alone.

    Null and empty texts have the score of a text without tokens; very long ones are scored whole; repeated rows are each scored; an
    empty table gives no rows; other columns are not read. The broadcast model has a fixed size (2 ** bits weights).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_texts(t, shared.value) for t in pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", source: DataFrame | None = None, **training) -> DataFrame:
    """The rows of ``docs``, with the same columns, that score ``threshold`` or more. ``source`` has the
    texts of the labelled rows, where that isn't ``docs``. Null, empty and very long texts, repeated rows and empty tables: see
    ``score_quality``; a score that equals the threshold stays."""
    shared = docs.sparkSession.sparkContext.broadcast(train_quality(docs if source is None else source, labels, text_col=text_col, **training))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            parts = [score_texts(t, shared.value) for t in pieces(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *parts]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
