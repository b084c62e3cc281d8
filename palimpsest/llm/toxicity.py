"""Toxicity: votes of the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import labelled_sample
from .runtime import tidy
from .words import LETTERED, Texts, pieces, span_hashes, words


#: Beginnings of words, in bytes, that are terms besides the whole words: they tie inflected forms together.
PREFIXES = (4, 5, 6, 7, 8, 10)


def term_counts(texts: Texts, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of the distinct terms of each text, by row and term: hashes of words (A-Z
    lower-cased) and of beginnings of longer words, or places in the sorted ``vocabulary``, where others
    are left out."""
    found = words(texts, LETTERED)
    row = found.row
    maybe = np.ones(1 << 16, bool)
    if vocabulary is not None:
        maybe[:] = False
        maybe[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
    hs, rs = [], []
    for length in (None, *PREFIXES):
        longer = slice(None) if length is None else np.flatnonzero(found.end - found.start > length)
        start = found.start[longer]
        h = span_hashes(texts.buf, start, found.end if length is None else start + length, fold=True) ^ np.uint64(0 if length is None else length * 0x9E3779B1)
        here = np.flatnonzero(maybe[(h >> np.uint64(48)).astype(np.int64)])
        hs.append(h[here])
        rs.append(row[longer][here])
    h, row = np.concatenate(hs), np.concatenate(rs)
    if vocabulary is not None:
        if not len(vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        key, n = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
        return key // len(vocabulary), key % len(vocabulary), n
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.concatenate([first, [len(h)]]))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges from ``low`` to ``high``, one after another, and the range that each is in."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (low - np.concatenate([[0], np.cumsum(n)[:-1]]))[of], of


class NearestExamples:
    """Labelled examples behind a block-max inverted index.

    ``vocabulary`` has sorted terms, of which ``df`` is the document frequency; ``rows``, ``columns`` and
    ``counts`` tell how often example ``rows[i]`` has term ``columns[i]``. Vectors are (1 + log tf) * idf, of
    length 1. Examples are sorted by vector, so that a block of ``block`` holds alike ones. Postings lie by term and
    example; an entry is a term's run of postings within a block, with the largest weight in it. The blocks with the highest bounds are scored first; of the others, those whose
    bound reaches the k-th best cosine: the answer is exact. All is in proportion to the postings, whatever the number of terms.
    A text without a vocabulary term is answered by the examples without one.
    """

    def __init__(self, vocabulary: np.ndarray, df: np.ndarray, rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, labels: np.ndarray, ids: list, k: int = 25, block: int = 64, prior: float = 1.0):
        self.k, self.prior_weight = k, prior
        n, positive = len(labels), int(labels.sum())
        self.vocabulary = vocabulary
        self.idf = np.log((1 + n) / (1 + df)) + 1
        weights = self._weigh(columns, counts)
        norm = np.sqrt(np.bincount(rows, weights=weights**2, minlength=n))
        weights = weights / norm[rows]
        empty = norm == 0
        self.base = float((labels[empty].sum() + 0.5) / (empty.sum() + 1.0))
        self.rate = float((positive + 0.5) / (n + 1.0))
        # alike vectors side by side: by their heaviest term, then its weight
        top = np.full(n, -1)
        order = np.lexsort((weights, rows))
        top[rows[order]] = columns[order]
        best = np.zeros(n)
        best[rows[order]] = weights[order]
        sort = np.lexsort((best, top))
        sort = sort[~empty[sort]]
        place = np.full(n, -1)
        place[sort] = np.arange(len(sort))
        self.labels, self.ids = labels[sort].astype(float), [ids[i] for i in sort]
        self.block, self.blocks = block, -(-len(sort) // block)
        order = np.lexsort((place[rows], columns))
        self.posting_example, self.posting_weight = place[rows][order].astype(np.int32), weights[order]
        key = columns[order] * (self.blocks + 1) + self.posting_example // block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.entry_first = np.concatenate([first, [len(key)]])
        self.entry_block = (key[first] % (self.blocks + 1)).astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.posting_weight, first) * (1 + 1e-9) if len(first) else np.zeros(0)
        self.term_first = np.searchsorted(key[first] // (self.blocks + 1), np.arange(len(vocabulary) + 1))
        self.first_blocks = max(1, 2 * k // block + 2)
        self.steps = (np.zeros(0), np.zeros(0))
        self._calibrate(rows, columns, weights, place, n, labels)

    def _weigh(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (1 + np.log(counts)) * self.idf[columns]

    def nearest(self, columns: np.ndarray, weights: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the ``k`` nearest with a cosine above 0 (``but`` is left out); of equal
        cosines, the earlier examples. ``weights`` have length 1."""
        entries, of = _ranges(self.term_first[columns], self.term_first[columns + 1])
        mine, block = weights[of], self.entry_block[entries]
        bound = np.bincount(block, weights=self.entry_max[entries] * mine, minlength=self.blocks)
        some = min(self.first_blocks, len(bound))
        best = np.zeros(len(bound), bool)
        if some:
            best[np.argpartition(-bound, some - 1)[:some]] = True
        found, cosines = self._scored(entries, mine, best[block], but)
        # what the best blocks hold sets the mark that the bound of any other has to reach
        mark = np.partition(cosines, -self.k)[-self.k] if len(cosines) >= self.k else 0.0
        open_ = (bound * (1 + 1e-9) >= max(mark, 1e-12)) & ~best
        if open_.any():
            more, their = self._scored(entries, mine, open_[block], but)
            found, cosines = np.concatenate([found, more]), np.concatenate([cosines, their])
        if len(found) > self.k:
            reach = cosines >= np.partition(cosines, -self.k)[-self.k] - 1e-12
            found, cosines = found[reach], cosines[reach]
        order = np.lexsort((found, -np.round(cosines, 12)))[: self.k]
        return found[order], cosines[order]

    def _scored(self, entries: np.ndarray, weights: np.ndarray, chosen: np.ndarray, but: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples with a cosine above 0, from the postings of the ``chosen`` entries."""
        entries, weights = entries[chosen], weights[chosen]
        at, of = _ranges(self.entry_first[entries], self.entry_first[entries + 1])
        score = np.bincount(self.posting_example[at], weights=self.posting_weight[at] * weights[of])
        hit = np.flatnonzero(score > 0)
        hit = hit[hit != but]
        return hit, score[hit]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1, each example weighted by the inverse of its distance, with the overall rate
        as one more voice at distance 1."""
        weight = 1 / (0.05 + np.sqrt(np.maximum(0, 2 - 2 * cosines)))
        return float((weight @ self.labels[found] + self.prior_weight * self.rate) / (weight.sum() + self.prior_weight))

    def _calibrate(self, rows, columns, weights, place, n, labels) -> None:
        """An increasing step function from votes to frequencies, by pooling neighbours, from the examples'
        votes on each other (each left out of its own)."""
        order = np.argsort(rows, kind="stable")
        rows, columns, weights = rows[order], columns[order], weights[order]
        first = np.searchsorted(rows, np.arange(n + 1))
        votes, truth, seen = [], [], {}
        for r in np.flatnonzero(np.diff(first)):
            a, b = first[r], first[r + 1]
            votes.append(self.vote(*self.nearest(columns[a:b], weights[a:b], int(place[r]))))
            truth.append(float(labels[r]))
        if not votes:
            return
        votes, truth = np.array(votes), np.array(truth)
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # mean, weight, smallest vote
        for v, y in zip(votes[order].tolist(), truth[order].tolist()):
            pools.append([y, 1.0, v])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                y1, w1, _ = pools.pop()
                pools[-1][0] = (pools[-1][0] * pools[-1][1] + y1 * w1) / (pools[-1][1] + w1)
                pools[-1][1] += w1
        mean = np.array([(y * w + 2 * self.rate) / (w + 2) for y, w, _ in pools])
        self.steps = (np.array([v for *_, v in pools]), np.maximum.accumulate(mean))

    def calibrated(self, vote: float) -> float:
        at, to = self.steps
        if not len(at):
            return vote
        # within a step the vote still orders texts, by a thousandth
        return float(np.clip(0.999 * to[max(0, np.searchsorted(at, vote, side="right") - 1)] + 0.001 * vote, 0, 1))

    def judge(self, columns: np.ndarray, counts: np.ndarray, memo: dict) -> tuple[float, list]:
        """Score, and evidence: (id, cosine, label) of the nearest examples."""
        if not len(columns):
            return self.base, []
        key = (columns.tobytes(), counts.tobytes())
        if key not in memo:
            weights = self._weigh(columns, counts)
            found, cosines = self.nearest(columns, weights / np.sqrt(weights @ weights))
            if len(memo) > 50_000:
                memo.clear()
            memo[key] = (self.calibrated(self.vote(found, cosines)), [(self.ids[i], float(c), int(self.labels[i])) for i, c in zip(found[:5], cosines)])
        return memo[key]


def choose_terms(sample: DataFrame, min_df: int, strength: float, columns: tuple[str, str] = ("text", "label")) -> DataFrame:
    """``term, df`` of what the labels tell apart: terms of ``min_df`` texts or more, whose presence in the
    two classes differs by a log-likelihood ratio of ``strength`` times the logarithm of the sample's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), dtype=np.int64) > 0
            for texts in pieces(batch.column(0), 4 << 20):
                row, term, _ = term_counts(texts)
                of, place = np.unique(term, return_inverse=True)
                n1 = np.bincount(place, weights=label[texts.low + row], minlength=len(of)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(np.bincount(place, minlength=len(of)).astype(np.int64)), pa.array(n1)], names=["term", "df", "df1"])

    text, label = columns
    n = sample.agg(F.count("*").alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("n1")).first()
    total, n1 = n["n"], n["n1"] or 0
    of = sample.select(text, label).mapInArrow(count, "term long, df long, df1 long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("df1").alias("df1")).where(F.col("df") >= min_df)

    def fit(k: F.Column, of_n: int, p: F.Column) -> F.Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < of_n, (of_n - k) * F.log(1 - p)).otherwise(0.0)

    a, b, p = F.col("df1"), F.col("df") - F.col("df1"), F.col("df") / F.lit(max(1, total))
    ratio = 2 * (fit(a, n1, a / F.lit(max(1, n1))) + fit(b, total - n1, b / F.lit(max(1, total - n1))) - fit(a, n1, p) - fit(b, total - n1, p))
    return of.where(ratio >= strength * float(np.log(max(2, total)))).select("term", "df")


@tidy
def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", train=None, rows: int = 12_000, text_bytes: int = 256 << 20, min_df: int = 5, strength: float = 2.3, id_col: str = "doc_id", text_col: str = "text", **settings) -> NearestExamples:
    """The index over a sample of at most ``rows`` labelled documents (those with the smallest hash of the
    id), with ``text_bytes`` of text at most. Executors choose the vocabulary (see ``choose_terms``), all terms that pass, and count them; the driver
    gets these terms and their counts in the sample, which bounds both.

    Of several labels of an id the largest counts; repeated rows of a labelled id are an example each. Null labels and ids are left out, null and
    empty texts are examples without terms; very long texts are taken whole. Without labelled rows all texts score
    one half. Other columns are not read."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if train is None else train, rows, id_col, text_col, F.octet_length("text").cast("long"), text_bytes)
    chosen = choose_terms(sample, min_df, strength).toArrow()
    terms, df = chosen["term"].to_numpy().view(np.uint64), chosen["df"].to_numpy()
    order = np.argsort(terms)
    vocabulary, df = terms[order], df[order]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                row, column, n = term_counts(texts, shared.value)
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                cut = lambda x: pa.array([x[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:])], pa.binary())  # noqa: B023, E731
                part = batch.slice(texts.low, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), cut(column), cut(n)], names=["id", "label", "columns", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(count, f"id {kind}, label int, columns binary, counts binary").toArrow().sort_by([("id", "ascending"), ("columns", "ascending"), ("counts", "ascending"), ("label", "ascending")])
    columns = [np.frombuffer(x, "<i4") for x in got["columns"].to_pylist()]
    counts = [np.frombuffer(x, "<i4") for x in got["counts"].to_pylist()]
    rows_of = np.repeat(np.arange(len(columns)), [len(t) for t in columns])
    labels_of = (np.array(got["label"].to_pylist(), dtype=np.int64) > 0).astype(np.int64)
    none = np.zeros(0, np.int64)
    return NearestExamples(vocabulary, df, rows_of, np.concatenate([none, *columns]), np.concatenate([none, *counts]), labels_of, got["id"].to_pylist(), **settings)


def score_toxicity(docs: DataFrame, index: NearestExamples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, evidence`` of each row of ``docs``; ``evidence``: the nearest labelled examples, as
    structs of id, cosine and label.

    Null and empty texts, and texts without a term of the vocabulary, have the rate of label 1 among such
    examples and no evidence. Very long texts are taken whole; of equal cosines the examples that stand first in the index count; an empty table gives no rows. Repeated rows are each scored; other columns are not read. The broadcast
    index is bounded by the sample it was learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    evidence = pa.list_(pa.struct([("id", to_arrow_type(kind)), ("cosine", pa.float64()), ("label", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = shared.value, {}
        for batch in batches:
            scores, why = [], []
            for texts in pieces(batch.column(1)):
                row, column, n = term_counts(texts, known.vocabulary)
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                for a, b in zip(first.tolist(), first[1:].tolist()):
                    s, e = known.judge(column[a:b], n[a:b], memo)
                    scores.append(s)
                    why.append([{"id": i, "cosine": c, "label": y} for i, c, y in e])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(why, evidence)], names=["id", "score", "evidence"])

    name = kind.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {name}, score double, evidence array<struct<id:{name},cosine:double,label:int>>")
    return out.select(F.col("id").alias(id_col), "score", "evidence")
