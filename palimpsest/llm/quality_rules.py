"""Quality rules: line labelling by a linear-chain CRF, beside counts over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ftrl import labelled_sample
from .runtime import tidy
from .words import SPACED, Texts, Words, pieces, row_sums, runs_to_mask, span_hashes, windows, words

REPEAT = 8
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LEAD = np.ones(256, bool)  # bytes that begin a code point
_LEAD[0x80:0xC0] = False
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!|")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\"')")] = True

#: What a line shows, with the rule weight of boilerplate against content: positive speaks for boilerplate.
FEATURES = {
    "always": -1.0,
    "symbols in every third word or more": 2.0,
    "a symbol in some word": 0.5,
    "mostly capitals": 2.0,
    "every fifth character a digit": 1.0,
    "under three words": 0.5,
    "eight words or more": -0.5,
    "equal to an earlier line": 2.0,
    "a third of its words in repeated windows": 2.0,
    "most words in repeated windows": 1.0,
    "ends like a sentence": -1.0,
    "marks (! and |) in every third word or more": 2.0,
    "words longer than 14 on average": 0.5,
    "a word follows itself in every third place": 2.0,
    "first line": -0.2,
    "last line": 0.2,
}
#: Staying with a label against changing it.
STAY = 1.0
#: Texts with more lines are decoded one by one, and training cuts their lines into sequences of as many.
_LONG = 500


class Lines:
    """Counts of texts and of their lines. Line ``i`` is ``buf[start[i]:end[i]]``; those of row ``r`` are
    ``first[r]`` to ``first[r + 1]`` (a text has one line more than line feeds)."""

    def __init__(self, texts: Texts):
        self.texts, self.found = texts, words(texts, SPACED)
        buf, found = texts.buf, self.found
        breaks = np.flatnonzero(buf == 10)
        self.end = np.insert(breaks, np.searchsorted(breaks, texts.at[1:]), texts.at[1:])
        self.first = np.searchsorted(breaks, texts.at) + np.arange(len(texts.at))
        # a line starts behind the line feed before it, or where its text does
        self.start = np.zeros(len(self.end), np.int64)
        self.start[1:] = self.end[:-1] + 1
        self.start[self.first[:-1]] = texts.at[:-1]
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.n_words = np.searchsorted(found.start, self.end) - np.searchsorted(found.start, self.start)
        self.word_first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.hashes = span_hashes(buf, found.start, found.end)
        self.repeated = self._repeated(found)
        self.duplicate = self._duplicate(buf)

    def _repeated(self, found: Words) -> np.ndarray:
        h, bounds = windows(self.hashes, found.first, REPEAT, False)
        row = np.repeat(np.arange(len(self.texts)), np.diff(bounds))
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        begin = found.first[row[at]] + at - bounds[row[at]]
        return runs_to_mask(len(found.start), begin, begin + REPEAT)

    def _duplicate(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.end), bool)
        used = np.flatnonzero(self.n_words)
        h = span_hashes(buf, self.start[used], self.end[used])
        order = np.lexsort((h, self.row[used]))  # stable: earlier lines first
        o = used[order]
        out[o[1:][(h[order][1:] == h[order][:-1]) & (self.row[o][1:] == self.row[o][:-1])]] = True
        return out

    def _inside(self, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[self.texts.buf])])
        return total[end] - total[start]

    def counts(self) -> dict[str, np.ndarray]:
        """By row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        at, found = self.texts.at, self.found
        return {
            "n_words": found.counts,
            "word_chars": row_sums(self._inside(_LEAD, found.start, found.end), found.first),
            "n_symbols": self._inside(_SYMBOL, at[:-1], at[1:]),
            "n_dup_lines": row_sums(self.duplicate, self.first),
            "n_repeat_words": row_sums(self.repeated, found.first),
        }

    def features(self) -> np.ndarray:
        """One row of 0 and 1 for each line with a word, in the order of ``FEATURES``; see ``used``."""
        n = np.maximum(self.n_words, 1)
        per_line = lambda of_word: row_sums(of_word, self.word_first)
        symbols = per_line(self._inside(_SYMBOL, self.found.start, self.found.end) > 0)
        marks = per_line(self._inside(_MARK, self.found.start, self.found.end) > 0)
        upper, lower, digits = (self._inside(t, self.start, self.end) for t in (_UPPER, _LOWER, _DIGIT))
        chars = per_line(self._inside(_LEAD, self.found.start, self.found.end))
        repeated = per_line(self.repeated)
        follows = np.zeros(len(self.hashes), bool)
        follows[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.found.row[1:] == self.found.row[:-1])
        last_word = np.maximum(self.word_first[1:] - 1, 0)
        stop = _STOP[self.texts.buf[self.found.end[last_word] - 1]] if len(self.hashes) else np.zeros(len(n), bool)
        place = np.arange(len(n))
        columns = [
            np.ones(len(n), bool), 3 * symbols >= n, symbols > 0, (upper > lower) & (upper >= 4), 5 * digits >= np.maximum(chars, 1), n < 3, n >= 8,
            self.duplicate, 3 * repeated >= n, 2 * repeated > n, stop, 3 * marks >= n, chars > 14 * n, 3 * per_line(follows) >= n,
            place == self.first[self.row], place == self.first[self.row + 1] - 1,
        ]
        return np.stack(columns, axis=1).astype(np.uint8)[self.used]

    @property
    def used(self) -> np.ndarray:
        return np.flatnonzero(self.n_words)


class LineCrf:
    """A CRF over two labels of lines, 0 content and 1 boilerplate: weights of line features (for label 1
    against 0) and of keeping the label from one line to the next."""

    def __init__(self, weights: np.ndarray | None = None, stay: float = STAY):
        self.rules = np.array(list(FEATURES.values()))
        self.weights = self.rules.copy() if weights is None else weights
        self.stay = stay

    def _steps(self, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sequences by falling length, and for each step the places of their lines, as far as they reach."""
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)])[order]
        left = lengths[order]
        reach = np.searchsorted(-left, -np.arange(left.max(initial=0)), side="left")
        return order, [first[:k] + t for t, k in enumerate(reach)]

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi: the labels of the most likely sequence of each text; ties go to content."""
        e = x @ self.weights
        long = lengths > _LONG
        if long.any():  # one by one; the others step by step, all at once
            labels, first = np.zeros(len(e), np.int8), np.concatenate([[0], np.cumsum(lengths)])
            rest = np.repeat(~long, lengths)
            labels[rest] = self._decode(e[rest], lengths[~long])
            for k in np.flatnonzero(long):
                labels[first[k] : first[k + 1]] = self._decode_one(e[first[k] : first[k + 1]].tolist())
            return labels
        return self._decode(e, lengths)

    def _decode_one(self, e: list[float]) -> np.ndarray:
        """``decode`` of one sequence, in plain numbers: quicker where no other has as many lines."""
        stay, best0, best1 = self.stay, 0.0, e[0]
        back = bytearray(2 * len(e))
        for t in range(1, len(e)):
            keep0, keep1 = best0 + stay, best1 + stay
            if best1 > keep0:
                back[2 * t], to0 = 1, best1
            else:
                to0 = keep0
            if keep1 > best0:
                back[2 * t + 1], best1 = 1, keep1 + e[t]
            else:
                best1 = best0 + e[t]
            best0 = to0
        labels, k = np.zeros(len(e), np.int8), int(best1 > best0)
        for t in range(len(e) - 1, -1, -1):
            labels[t] = k
            k = back[2 * t + k]
        return labels

    def _decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        _, steps = self._steps(lengths)
        labels, back = np.zeros(len(e), np.int8), np.zeros((len(e), 2), np.int8)
        ends = np.zeros((len(lengths), 2))
        best = np.zeros((0, 2))
        for t, at in enumerate(steps):
            now = np.stack([np.zeros(len(at)), e[at]], axis=1)
            if t:
                prev = best[: len(at)]
                for y in (0, 1):
                    from0, from1 = prev[:, 0] + (self.stay if y == 0 else 0), prev[:, 1] + (self.stay if y == 1 else 0)
                    back[at, y] = from1 > from0
                    now[:, y] += np.maximum(from0, from1)
            best = now
            ends[: len(at)] = now
        k = (ends[:, 1] > ends[:, 0]).astype(np.int8)
        for t in range(len(steps) - 1, -1, -1):
            at = steps[t]
            longer = len(steps[t + 1]) if t + 1 < len(steps) else 0
            if longer:
                k[:longer] = back[steps[t + 1], k[:longer]]
            labels[at] = k[: len(at)]
        return labels

    def fit(self, codes: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.3, pull: float = 0.01) -> "LineCrf":
        """Likelihood ascent with forward-backward marginals; ``pull`` draws the weights to the rules, so
        that features no line shows keep the rule's weight. ``codes`` has the features of each line as bits (see ``coded``): the
        distinct ones, of which there are few, stand for all lines that show them."""
        if not len(y):
            return self
        of, code = np.unique(codes, return_inverse=True)
        shown = (of[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)
        _, steps = self._steps(lengths)
        theta = np.append(self.weights, self.stay)
        prior = np.append(self.rules, STAY)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pairs = sum(len(at) for at in steps[1:])
        kept = sum(float((y[a[: len(b)]] == y[b]).sum()) for a, b in zip(steps, steps[1:]))
        target = np.append(shown.T @ np.bincount(code, weights=y, minlength=len(of)), kept)
        for r in range(1, rounds + 1):
            e, s = np.clip(shown @ theta[:-1], -30, 30), np.exp(np.clip(theta[-1], -20, 20))
            emits = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], axis=1)
            alpha, beta = np.zeros((len(y), 2)), np.ones((len(y), 2))
            for t, at in enumerate(steps):
                a = emits[code[at]]
                if t:
                    prev = alpha[steps[t - 1][: len(at)]]
                    a = a * (prev * s + prev[:, ::-1])
                alpha[at] = a / a.sum(axis=1, keepdims=True)
            same = 0.0
            for t in range(len(steps) - 1, 0, -1):
                at, before = steps[t], steps[t - 1][: len(steps[t])]
                b = emits[code[at]] * beta[at]
                out = b * s + b[:, ::-1]
                stay = (alpha[before] * b * s).sum(axis=1)
                same += float((stay / (alpha[before] * out).sum(axis=1)).sum())
                beta[before] = out / out.sum(axis=1, keepdims=True)
            p = alpha * beta
            p = p[:, 1] / p.sum(axis=1)
            gradient = (target - np.append(shown.T @ np.bincount(code, weights=p, minlength=len(of)), same)) / max(1, len(y)) - pull * (theta - prior) / 10
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
        self.weights, self.stay = theta[:-1], float(theta[-1]) if pairs else STAY
        return self


def coded(x: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as the bits of a number each."""
    return (x.astype(np.uint16) << np.arange(len(FEATURES), dtype=np.uint16)).sum(axis=1, dtype=np.uint16)


@tidy
def train_lines(docs: DataFrame, labels: DataFrame | None, label: str = "quality", rows: int = 4_000, lines: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> LineCrf:
    """The CRF from at most ``rows`` labelled documents with at most ``lines`` lines together (of the first, all): all lines of one of low quality count as
    boilerplate, those of others as content; a document of over 500 lines is several sequences. The driver gets two bytes for each line of the sample. Without
    labelled rows of both kinds the rule weights stand.

    Of several labels of an id the largest counts, and repeated rows of it count each; null ids and labels are left out; null and empty texts
    have no lines; very long texts are read whole. Other columns are not read.
    """
    if labels is None:
        return LineCrf()
    cost = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    sample = labelled_sample(docs, labels, label, F.lit(True), rows, id_col, text_col, cost, lines)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                found = Lines(texts)
                x, row = coded(found.features()), found.row[found.used]
                first = np.searchsorted(row, np.arange(len(texts) + 1))
                part = batch.slice(texts.low, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([x[a:b].astype("<u2").tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["id", "label", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(read, f"id {kind}, label int, x binary").toArrow().sort_by([("id", "ascending"), ("x", "ascending")])
    codes = [np.frombuffer(b, "<u2") for b in got["x"].to_pylist()]
    y = np.repeat(np.array([float(y <= 0) for y in got["label"].to_pylist()]), [len(x) for x in codes])
    if not 0 < y.sum() < len(y):
        return LineCrf()
    lengths = np.array([min(_LONG, len(x) - at) for x in codes for at in range(0, len(x), _LONG)], dtype=np.int64)
    return LineCrf().fit(np.concatenate(codes), y, lengths)


def judge(texts: Texts, crf: LineCrf, share: float) -> dict[str, np.ndarray]:
    lines = Lines(texts)
    out = lines.counts()
    used = lines.used
    row = lines.row[used]
    lengths = np.bincount(row, minlength=len(texts))
    label = crf.decode(lines.features().astype(np.float64), lengths[lengths > 0])
    content = np.bincount(row, weights=np.where(label == 0, lines.n_words[used], 0), minlength=len(texts))
    out["content_share"] = content / np.maximum(out["n_words"], 1)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= share)
    return out


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "content_share": "double", "base_failed": "boolean", "kept": "boolean"}


def apply_rules(docs: DataFrame, crf: LineCrf, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and counts of each row of ``docs``, the share of its words in lines that Viterbi decoding
    labels content, and the verdict: ``kept`` unless ``base_failed`` or the share is below ``share``.

    Null and empty texts have no words, so they fail the base rules like all under 20 words. Very long texts are judged
    whole; equally likely labels of a line go to content; repeated rows are each judged; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                found = judge(texts, shared.value, share)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.low, len(texts)), *(pa.array(found[c]) for c in _COLUMNS)], names=["id", *_COLUMNS])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in _COLUMNS.items()))
    return out.withColumnRenamed("id", id_col)


def filter_rules(docs: DataFrame, crf: LineCrf, share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with the same columns, that ``apply_rules`` keeps (see there for null, empty and very long
    texts, ties and repeated rows; an empty table stays empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            parts = [judge(t, shared.value, share)["kept"] for t in pieces(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *parts])))

    return docs.mapInArrow(run, docs.schema)
