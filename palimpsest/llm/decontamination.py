"""Benchmark decontamination: a broadcast hash set of the items' word windows, scanned over whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, stored, tidy
from .words import LETTERED, Texts, Words, pieces, runs_to_mask, row_sums, span_hashes, windows, words

WINDOW = 10
_BITS = 20


def _joined(texts: Texts, found: Words, begin: int, size: int) -> bytes:
    return b" ".join(texts.buf[s:e].tobytes().lower() for s, e in zip(found.start[begin : begin + size], found.end[begin : begin + size]))


def _without(raw: bytes, start: np.ndarray, end: np.ndarray, spans: Iterable[tuple[int, int]]) -> str:
    """``raw`` without the words of ascending, disjoint ``spans`` and what stands between them."""
    keep, last = [], 0
    for a, b in spans:
        keep.append(raw[last : start[a]])
        last = int(end[b - 1])
    return b"".join([*keep, raw[last:]]).decode("utf-8", "replace")


def _row_spans(found: Words, mask: np.ndarray, rows: int) -> list[list[list[int]]]:
    """[begin, end) of the runs of words in ``mask``, in words of their row, by row."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = found.first[1:-1]  # a run that goes on into the next text is two
    over = cut[mask[np.minimum(cut, len(mask) - 1)] & mask[cut - 1] & (cut > 0) & (cut < len(mask))] if len(mask) and len(cut) else cut[:0]
    over = np.unique(over)
    begin, end = np.sort(np.concatenate([begin, over])), np.sort(np.concatenate([end, over]))
    row = np.searchsorted(found.first, begin, side="right") - 1
    spans: list[list[list[int]]] = [[] for _ in range(rows)]
    for r, a, b in zip(row.tolist(), (begin - found.first[row]).tolist(), (end - found.first[row]).tolist()):
        spans[r].append([a, b])
    return spans


class WindowSet:
    """Windows of the items' normalised words, by hash: what a hash stands for is kept to verify hits."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.known: dict[int, dict[int, dict[bytes, set[str]]]] = {}  # words in a window -> hash -> text -> items
        column = pa.array([t for _, t in items], pa.string())
        for texts in pieces(column):
            found = words(texts, LETTERED)
            hashes = span_hashes(texts.buf, found.start, found.end, fold=True)
            for row, n in enumerate(found.counts):
                if n:
                    size, first = min(int(n), window), int(found.first[row])
                    of, _ = windows(hashes[first : first + n], np.array([0, n]), size, False)
                    for k, h in enumerate(of.tolist()):
                        self.known.setdefault(size, {}).setdefault(h, {}).setdefault(_joined(texts, found, first + k, size), set()).add(items[texts.low + row][0])
        self.sorted = {size: np.array(sorted(of), dtype=np.uint64) for size, of in self.known.items()}
        self.maybe = {}
        for size, of in self.sorted.items():
            self.maybe[size] = np.zeros(1 << _BITS, dtype=bool)
            self.maybe[size][(of >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def scan(self, texts: Texts) -> tuple[Words, np.ndarray, list[set[str]]]:
        """The words of ``texts``, which of them are hit, and the items that occur in each row."""
        found = words(texts, LETTERED)
        hashes = span_hashes(texts.buf, found.start, found.end, fold=True)
        starts, ends, items = [], [], [set() for _ in range(len(texts))]
        for size, of in self.sorted.items():
            here, bounds = windows(hashes, found.first, size, False)
            likely = np.flatnonzero(self.maybe[size][(here >> np.uint64(64 - _BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(of, here[likely]), len(of) - 1)
            likely = likely[of[at] == here[likely]]
            rows = np.searchsorted(bounds, likely, side="right") - 1
            for k, row in zip(likely.tolist(), rows.tolist()):
                begin = int(found.first[row]) + k - int(bounds[row])
                which = self.known[size][int(here[k])].get(_joined(texts, found, begin, size))
                if which:
                    items[row] |= which
                    starts.append(begin)
                    ends.append(begin + size)
        return found, runs_to_mask(len(found.start), np.array(starts, np.int64), np.array(ends, np.int64)), items

    def cleaned(self, text: str) -> tuple[str, int, int]:
        """``text`` without its hit words (and what stands between them), its words and hit words; what
        remains is scanned again until nothing is hit."""
        total = hit = None
        while True:
            (texts,) = pieces(pa.array([text]))
            found, mask, _ = self.scan(texts)
            total, hit = (len(mask), int(mask.sum())) if total is None else (total, hit)
            if not mask.any():
                return text, total, hit
            edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
            text = _without(texts.buf.tobytes(), found.start, found.end, zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def _sets(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_bytes: int) -> tuple[int, Iterator[WindowSet]]:
    """How many window sets of about ``max_bytes`` of item text at most there are (usually one), and them."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // max_bytes)
    parts = (items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n))
    return n, (WindowSet([(r.item, r.text) for r in part.collect()], window) for part in parts)


@tidy
def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = 16 << 20) -> DataFrame:
    """``id_col, n_words, n_hit, items, spans`` of each row of ``docs``.

    Words: A-Z lower-cased, runs of digits, a-z and all beyond ASCII. An item's windows are each
    ``window`` consecutive words of it (an item with fewer: all its words); a document word in an
    occurrence of one is hit. ``items``: ids, as sorted strings, of items with a window that occurs;
    ``spans``: [begin, end) of runs of hit words. Null and empty texts have no words, null items are
    ignored, equal items (and ids) count once, repeated rows are each scanned, an empty benchmark hits
    nothing. Other columns of ``docs`` are not read.

    The hash set is broadcast. It holds ``max_bytes`` of item text at most: a larger benchmark is taken
    in slices, each scanned over all documents, with what is found so far kept in the shared folder.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, spans array<array<long>>, items array<string>"
    out, context = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), docs.sparkSession.sparkContext
    n, sets = _sets(benchmark, item_col, item_text_col, window, max_bytes)
    for k, known in enumerate(sets if n else [WindowSet([], window)]):
        out = stored(out, "overlaps") if k else out
        shared = context.broadcast(known)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, more=k > 0, last=k + 1 >= n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts in pieces(batch.column(1)):
                    found, mask, items = shared.value.scan(texts)
                    spans = _row_spans(found, mask, len(texts))
                    part = batch.slice(texts.low, len(texts))
                    if more:
                        spans = [_union(a, b or []) for a, b in zip(spans, part.column(3).to_pylist())]
                        items = [a | set(b or []) for a, b in zip(items, part.column(4).to_pylist())]
                    columns = [part.column(0), pa.nulls(len(part), pa.string()) if last else part.column(1), pa.array(found.counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_words", "spans", "items"])

        out = out.mapInArrow(scan, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


@tidy
def remove_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, drop_share: float = 0.5, max_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with the same columns, without what they share with the benchmark (see ``find_overlaps``).

    Hit words go, with what stands between them, until nothing is hit; a document goes as a whole where
    more than ``drop_share`` of its words are hit at first (0: any hit). ``chars_col``, where ``docs`` has
    it, is set to the length of a changed text. Documents without a hit stay as they are, null and empty
    texts too. Very long texts are scanned whole; overlapping hits count once; a share that equals ``drop_share`` stays; repeated rows are each treated; an empty
    table gives no rows, an empty benchmark all. Other columns pass, whatever their names. A benchmark of several slices (see ``max_bytes``) gives the same: hits of all slices are
    gathered over one text before it is cut.
    """
    names = docs.columns
    if text_col not in names:
        raise ValueError(f"no column {text_col}")
    n, sets = _sets(benchmark, item_col, item_text_col, window, max_bytes)
    shared = [docs.sparkSession.sparkContext.broadcast(known) for known in sets]
    if n > 1:
        return _remove_by_slices(docs, shared, text_col, chars_col, drop_share)
    for known in shared:

        def clean(batches: Iterator[pa.RecordBatch], shared=known) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                at, keep, new = batch.schema.get_field_index(text_col), np.ones(batch.num_rows, bool), {}
                for texts in pieces(batch.column(at)):
                    found, mask, _ = known.scan(texts)
                    for row in np.flatnonzero(row_sums(mask, found.first)).tolist():
                        text, total, hit = known.cleaned(texts.text(row).decode("utf-8", "replace"))
                        keep[texts.low + row] = hit <= drop_share * total
                        new[texts.low + row] = text
                if new:
                    batch = pa.RecordBatch.from_arrays(_replaced(batch, new, text_col, chars_col), schema=batch.schema).filter(pa.array(keep))
                yield batch

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def _replaced(batch: pa.RecordBatch, new: dict[int, str], text_col: str, chars_col: str | None) -> list[pa.Array]:
    """The columns of ``batch`` with the texts ``new``, by row, and their lengths."""
    at, columns, changed = batch.schema.get_field_index(text_col), list(batch.columns), np.zeros(batch.num_rows, bool)
    changed[list(new)] = True
    values = {at: [new[i] for i in sorted(new)]}
    if chars_col and (size := batch.schema.get_field_index(chars_col)) >= 0:
        values[size] = [len(t) for t in values[at]]
    for k, of in values.items():
        columns[k] = pc.replace_with_mask(columns[k], pa.array(changed), pa.array(of, columns[k].type))
    return columns


def _remove_by_slices(docs: DataFrame, sets: list[Broadcast], text_col: str, chars_col: str | None, drop_share: float) -> DataFrame:
    """``remove_overlaps`` by several window sets: each round scans one text with all of them, unites their
    spans and cuts. Only what a round has cut is scanned in the next; the first decides what goes."""
    names, column, done, first = docs.columns, free_name(docs, "spans"), [], True
    open_ = docs.withColumn(column, F.lit(None).cast("array<array<long>>"))
    schema = open_.schema
    while first or not open_.isEmpty():
        for k, known in enumerate(sets):

            def scan(batches: Iterator[pa.RecordBatch], shared=known, last=k + 1 == len(sets), drop=drop_share if first else None) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    at, keep, new, spans = batch.schema.get_field_index(text_col), np.ones(batch.num_rows, bool), {}, batch.column(batch.num_columns - 1).to_pylist()
                    for texts in pieces(batch.column(at)):
                        found, mask, _ = shared.value.scan(texts)
                        for row, here in enumerate(_row_spans(found, mask, len(texts)), texts.low):
                            spans[row] = _union(here, spans[row] or []) or None
                            if last and spans[row]:
                                a, b = found.first[row - texts.low], found.first[row - texts.low + 1]
                                zero = texts.at[row - texts.low]
                                new[row] = _without(texts.text(row - texts.low), found.start[a:b] - zero, found.end[a:b] - zero, spans[row])
                                keep[row] = drop is None or sum(e - s for s, e in spans[row]) <= drop * int(b - a)
                    columns = _replaced(batch, new, text_col, chars_col) if new else list(batch.columns)
                    columns[-1] = pa.array(spans, columns[-1].type)
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

            open_ = stored(open_.mapInArrow(scan, schema), "slice")
        done.append(open_.where(F.col(column).isNull()).select(names))
        open_ = open_.where(F.col(column).isNotNull()).withColumn(column, F.lit(None).cast("array<array<long>>"))
        first = False
    return reduce(DataFrame.unionByName, done)
