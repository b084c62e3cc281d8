"""Packing: fill windows of tokens by length combinations, repeated as non-negative least squares tell."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import marked, stored, tidy
from .words import slices

END_ID = 1


class Encoder:
    """Ids of a text as the ``tokenizers`` file gives them without added special tokens.

    Where ``ranks`` names the same vocabulary as ranks, the faster library encodes; texts that hold the
    string of a special token, or very long unbroken runs, always go to the ``tokenizers`` file.
    """

    _LONG_RUN = 4096

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def full(self):
        """The tokenizer itself, which takes much memory: it is read when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (len(text) > self._LONG_RUN and max(map(len, text.split()), default=0) > self._LONG_RUN):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


_encoders: dict[tuple, Encoder] = {}


def encoder(*source: str | None) -> Encoder:
    if source not in _encoders:
        _encoders[source] = Encoder(*source)
    return _encoders[source]


def combinations(histogram: np.ndarray, window: int, each: int = 3, depth: int = 6, seed: int = 11) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths that fill ``window`` exactly, each with falling lengths.

    Every length that occurs gets the pair that fills it up, where that occurs, and ``each`` combinations
    of 3 to ``depth`` lengths drawn by their frequency, the last of which closes the window.
    """
    lengths = np.flatnonzero(histogram)
    share = np.cumsum(histogram[lengths] / histogram.sum()) if len(lengths) else np.zeros(0)
    draw, found = np.random.default_rng(seed), {}
    for a in lengths.tolist():
        if a == window:
            continue
        if window - a < len(histogram) and histogram[window - a]:
            found[tuple(sorted((a, window - a), reverse=True))] = None
        made = 0
        for _ in range(60):
            if made == each:
                break
            parts, gap = [a], window - a
            while gap and len(parts) < depth:
                if len(parts) > 1 and gap < len(histogram) and histogram[gap]:
                    parts.append(gap)
                    gap = 0
                else:
                    fits = int(np.searchsorted(lengths, gap, side="right"))
                    if not fits:
                        break
                    b = int(lengths[np.searchsorted(share, draw.random() * share[fits - 1])])
                    parts.append(b)
                    gap -= b
            if not gap:
                key = tuple(sorted(parts, reverse=True))
                made += key not in found
                found[key] = None
    return list(found)


def nonnegative_least_squares(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths the columns use closest to the histogram, by cyclic
    coordinate descent on the residual."""
    rest, x = histogram.astype(np.float64), np.zeros(len(columns))
    entries = [tuple(zip(*((a, c.count(a)) for a in sorted(set(c))))) for c in columns]
    left = rest.tolist()
    for _ in range(sweeps):
        moved = 0.0
        for p, (at, times) in enumerate(entries):
            gain = norm = 0.0
            for a, m in zip(at, times):
                gain += m * left[a]
                norm += m * m
            new = x[p] + gain / norm
            step = (new if new > 0 else 0.0) - x[p]
            if step:
                x[p] += step
                moved = max(moved, abs(step))
                for a, m in zip(at, times):
                    left[a] -= m * step
        if moved < 0.25:
            break
    return x


class Plan:
    """Where each piece goes, from its length and its rank among pieces of that length alone.

    ``uses[a]``: (first rank, pieces by repeat, offsets, first sequence) of each combination that takes
    length ``a``, by rank. Ranks beyond these are laid one after another and cut at the window's end; the
    last of those windows is cut into powers of two.
    """

    def __init__(self, histogram: np.ndarray, window: int, full: int):
        self.window, left = window, histogram.astype(np.int64).copy()
        self.uses: dict[int, list[tuple[int, int, list[int], int]]] = {}
        taken, next_id = np.zeros(len(histogram), np.int64), full
        columns = combinations(histogram, window) if histogram.sum() else []
        self.combined = 0

        def use(parts: tuple[int, ...], n: int) -> None:
            nonlocal next_id
            offsets: dict[int, list[int]] = {}
            at = 0
            for a in parts:
                offsets.setdefault(a, []).append(at)
                at += a
            for a, of in offsets.items():
                self.uses.setdefault(a, []).append((int(taken[a]), len(of), of, next_id))
                taken[a] += n * len(of)
                left[a] -= n * len(of)
            next_id += n
            self.combined += n

        solved = nonnegative_least_squares(columns, histogram)
        for p in np.argsort(-solved, kind="stable").tolist():  # rounded down, and never beyond what is left
            parts = columns[p]
            n = min(int(solved[p] + 1e-9), *(int(left[a]) // parts.count(a) for a in set(parts)))
            if n > 0:
                use(parts, n)
        # what rounding left: the longest first, filled up with the longest that fit
        aside = np.zeros(len(left), np.int64)
        while (have := np.flatnonzero(left)).size:
            parts, gap, spare = [int(have[-1])], window - int(have[-1]), left.copy()
            spare[parts[0]] -= 1
            while gap and (fits := np.flatnonzero(spare[: gap + 1])).size:
                parts.append(int(fits[-1]))
                spare[parts[-1]] -= 1
                gap -= parts[-1]
            if gap and gap < window:
                aside[parts[0]], left[parts[0]] = left[parts[0]], 0
            else:
                use(tuple(parts), min(int(left[a]) // parts.count(a) for a in set(parts)))
        self.taken, self.first_rest = taken, next_id
        lengths = np.arange(len(aside))
        total = aside * lengths
        self.before = np.concatenate([np.cumsum(total[::-1])[::-1][1:], [0]])  # tokens of longer pieces
        self.rest_tokens = int(total.sum())

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the piece, length, sequence, offset) of its parts."""
        if rank < self.taken[length]:
            uses = self.uses[length]
            low, high = 0, len(uses)
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if uses[mid][0] <= rank else (low, mid)
            first, by, offsets, sequence = uses[low]
            return [(0, length, sequence + (rank - first) // by, offsets[(rank - first) % by])]
        at = int(self.before[length]) + (rank - int(self.taken[length])) * length
        out, start = [], 0
        while start < length:
            begin, end, sequence = self._window(at + start)
            n = min(length - start, end - at - start)
            out.append((start, n, sequence, at + start - begin))
            start += n
        return out

    def _window(self, at: int) -> tuple[int, int, int]:
        whole = self.rest_tokens // self.window
        if at < whole * self.window:
            k = at // self.window
            return k * self.window, (k + 1) * self.window, self.first_rest + k
        begin, sequence, rest = whole * self.window, self.first_rest + whole, self.rest_tokens % self.window
        while True:
            size = 1 << (rest.bit_length() - 1)
            if at < begin + size:
                return begin, begin + size, sequence
            begin, sequence, rest = begin + size, sequence + 1, rest - size


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@tidy
def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, window: int = 2048, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens: ``id_col, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``. Each full window of it is a sequence; what is left over is one
    piece, joined with others by combinations of lengths (see ``Plan``); only pieces that no combination
    takes are cut. Null and empty texts are ``end_id`` alone; very long ones are encoded whole; pieces of one length are dealt in order of
    their tasks and rows; repeated rows are packed each; an empty table gives no rows; other columns
    are not read. ``tokenizer`` is the path of a ``tokenizers`` file on every executor; ``ranks`` and
    ``pattern`` give the same vocabulary to the faster encoder.

    The driver sees the histogram of lengths (fewer than ``window`` rows) and plans on it; ranks come from
    counts by task and length, so that a frequent length is never gathered.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"key long, id {kind}, doc_tokens long, crcs array<long>, chunk_rank long, length int, crc long, bucket int, rank long, ids binary"
    source = (tokenizer, ranks, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bucket = encoder(*source), TaskContext.get().partitionId()
        seen, chunks, key = np.zeros(window, np.int64), 0, bucket << 36
        for batch in (part for whole in batches for part in slices(whole)):
            columns: list[list] = [[] for _ in range(9)]
            for text in batch.column(1).to_pylist():
                ids = np.append(code(text or ""), np.uint32(end_id))
                n, tail = len(ids) // window, len(ids) % window
                last = ids[n * window :]
                row = (key, len(ids), [_crc(ids[i * window : (i + 1) * window]) for i in range(n)], chunks, tail, _crc(last), bucket, int(seen[tail]), last.astype("<u4" if ids.max() > 0xFFFF else "<u2").tobytes() if tail else None)
                for column, value in zip(columns, row):
                    column.append(value)
                seen[tail] += 1
                chunks += n
                key += 1
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([made[0], batch.column(0), *made[1:]], names=["key", "id", "doc_tokens", "crcs", "chunk_rank", "length", "crc", "bucket", "rank", "ids"])

    coded = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema), "coded")
    # the histogram by task: length 0 stands for full windows
    counts = coded.where("length > 0").groupBy("bucket", "length").agg(F.count("*").alias("n"))
    counts = counts.unionByName(coded.groupBy("bucket").agg(F.sum(F.size("crcs")).alias("n")).select("bucket", F.lit(0).alias("length"), "n"))
    counts = stored(counts, "lengths")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram = np.zeros(window, np.int64)
    for length, n in totals.items():
        if length:
            histogram[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(Plan(histogram, window, totals.get(0, 0)))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    chunked = before.where("length = 0").select("bucket", F.col("before").alias("chunks_before"))
    # grows with the tasks, so it is never broadcast
    ranks = before.join(chunked.hint("merge"), "bucket")
    slim = coded.drop("ids").join(ranks.hint("merge"), ["bucket", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[list] = [[] for _ in range(7)]
            which = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "doc_tokens", "crcs", "chunk_rank", "length", "crc", "rank", "before", "chunks_before")))
            for i, (key, tokens, crcs, chunk, length, crc, rank, skipped, chunks_before) in enumerate(rows):
                parts = [(k * window, window, c, chunks_before + chunk + k, 0) for k, c in enumerate(crcs)]
                if length:
                    cut = plan.place(length, skipped + rank)
                    parts += [(tokens - length + s, n, crc if n == length else None, q, o) for s, n, q, o in cut]
                for s, n, c, q, o in parts:
                    which.append(i)
                    for column, value in zip(out, (key, s, n, c, tokens, q, o)):
                        column.append(value)
            names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names=["id", *names])

    pieces = stored(slim.mapInArrow(place, f"id {kind}, key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"), "pieces")

    def crc_of_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for ids, tail, s, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("ids", "tail", "start", "length", "doc_tokens"))):
                values = np.frombuffer(ids, "<u2" if len(ids) == 2 * tail else "<u4")
                s -= tokens - tail
                got.append(_crc(values[s : s + n]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "start", "length")), pa.array(got, pa.int64()), *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    cut = pieces.where("ids_crc32 is null").drop("ids_crc32")
    # ids are shuffled of the pieces that were cut alone, and some more
    wanted = marked(coded.select("key", F.col("length").alias("tail"), "ids"), "key", cut.select("key").distinct(), "likely").where("likely").drop("likely")
    cut = cut.join(wanted, "key")
    cut = cut.mapInArrow(crc_of_cut, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    out = pieces.where("ids_crc32 is not null").drop("key").unionByName(cut)
    return out.withColumnRenamed("id", id_col)
