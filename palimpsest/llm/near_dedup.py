"""MinHash near-dedup: bottom-k sketches, inverted lists of retained values, union-sketch estimates, exact Jaccard.

Equal shingle sets are one class first, whatever their number. Classes meet in inverted lists of single
retained values, a class standing in the lists of its rarest ones only: two sketches of the wanted similarity
share so many values that they meet several times even there. How often a pair meets is counted; pairs that
meet often enough pass an estimate from the union of their sketches, and are held against each other as full sets.

Classes in a long list (large groups of near copies, or forms that differ in a few words) meet in the lists of
their rarest shingles instead, where the order is exact and the place where two sets meet bounds the overlap. A long list
gives few pairs first, a number of them in proportion to its length: with its first class, and between
neighbours in orders that put alike classes side by side. Only classes of it that these pairs leave in different
components are then held against each other, all of them.

How long a list is, is counted with partial sums before any list is gathered: a task only ever holds short
ones, and the rows of a long one are joined where they lie, dealt out by salt, or sorted by range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .runtime import marked, stored, tidy
from .words import SPACED, Texts, pieces, span_hashes, windows, words

SHINGLE = 5
#: Retained values of a sketch.
K = 128
#: The smallest of them that have inverted lists, the lists that a pair has to meet in, and the share of pairs at the threshold
#: that may have fewer values in common than ``common_values`` counts on.
LISTED, MEET, MISS = 32, 3, 1e-5
#: A list of up to so many classes gives all its pairs at once.
SHORT = 16
#: Orders in which neighbours in a long list are compared.
ORDERS = 4
#: A long list with more classes than this outside its main component is refined before its pairs are made: by the
#: ``DEEP``-th place where they meet.
FEW, DEEP = 64, 6
#: Estimates may fall short of the threshold by so many standard errors.
ERRORS = 4.5


def shingle_sets(texts: Texts) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    found = words(texts, SPACED)
    h, bounds = windows(span_hashes(texts.buf, found.start, found.end, fold=True), found.first, SHINGLE, True)
    return [np.unique(h[a:b]) for a, b in zip(bounds, bounds[1:])]


def common_values(threshold: float) -> int:
    """How many of ``LISTED`` values two sketches at the threshold share, but for ``MISS`` of the pairs: each of
    the union's smallest values is in both sets with the similarity's chance."""
    total, n = 0.0, 0
    while True:
        total += comb(LISTED, n) * threshold**n * (1 - threshold) ** (LISTED - n)
        if total > MISS:
            return max(1, n)
        n += 1


def needed(n: Column, threshold: float) -> Column:
    """The values that a set of ``n`` shingles shares with any partner, at least: counted where both sketches
    hold the whole sets."""
    return F.when(n <= floor(LISTED * threshold), F.ceil(F.round(F.lit(threshold) * n, 6))).otherwise(F.lit(common_values(threshold))).cast("int")


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of pairs of sketches (rows of ``K`` values, filled up with the largest), and the
    size of the union's sketch on which it stands: the share of that sketch's values that both have."""
    top = np.uint32(0xFFFFFFFF)
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    rank = np.cumsum(~again & (both != top), axis=1)  # of the distinct values
    size = np.minimum(rank[:, -1], K)
    return (again & (rank <= K)).sum(axis=1) / np.maximum(size, 1), size


def standard_errors(threshold: float, total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of the estimates from ``size`` values for pairs at the threshold, whose sets have ``total`` shingles
    together: drawn without replacement from the union, which that gives. None where the sketch holds all of it."""
    union = total / (1 + threshold)
    return np.sqrt(threshold * (1 - threshold) / np.maximum(size, 1) * np.clip((union - size) / np.maximum(union - 1, 1), 0, 1))


def _padded(sketches: list[bytes]) -> np.ndarray:
    out = np.full((len(sketches), K), 0xFFFFFFFF, np.uint32)
    for row, s in zip(out, sketches):
        values = np.frombuffer(s, "<u4")
        row[: len(values)] = values
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _pairs_of_short(rows: DataFrame, columns: list[str], keep) -> DataFrame:
    """``a < b``: the reps of all pairs of rows of one ``value`` for which ``keep`` (of the columns' values on
    either side) holds, once for each place where they meet. Lists have ``SHORT`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                now = [np.concatenate([k, c]) for k, c in zip(kept, now)]
            # the last list may go on in the next batch
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            kept = [c[cut:] for c in now]
            yield pairs([c[:cut] for c in now])
        if kept is not None:
            yield pairs(kept)

    def pairs(now: list[np.ndarray]) -> pa.RecordBatch:
        found = [_beside(now, step, keep) for step in range(1, SHORT)]  # rows of one list lie side by side
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    return rows.select("value", "rep", *columns).repartition("value").sortWithinPartitions("value", "rep").mapInArrow(run, "a long, b long")


def _beside(rows: list[np.ndarray], step: int, keep) -> tuple[np.ndarray, np.ndarray]:
    """The reps of rows that lie ``step`` apart in one list and fit."""
    of, rep, *more = rows
    i = np.flatnonzero(of[step:] == of[:-step])
    j = i + step
    ok = keep([m[i] for m in more], [m[j] for m in more]) & (rep[i] != rep[j])
    return np.minimum(rep[i], rep[j])[ok], np.maximum(rep[i], rep[j])[ok]


def _pairs_of_neighbours(members: DataFrame, keep) -> DataFrame:
    """``a < b``: the reps of rows of ``members`` (``value, rep, n, at``, and ``part`` of the set) that are neighbours
    in their list in one of ``ORDERS`` orders: by the smallest values of a set, in all its long lists, of one hash
    for each order, so that sets that share others of their rare shingles too lie side by side. Lists are sorted by range, so that a
    long one is several tasks' work."""
    own = members.groupBy("rep", "n", "part").agg(F.collect_list(F.struct("value", "at")).alias("own"))
    order = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), F.slice(F.array_sort(F.transform("own", lambda x, k=k: F.xxhash64(x["value"], F.lit(k)))), 1, 6).alias("order")) for k in range(ORDERS))))
    # of each list and order: the list stands first, so that its rows lie together
    rows = own.select("rep", "n", "own", order.alias("by")).select("rep", "n", F.explode("own").alias("x"), "by")
    rows = stored(rows.select(F.xxhash64("x.value", "by.turn").alias("value"), "by.order", "rep", "n", "x.at"), "orders")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if before is not None:
                now = [np.concatenate([k, c]) for k, c in zip(before, now)]
            before = [c[-1:] for c in now]
            a, b = _beside(now, 1, keep)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sorted_rows = rows.repartitionByRange("value", "order", "rep").sortWithinPartitions("value", "order", "rep")
    return sorted_rows.select("value", "rep", "n", "at").mapInArrow(run, "a long, b long")


def similar_links(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets have a similarity of ``threshold`` or more. ``sets``: rep, n, shingles.
    A class with many pairs is dealt out by salt, with a copy of its set for every 256 of them: a pair ships one
    set, and meets the other where it lies sorted before all its pairs."""
    per = 256
    salts = pairs.groupBy("a").agg((F.count("*") / per).cast("int").alias("salts"))
    left = sets.select(F.col("rep").alias("a"), "shingles").join(salts, "a").select("a", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    salted = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts") + 1).cast("int").alias("salt"), "b")
    right = salted.join(sets.select(F.col("rep").alias("b"), "shingles"), "b").select("a", "salt", "b", "shingles")
    percent = round(threshold * 100)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []  # the sets of the class whose pairs come now: one, or more where its id has several texts
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, salt, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                y = np.frombuffer(blob.as_buffer(), "<u8")
                if (a, salt) != group:
                    group, held = (a, salt), []
                if b is None:
                    held.append(y.copy())
                    continue
                for x in held:
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found[0].append(a)
                        found[1].append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    rows = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(verify, "a long, b long").distinct()


@tidy
def near_duplicates(docs: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of each row of ``docs``.

    A document's set: its distinct runs of five words (A-Z lower-cased), or all words as one if fewer;
    a null or empty text, or one without words, has none and is linked with nothing. Documents with a
    similarity of ``threshold`` (two decimals) or more are linked, but for at most 1e-5 of the pairs right
    at the threshold that meet in too few lists, and those below an estimate's 4.5 standard errors; ``component_id`` is the smallest id
    reachable, ``kept`` tells whether it is the document's own. Ids are integers. Rows of one id are one
    document with all their texts; rows with a null id are linked with nothing and kept. Very long texts are
    taken whole; an empty table gives no rows; other columns are not read.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0.5 and 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = TaskContext.get().partitionId() << 36
        for batch in batches:
            for texts in pieces(batch.column(1)):
                sets = shingle_sets(texts)
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets])
                first = np.concatenate([[0], np.cumsum([min(len(s), LISTED) for s in sets])])
                values = np.concatenate([np.zeros(0, np.uint64), *(s[:LISTED] for s in sets)])
                columns = [
                    batch.column(0).slice(texts.low, len(texts)), pa.array(np.arange(u, u + len(texts))), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), _signed(values)), pa.array([(s[:K] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                ]
                u += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "u", "n", "d1", "d2", "values", "sketch"])

    sketches = stored(rows.mapInArrow(sketch, "id long, u long, n long, d1 long, d2 long, values array<long>, sketch binary"), "sketches")
    known = sketches.where("n > 0 and id is not null")
    classes = known.groupBy("d1", "d2").agg(F.min(F.struct("id", "u")).alias("first"), F.count("*").alias("size"))
    classes = stored(classes.select("d1", "d2", F.col("first.id").alias("rep"), F.col("first.u").alias("u"), "size"), "classes")
    first = known.join(classes.select("u", "rep"), "u")  # one row of each class

    # lists of the retained values that classes share, and the rarest of each class's
    lists = stored(first.select(F.explode("values").alias("value"), "rep", "u", F.col("n").cast("int").alias("n")), "lists")
    sizes = lists.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    # values of one class alone come first of all in its order, so they only move the others on
    own, size = Window.partitionBy("u"), F.least("n", F.lit(LISTED))
    placed = lists.join(sizes, "value").withColumn("at", size - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "value")) - 1)
    prefix = stored(placed.where(F.col("at") < size - needed(F.col("n"), threshold) + MEET).select("value", "rep", "n"), "prefix")
    lengths = stored(prefix.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value", (F.col("n") > SHORT).alias("long_list")), "lengths")
    alike = lambda left, right: np.minimum(left[0], right[0]) >= threshold * np.maximum(left[0], right[0]) - 1e-6
    met = _pairs_of_short(prefix.join(lengths.where("not long_list"), "value"), ["n"], alike).groupBy("a", "b").agg(F.count("*").alias("met"))
    # pairs of small sets have fewer values to meet in; two classes that also meet in long lists are both dense
    least = prefix.groupBy("rep").agg(F.min(F.least(needed(F.col("n"), threshold), F.lit(MEET))).alias("least")).where(F.col("least") < MEET)
    met = met.join(least.withColumnsRenamed({"rep": "a", "least": "la"}), "a", "left").join(least.withColumnsRenamed({"rep": "b", "least": "lb"}), "b", "left")
    met = met.where(F.col("met") >= F.least(F.coalesce("la", F.lit(MEET)), F.coalesce("lb", F.lit(MEET)))).select("a", "b")
    dense = prefix.join(lengths.where("long_list"), "value").select("rep").distinct()
    sketch_of = first.select("rep", "sketch", "n")

    def estimated(found: DataFrame) -> DataFrame:
        """The pairs whose sketches speak for the similarity."""
        near = stored(found, "met").join(sketch_of.select(F.col("rep").alias("a"), F.col("sketch").alias("left"), F.col("n").alias("m")), "a").join(sketch_of.select(F.col("rep").alias("b"), F.col("sketch").alias("right"), "n"), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2_000):
                    part = batch.slice(at, 2_000)
                    share, size = estimates(_padded(part.column(2).to_pylist()), _padded(part.column(3).to_pylist()))
                    keep = pa.array(share >= threshold - ERRORS * standard_errors(threshold, part.column(4).to_numpy() + part.column(5).to_numpy(), size) - 1e-9)
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

        return stored(near.select("a", "b", "left", "right", "m", "n").mapInArrow(run, "a long, b long").distinct(), "pairs")

    pairs = estimated(met)
    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct().withColumn("dense", F.lit(False))
    wanted = wanted.unionByName(dense.withColumn("dense", F.lit(True))).groupBy("rep").agg(F.max("dense").alias("dense"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(2)):
                sets = shingle_sets(texts)
                part = batch.slice(texts.low, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["rep", "dense", "n", "part", "shingles"])

    wanted = stored(wanted, "wanted")
    some = marked(rows.withColumnRenamed("id", "rep"), "rep", wanted.select("rep"), "likely").where("likely").drop("likely")
    sets = some.join(wanted, "rep").select("rep", "dense", "text").mapInArrow(full, "rep long, dense boolean, n long, part long, shingles binary")
    sets = stored(sets.where("n > 0").dropDuplicates(["rep", "n", "part"]), "sets")  # repeated rows are one set

    meeting, long_lists, prefix_of = _rarest(sets.where("dense"), threshold)
    links = similar_links(sets, stored(pairs.unionByName(estimated(meeting.distinct())).distinct(), "pairs"), threshold)
    # an id with several texts ties their classes together
    several = known.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low <> high").select("id")
    tied = known.join(several, "id").join(classes, ["d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = stored(links.unionByName(tied), "links")
    reached = stored(components(links), "components")
    # what is left of the long lists: few pairs of each class first, so that most need no more, and in the end all
    left = estimated(_left_over(long_lists, prefix_of, reached, threshold))
    for most in (4, 64, None):
        left = _apart(left, reached)
        if left.isEmpty():
            break
        now = left if most is None else left.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))).where(F.col("turn") <= most).drop("turn")
        now = stored(now, "turn")
        links = stored(links.unionByName(similar_links(sets, now, threshold)), "links")
        reached = stored(components(links), "components")
        left = left.join(now, ["a", "b"], "left_anti")

    of_class = classes.join(reached.withColumnsRenamed({"node": "rep"}), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("id", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))


def _rarest(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs ``a, b`` of classes that share one of their rarest shingles where that leaves room for the
    similarity: all of a short list; of a long one, those with its first class and those of neighbours. The
    long lists: ``value, rep``, the set's size ``n`` and the shingle's place ``at`` in it, ``part`` of the set, the list's ``length``.
    And the same of all shingles that are among the rarest, and of the ``DEEP - 1`` next of each set."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                of = [np.frombuffer(s, "<i8") for s in part.column(1).to_pylist()]
                size = np.array([len(s) for s in of], np.int64)
                rep, own = (np.repeat(part.column(c).to_numpy(), size) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate([np.zeros(0, np.int64), *of])), pa.array(np.repeat(size, size)), pa.array(own)], names=["rep", "value", "n", "part"])

    spelled = stored(sets.select("rep", "shingles", "part").mapInArrow(spread, "rep long, value long, n long, part long"), "shingles")
    shared = spelled.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    known = spelled.join(shared, "value")
    of_set = Window.partitionBy("rep", "n", "part")
    # shingles of this class alone come first of all, so they only move the others on
    alone = F.col("n") - F.count("*").over(of_set)
    placed = known.select("rep", "value", "n", "part", (alone + F.row_number().over(of_set.orderBy("df", "value")) - 1).alias("at"))
    last = F.col("n") - F.ceil(F.round(F.lit(threshold) * F.col("n"), 6))
    deep = stored(placed.where(F.col("at") < last + DEEP), "prefix")
    prefix = deep.where(F.col("at") <= last)

    lengths = stored(prefix.groupBy("value").agg(F.count("*").alias("length"), F.min(F.struct("at", "rep", "n")).alias("first")).where("length > 1"), "lengths")
    fit = lambda left, right: _fit_arrays(*left, *right, threshold)
    short = _pairs_of_short(prefix.join(lengths.where(F.col("length") <= SHORT), "value"), ["n", "at"], fit)
    long_lists = stored(prefix.join(lengths.where(F.col("length") > SHORT), "value"), "members")
    starred = long_lists.where(F.col("rep") != F.col("first.rep")).where(_fit_columns(F.col("n"), F.col("at"), F.col("first.n"), F.col("first.at"), threshold))
    starred = starred.select(F.least("rep", "first.rep").alias("a"), F.greatest("rep", "first.rep").alias("b"))
    return short.unionByName(starred).unionByName(_pairs_of_neighbours(long_lists, fit)), long_lists.drop("first"), deep


def _fit_arrays(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles that meet first at places ``at`` and ``bt`` of their orders can
    have the similarity: what is left of either must hold the overlap that it takes."""
    need = threshold / (1 + threshold) * (n + m) - 1e-6
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6) & (np.minimum(n - at, m - bt) >= need)


def _fit_columns(n: Column, at: Column, m: Column, bt: Column, threshold: float) -> Column:
    """``_fit_arrays`` of columns."""
    need = threshold / (1 + threshold) * (n + m) - 1e-6
    return (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6) & (F.least(n - at, m - bt) >= need)


def _apart(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of different components."""
    for side in ("a", "b"):
        pairs = pairs.join(reached.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    return stored(pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "apart")


def _left_over(lists: DataFrame, prefix: DataFrame, reached: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` within long lists that are in different components and fit each other, ``a`` outside the
    component that has most of the list: the classes of a list outside it against all of the list, its rows dealt out by salt.

    A list with more than ``FEW`` of them falls into lists of those that meet again, at the ``DEEP``-th shingle that they share: two sets of
    the similarity share as many among their rarest and the next few, so that nothing is lost."""
    per = 1_000
    known = lists.join(reached.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = stored(known, "members")
    parts = known.groupBy("value", "component").agg(F.count("*").alias("n"))
    homes = parts.groupBy("value").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    homes = stored(homes.select("value", F.col("most.component").alias("home"), (F.col("all") - F.col("most.n") > FEW).alias("many")), "homes")
    of = known.join(homes, "value")
    # sets that may share fewer than DEEP shingles are held against each other as they are
    small = F.ceil(F.round(F.lit(threshold) * F.col("n"), 6)) < DEEP
    plain = of.where(~F.col("many") | small).withColumn("key", F.col("value"))
    own = prefix.select("rep", "n", "part", F.struct(F.col("value").alias("next"), F.col("at").alias("next_at")).alias("x"))
    again = of.where("many").join(own, ["rep", "n", "part"]).where(F.col("x.next_at") >= F.col("at") + DEEP - 1)
    again = again.withColumn("key", F.xxhash64("value", "x.next")).drop("x")
    rows = stored(plain.unionByName(again).select("key", "rep", "n", "at", "component", (F.col("component") != F.col("home")).alias("apart")), "refined")
    lengths = rows.groupBy("key").agg(F.count("*").alias("length"), F.max("apart").alias("some")).where("length > 1 and some")
    rows = rows.join(lengths.select("key", (F.col("length") / per).cast("int").alias("salts")), "key")
    left = rows.where("apart").withColumn("salt", F.explode(F.sequence(F.lit(0), "salts"))).select("key", "salt", *(F.col(c).alias(f"{c}_") for c in ("rep", "n", "at", "component")))
    right = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts") + 1).cast("int"))
    both = left.join(right, ["key", "salt"]).where(F.col("component") != F.col("component_"))
    both = both.where(_fit_columns(F.col("n"), F.col("at"), F.col("n_"), F.col("at_"), threshold))
    # of two that are both outside, one pair is enough
    return both.where(~F.col("apart") | (F.col("rep_") < F.col("rep"))).select(F.col("rep_").alias("a"), F.col("rep").alias("b")).distinct()
