"""Session helpers: the shared scratch folder and tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

T = TypeVar("T")

#: Folders made so far by the operators that now run, the innermost last.
_made: ContextVar[list[list[str]]] = ContextVar("made", default=[])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made.get():
        _made.get()[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later stages start from files that outlive any executor, and the work above runs once.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(operator: Callable[..., T]) -> Callable[..., T]:
    """``operator``, which deletes the scratch folders of its run but for those that its result still reads (none where that is no
    table). What it leaves behind belongs to the operator that called it, if that is tidy too."""

    @wraps(operator)
    def run(*args, **more) -> T:
        mine: list[str] = []
        token, out = _made.set([*_made.get(), mine]), None
        try:
            out = operator(*args, **more)
            return out
        finally:
            _made.reset(token)
            read = [f.partition("/part-")[0] for f in out.inputFiles()] if isinstance(out, DataFrame) else []
            kept = {path for path in mine if any(uuid_of(path) in f for f in set(read))}
            for path in set(mine) - kept:
                delete(path)
            if _made.get():
                _made.get()[-1].extend(kept)

    return run


def dropped(df: DataFrame) -> None:
    """Delete the folders under the shared one that ``df`` reads: it has served."""
    shared = shared_dir(df.sparkSession)
    for folder in {f.partition("/part-")[0] for f in df.inputFiles()}:
        if f"/{folder.rpartition('/')[0].partition(':')[2].strip('/')}".endswith(f"/{shared.partition(':')[2].strip('/') if ':' in shared else shared.strip('/')}"):
            delete(folder)


def uuid_of(path: str) -> str:
    return path.rpartition("-")[2]


def delete(path: str) -> None:
    session = SparkSession.getActiveSession()
    if session is not None:
        place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Longs of the bit table in ``marked``: a proven bound for its broadcast, some tens of MB with the hash table's
#: overhead, whatever the input.
TABLE_LONGS = 1 << 19


def marked(df: DataFrame, id_col: str, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: false only where ``id_col`` is surely not among ``ids`` (one
    column).

    A bit table over hashes of the ids, of ``TABLE_LONGS`` longs at most, is broadcast. Where few rows of
    wide ones are wanted, only these (and some more, the table being full) have to be shuffled afterwards. Of 100
    million ids and more nearly all bits are set: then every row is marked, and all are shuffled, which costs time but changes nothing.
    """
    of = ids.columns[0]

    def places(column: str) -> tuple[Column, Column]:
        h = F.xxhash64(F.col(column))
        return F.pmod(h, F.lit(TABLE_LONGS)).cast("int"), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")

    at_, bit_, bits_ = (free_name(df, n) for n in ("at", "bit", "bits"))
    at, bit = places(of)
    table = ids.select(at.alias(at_), bit.alias(bit_)).groupBy(at_).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit_})")).alias(bits_))
    at, bit = places(id_col)
    found = df.withColumns({at_: at, bit_: bit}).join(F.broadcast(table), at_, "left")
    likely = F.coalesce(F.expr(f"({bits_} & shiftleft(1L, {bit_})) <> 0"), F.lit(False))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), likely.alias(name))
