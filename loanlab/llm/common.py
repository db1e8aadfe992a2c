"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import pickle
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_AT_ONCE = 256  # rows held as Python objects at a time


def ship(module: str) -> None:
    """Send the module's functions inside the tasks: executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def worker_slot(key: tuple, make: Callable):
    """What ``make()`` gives, kept in the Python worker so that it outlasts one task.

    A worker keeps one such thing: another key drops the last one first, so tables and memos
    of operators that run after each other do not add up.
    """
    name = "loanlab_llm_worker_slot"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if held.get("key") != key:
        held.pop("value", None)
        gc.collect()  # an encoder and its memos refer to each other: dropped alone they would stay a while
        held["value"], held["key"] = make(), key
    return held["value"]


class Shared:
    """A broadcast of any object of this package, for executors that do not have the package.

    A plain broadcast names the object's class; this one carries it.
    """

    def __init__(self, spark, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        """The object; made anew at each call, so take it once per task."""
        return pickle.loads(self.sent.value)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def kept(keep: Iterable[str], made: Iterable[str]) -> list[str]:
    """The kept columns; one that has the name of a result column gives way to it."""
    made = {m.lower() for m in made}
    return [k for k in dict.fromkeys(keep) if k.lower() not in made]


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: inside, columns go by position."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain)
    return out.toDF(*schema.names)


def batch_of(arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])


def map_texts(df: DataFrame, text: str, keep: Iterable[str], made: str,
              start: Callable[[], Callable[[list[str]], list[list]]]) -> DataFrame:
    """Kept columns plus the columns ``made`` (a DDL string), computed from whole texts.

    ``start()`` runs once per task and returns a function from a few texts to one list per
    made column. Rows are taken a few at a time, so memory follows the longest texts only.
    """
    result = T.StructType.fromDDL(made)
    keep = kept(keep, result.names)
    inner = df.select(*[col(k) for k in keep], text_of(text).alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], *result.fields])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        work = start()
        kinds = [to_arrow_type(f.dataType) for f in result.fields]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                made_now = work(part.column(width).to_pylist())
                arrays = [part.column(i) for i in range(width)]
                arrays += [pa.array(v, type=k) for v, k in zip(made_now, kinds)]
                yield batch_of(arrays)

    return map_arrow(inner, run, schema)


def flat_map_texts(df: DataFrame, text: str, keep: Iterable[str], made: str,
                   start: Callable[[], Callable[[list[str]], tuple]]) -> DataFrame:
    """As ``map_texts``, with any number of rows per text.

    ``start()`` returns a function from a few texts to (row numbers, one array per made column).
    """
    result = T.StructType.fromDDL(made)
    keep = kept(keep, result.names)
    inner = df.select(*[col(k) for k in keep], text_of(text).alias("_text"))
    schema = T.StructType([*inner.schema.fields[:-1], *result.fields])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        work = start()
        kinds = [to_arrow_type(f.dataType) for f in result.fields]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows, made_now = work(part.column(width).to_pylist())
                rows = pa.array(rows, type=pa.int64())
                arrays = [part.column(i).take(rows) for i in range(width)]
                arrays += [pa.array(v, type=k) for v, k in zip(made_now, kinds)]
                yield batch_of(arrays)

    return map_arrow(inner, run, schema)
