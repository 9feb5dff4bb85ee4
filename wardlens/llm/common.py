"""Shared helpers of the ``llm`` operators: reading, word rules, tables cut to the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words: runs of digits, letters and everything beyond ASCII (after lower-casing A-Z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the near-duplicate operators: runs without white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: ``str.translate`` table that lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Broadcast hints are given to sides of at most so many bytes; beyond it, they are shuffled.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    named = "file://" + tempfile.mkdtemp(prefix="wardlens-llm-", dir=os.environ.get("TMPDIR") or "/tmp")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class Scratch:
    """The tables that :func:`cut` writes inside a ``with`` block; at its end all are removed but those that are kept.

    What leaves the block must be kept or must not read the others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _SCRATCH.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, which :func:`cut` has returned, stays; an enclosing block decides on it."""
        self.paths.remove(df.cut_path)
        outer = [s for s in _SCRATCH if s is not self]
        if outer:
            outer[-1].paths.append(df.cut_path)
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in tables:
            self.paths.remove(df.cut_path)
            self._delete(df.cut_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *_) -> None:
        _SCRATCH.remove(self)
        for path in self.paths:
            self._delete(path)


_SCRATCH: list[Scratch] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: one computation, no lineage, safe from lost executors.

    Inside a :class:`Scratch` block it is removed at the block's end, unless kept.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].paths.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def row_bytes(df: DataFrame) -> Column:
    """How many bytes a row takes, about: 8 for a number, texts and nested values by their length."""
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
            size = size + 16 + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if the sum of its rows' sizes proves it small, else as it is (a shuffle join then).

    ``df`` should come from :func:`cut`, so that measuring it is cheap.
    """
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` is faster and does the same where all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words (:data:`WORD`) of a text as an array; empty for null.  Splitting at the other characters is much faster than extraction."""
    return F.array_remove(F.split(lower_ascii(text), WORD.replace("^", "")), "")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 2 MB, so that very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of up to ``rows`` rows (and 2 MB) for what is computed inside the block; for narrow rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose ``work`` yields dicts of columns (lists, numpy or Arrow arrays) with the names of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in work(batches):
            columns = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return df.mapInArrow(run, out)


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay beside the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """:func:`map_arrow` over columns as Python lists."""
    return map_arrow(df, lambda batches: work(b.to_pydict() for b in batches), schema)


class Memo(dict):
    """A dict of strings that fills itself by ``make(key)``.

    It stays bounded: keys over ``chars`` long are not kept, and at ``most``
    entries it starts afresh from ``start``.
    """

    def __init__(self, make: Callable | None = None, most: int = 300_000, start: dict | None = None, chars: int = 64):
        """Without ``make``, a subclass has it as a method (a function that refers to the dict would keep it alive)."""
        super().__init__(start or {})
        self.most, self.start, self.chars = most, start or {}, chars
        if make:
            self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.most:
                self.clear()
                self.update(self.start)
            self[key] = value
        return value
