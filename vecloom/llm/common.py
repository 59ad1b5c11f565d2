"""Shared plumbing of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of a batch that a kernel takes at once.
STEP = 1_024


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df that don't clash with names; Spark's names ignore case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def worker_store(name: str) -> dict:
    """A dict that the tasks of one operator in a Python worker share, until a task of another operator comes there."""
    module = sys.modules.setdefault("_vecloom_worker", types.ModuleType("_vecloom_worker"))
    stores = module.__dict__.setdefault("stores", {})
    return stores.setdefault(name, {})


def settle(name: str = "") -> None:
    """Drops what tasks of other operators than this one left in the worker, and gives memory that is free back to the system."""
    module = sys.modules.get("_vecloom_worker")
    stores = module.__dict__.get("stores", {}) if module else {}
    for other in [n for n in stores if n != name]:
        stores.pop(other).clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable, name: str = "") -> Callable:
    """run, a function of batches, in a worker that is settled before and after."""

    def tidied(batches):
        settle(name)
        try:
            yield from run(batches)
        finally:
            settle(name)

    tidied.__annotations__ = dict(run.__annotations__)
    return tidied


def column(of: str | Column) -> Column:
    """A column by its name, whatever characters that has, or as it is."""
    return of if isinstance(of, Column) else F.col(f"`{of}`")


def with_computed(df: DataFrame, inputs: list[str | Column], outputs: str, make_kernel: Callable[[], Callable], name: str = "") -> DataFrame:
    """df with added columns that an Arrow kernel computes from the inputs (names or columns).

    make_kernel() runs once a task and returns a function from one Arrow array per
    input to one per output field. Columns of df that clash with an output's name
    are replaced. Only the inputs go to Python, and only what is computed comes back; it is computed
    once, whatever is filtered later. Kernels work on STEP rows at a time, and what they give is handed on at once. name: of the worker's store that the kernel uses.
    """
    added = T._parse_datatype_string(outputs)
    keep = without(df, added.names)
    names = added.names
    one = len(inputs) == 1

    def computed(batches):
        kernel = None
        for batch in batches:
            columns = (batch,) if one else batch
            kernel = kernel or make_kernel()
            for at in range(0, len(columns[0]), STEP):
                yield pa.StructArray.from_arrays(kernel(*(c.slice(at, STEP) for c in columns)), names=names)

    computed.__annotations__ = {"batches": Iterator[pa.Array] if one else Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    out = "__computed"
    while out in (c.lower() for c in df.columns):
        out += "_"
    udf = F.arrow_udf(tidy(computed, name), added).asNondeterministic()
    return df.withColumn(out, udf(*map(column, inputs))).select(*(F.col(f"`{c}`") for c in keep), *(F.col(out)[c].alias(c) for c in names))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; a temporary one is set only where none is set."""
    return f"{shared_root(spark)}/vecloom-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = path.get() if path.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='vecloom-checkpoints-')}")
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: its lineage ends there."""
    spark = df.sparkSession
    shared_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
