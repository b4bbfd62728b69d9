"""What the corpus operators share: scratch tables, shipping code, Arrow slices, row numbers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of characters that are none of these (tab to carriage return, and space).
WORD_GAP = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an error,
    since a folder of one machine would not be seen by the others.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="furrow-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/furrow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage: later jobs neither repeat the work nor lose it with an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows in an Arrow batch while an operator's own job runs: texts are long, and batches lie outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results not yet written need theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/furrow-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="furrow-code-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "furrow_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, holds: str = "") -> DataFrame:
    """``mapInArrow`` with this package present on the executors. ``holds``: the operator whose ``held`` tables the function needs."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycle_search(), room_for(holds):
            yield from function(batches)

    return df.mapInArrow(run, schema)


_held: dict[tuple, object] = {}


def held(kind: str, key: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker from task to task; a worker keeps that of one operator at a time."""
    if (kind, key) not in _held:
        if _held:
            let_go()
        _held[kind, key] = make()
    return _held[kind, key]


@contextmanager
def room_for(holds: str) -> Iterator[None]:
    """A task's run in a worker: without what other operators held there, and without spare Arrow memory afterwards."""
    if any(kind != holds for kind, _ in _held):
        let_go()
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()


def let_go() -> None:
    """Drop what is held and give its memory back to the system, for the next operator in this worker."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Without the search for reference cycles, which walks large tables again and again where no cycles are made."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a text column's bytes stay near a bound; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """The number of words, without building the array of all of them twice. (``$`` would also match before a last line end like U+0085.)"""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WORD_GAP}|{WORD_GAP}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def partitions_for(df: DataFrame, most_bytes: int = 64 << 20) -> int:
    """Partitions for a shuffle of whole rows: the session's number, or more if the plan's size in bytes, where known, asks for them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // most_bytes) if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(50_000, wanted))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def with_position(df: DataFrame, keys: list[str], order: list[Column], salt: Column, name: str, salts: int = 256) -> DataFrame:
    """Number the rows of every key from 0 without gaps, in ``salts`` pieces each, so that no key meets in one task.

    Rows are ordered by (salt, order) within a key; ``salt`` is a whole number from 0 to ``salts`` - 1, or an
    expression that the order starts with. ``order`` must tell all rows of a piece apart for a repeatable result.
    The piece sizes are a table of keys times salts; their running sums need one row of each piece only.
    """
    piece = df.withColumn("_salt", salt)
    per_piece = Window.partitionBy(*keys, "_salt").orderBy(*order)
    counts = piece.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    for k in [*keys, "_salt"]:
        starts = starts.withColumnRenamed(k, f"_k_{k}")
    numbered = piece.withColumn("_at", F.row_number().over(per_piece).cast("long") - 1)
    same = None
    for k in [*keys, "_salt"]:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = c if same is None else same & c
    return numbered.join(starts, same, "left").withColumn(name, F.col("_start") + F.col("_at")).drop("_at", "_start", "_salt", *[f"_k_{k}" for k in [*keys, "_salt"]])
