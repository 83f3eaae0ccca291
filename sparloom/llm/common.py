"""What the operators of this folder share: table access, lineage cuts, Arrow row streams."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only for a local master: on a cluster a
    machine-local folder would lose data, so the missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = getattr(spark, "_sparloom_shared", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = "file://" + tempfile.mkdtemp(prefix="sparloom-shared-")
        spark._sparloom_shared = made
    return made


#: Bytes of rows that go to a Python worker at a time; texts are long, and 10,000 of them are much for it.
BATCH_BYTES = "4m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, actions send rows to Python workers in batches of some BATCH_BYTES; after it as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, said)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    For what an operator hands back, since nobody knows when that has been read for the last time: Spark
    deletes the files when the frame is no longer reachable, if ``spark.cleaner.referenceTracking.
    cleanCheckpoints`` is on, as it is in sessions that ``sparloom.session`` builds.  Steps on the way are
    tables of a ``Scratch``.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with small_batches(spark):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables in the shared folder that cut the lineage, as compressed Parquet.

    A table goes by ``drop`` once it has been read for the last time, the others when the ``with`` block ends,
    by an error too.  What leaves the block is pinned with ``cut`` first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.made = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete_path(self.spark, self.folder)

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_path(self.spark, table._scratch_path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


#: Rows of one digest column that may be broadcast: some 60 MB.
MAX_BROADCAST_KEYS = 1_000_000


def row_key(id_col: str, text_col: str) -> Column:
    """A row's identity: 16 bytes of digest over id and text.  Ids may be null or repeat; rows that are equal in
    both can't be told apart, and no operator decides differently about them."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), text_of(text_col)).cast("binary")))


def few(keys: DataFrame) -> DataFrame:
    """Marked for broadcast if they have been counted and are few; else joins with them are ordinary ones."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose row key isn't in the one column of ``gone``, which has no repeats."""
    key = free_name(docs, "_gone")
    return docs.join(few(gone.toDF(key)), row_key(id_col, text_col) == F.col(key), "left_anti")


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, so that functions pickled by name are found there
    even where it isn't installed or on the path."""
    if getattr(spark.sparkContext, "_sparloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="sparloom-")) / "sparloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._sparloom_shipped = True


_KEPT: dict[str, object] = {}


def kept_by_worker(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one large thing at a time.  Asking for another lets the one
    before go, so a worker that serves several operators in turn needs no more memory than one that serves one."""
    if name not in _KEPT:
        let_go()
        _KEPT[name] = make()
    return _KEPT[name]


def let_go() -> None:
    """What the worker keeps goes, and the memory of it back to the machine: small pieces that are freed stay with
    the process otherwise."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keeping_nothing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for workers that may have served an operator which keeps something: that goes first.  Workers outlive
    stages, so a step without use for it would else have the memory of both."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)

    return alone


def range_count(df: DataFrame, size: int = 64 << 20) -> int:
    """Ranges of some ``size`` bytes by the planner's estimate of ``df``, at least as many as a shuffle has
    partitions.  Beyond 8,192 ranges their number grows with the root of the estimate, and so does their size: some
    900 MB for 100 TB.  The number decides how large tasks are, nothing else."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not 0 < estimate < 1 << 60:
        return least
    n = -(-estimate // size)
    return max(least, n if n <= 8192 else math.isqrt(8192 * n))


def range_bounds(df: DataFrame, key: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` quantiles of a column of whole numbers, in order, without repeats.

    They only decide how even the ranges are.  Asking for them reads one column; a range partitioning would
    run whatever precedes it twice, once for its sample.
    """
    cuts = [i / ranges for i in range(1, ranges)]
    if not cuts:
        return []
    return sorted(set(df.agg(F.percentile_approx(F.col(key).cast("long"), cuts, min(20 * ranges, 1_000_000)).alias("q")).first()["q"] or []))


def arrow_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, chunk: int = 2048, keeps: bool = False) -> DataFrame:
    """Stream the rows of each partition through ``fn`` (tuples in, tuples out) in Arrow batches.  ``keeps``: it
    uses ``kept_by_worker``.

    ``fn`` sees one iterator per partition, so it may keep state that is bounded by itself (caches, a
    current group); nothing here gathers a partition.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    yield from zip(*[c.to_pylist() for c in part.columns], strict=True)

        held: list[tuple] = []
        size = 0
        for row in fn(rows()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
            if len(held) >= chunk or size >= 8 << 20:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run if keeps else keeping_nothing(run), schema)


def text_chunks(batches: Iterable[pa.RecordBatch], rows: int = 1024, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, texts in the last column, in slices of a bounded number of rows and bytes (a longer text is
    a slice of its own); empty ones are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, total = 0, 0
        sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
        for i, n in enumerate(sizes):
            if i > at and (i - at >= rows or total + n > size):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
