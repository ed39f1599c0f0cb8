"""What the text operators share: shared-folder tables, word rules and Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of one word; the same words as bytes.split() without arguments.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/checkpoints/millrace-{spark.sparkContext.applicationId}"
    raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")


#: Rows and bytes that a map takes at once; a longer row goes alone.
SLICE, SLICE_BYTES = 512, 1 << 20
#: Held while a table is written: its shuffle files go with the plan, and batches for Python are of a few slices, since a task holds a whole one on either side.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(4 * SLICE),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * SLICE_BYTES),
}


class Scratch:
    """Tables written to the shared folder in place of long lineage.

    cut() runs a plan once, writes it as Parquet and returns a reader of the
    files, so a lost executor costs a re-read and no recomputation. The plan's
    shuffle files go as soon as its table is written. drop() removes tables that
    no later step reads; those behind a result are named by result(), for
    release() to remove when it has been written. What is left goes with the
    folder, which belongs to the cluster, as with checkpoint().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.live = 0, set()

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        conf = self.spark.conf
        before = {name: conf.get(name, None) for name in _WRITING}
        try:
            for name, value in _WRITING.items():
                conf.set(name, value)
            df.write.parquet(path)
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)
        self.live.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._millrace_path)

    def result(self, df: DataFrame) -> DataFrame:
        """df, which reads tables of this scratch."""
        df._millrace_scratch = self
        return df

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.live.discard(path)


def release(df: DataFrame) -> None:
    """Removes the tables that a result was read from, when it has been written elsewhere."""
    if scratch := getattr(df, "_millrace_scratch", None):
        for path in list(scratch.live):
            scratch._delete(path)


class Kept(dict):
    """A table of a function's results, of bounded size: kept[key] is f(key).

    When `most` results have come in, those that were not asked for since the
    last time are let go. Keys longer than `chars`, if given, are worked out each time.
    """

    def __init__(self, f: Callable, most: int, chars: int | None = None):
        self.f, self.most, self.chars, self.old = f, most, chars, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.f(key)
            if self.chars is not None and len(key) > self.chars:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null as empty) and the named columns; whatever else the table has is left behind."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """docs with columns named c0, c1, ..., whatever their names are, and those that the operators read by their names."""
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return out, {n: F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text", "source") if n in docs.columns}


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most SLICE rows and, but for single rows, SLICE_BYTES of texts."""
    size = np.ones(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(column.type):
            size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = min(at + SLICE, max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., dict]]) -> DataFrame:
    """mapInArrow over columns as Python lists.

    start() runs once a task and returns a function from the batch's columns
    (lists, in df's order) to the columns of the result.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(f(*(part.column(c).to_pylist() for c in range(len(names)))), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows of df for which a function of one column, taken as a list, says true. No row moves."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            kept = [x for part in slices(batch.select([at])) for x in f(part.column(0).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(run, df.schema)
