"""What the operators of this subpackage share: reading tables, the shared folder, row keys."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a maximal run of characters other than these (space and \x09-\x0D).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch; Spark's own default is ten times as many, and a worker holds several copies of one.
ARROW_ROWS, DEFAULT_ROWS = 1000, "10000"


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has a size of its own. For queries and pipelines; operators leave settings alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder named in spark.checkpoint.dir, or a temporary one in local mode only."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    ensure_shared_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so a lost executor costs no recomputation of what came before."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def named(column: str) -> Column:
    """The column of that name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def plain_text(column: str | Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(named(column) if isinstance(column, str) else column, F.lit(""))


def replacing(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names the caller is about to add (names compare without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, for the batches of a task; what it used is given back to the system at its end, as workers live on for other tasks."""

    @wraps(run)
    def whole(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def with_arrays(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]], added: list[StructField], keep: int | None = None) -> DataFrame:
    """The first `keep` columns of df (all by default) and those that run adds to each batch. Columns go by place, so their names may
    hold any signs."""
    count = len(df.columns) if keep is None else keep
    inner = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*df.schema.fields[:count], *added])])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, more in run(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:count], *more], names=inner.names)

    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(lean(whole), inner)
    return out.toDF(*df.columns[:count], *[f.name for f in added])
