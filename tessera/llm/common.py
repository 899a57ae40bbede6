"""What the corpus operators share: the shared working folder, written tables, input columns and tokenizers."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents whose crc32(doc_id as text) has remainder 0 by this number are held out from learning.
FOLDS = 5


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a temporary one, and any other an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-work-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


#: For each scratch() that is open here, outermost first, the tables written in it.
SCRATCH: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())
#: Shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that materialize() writes inside, but those it was told to keep; nothing lazy inside may outlive it.

    A kept table belongs to the scratch() around this one, and without one to the caller.
    """
    mark = SCRATCH.set((*SCRATCH.get(), []))
    try:
        yield
    finally:
        *_, own = SCRATCH.get()
        SCRATCH.reset(mark)
        for path in own:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def place_for(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder; what is written there goes with the scratch() that it belongs to."""
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    owners = SCRATCH.get()[: -1 if keep else None]
    if owners:
        owners[-1].append(path)
    return path


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and readable after any executor is lost."""
    spark = df.sparkSession
    path, before = place_for(spark, label, keep), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns; others, whatever their names, never get further."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def held_out() -> F.Column:
    """Whether a row's label is for testing only."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0


def size_in_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of the files that df reads, or of a column where Catalyst knows of no files. Only ever used to choose how finely to deal rows out."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return known if known < 1 << 60 else df.agg(F.sum(F.octet_length(column))).collect()[0][0] or 0


def raw(column) -> list:
    """An Arrow string column as bytes objects, without decoding; None for null."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct `row`, so that no column added beside it can clash with one of its own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def text_of(rows, field: str = "text"):
    """A field of an Arrow column of packed rows."""
    return rows.field(rows.type.get_field_index(field))
