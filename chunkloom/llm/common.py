"""What the operators of this subpackage share: staged tables and small expressions."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts of the word operators count it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="chunkloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset and the
    master is this one process, a temporary folder; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chunkloom-{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of few rows for what runs within, so that those in flight between the JVM and
    Python, which lie outside the heap, stay small where texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor
    costs no more than the tasks that it had."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        # the job's end is the end of the call, so no file has to mark it
        df.write.option("compression", compression).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, walked: bool = False) -> DataFrame:
    """df in an eighth of the shuffle's partitions, eight at least, for tables that are small beside what they
    were made from: else each of many tasks writes a file of a few rows. walked: what makes df is heavy
    work, so it stays spread out and only its rows are dealt anew."""
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return df.repartition(n) if walked else df.coalesce(n)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, for mapInArrow, that trims as it ends: workers are used again by later stages, and what one
    stage had freed would stay with them."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


def kind_of(df: DataFrame, c: str = "doc_id") -> str:
    return df.schema[c].dataType.simpleString()


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, so that what Python holds of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def boxed(docs: DataFrame, row: Column) -> DataFrame:
    """d: docs' columns in one struct, so that no name of theirs meets ours; id: its doc_id; row: of the
    columns of docs, what tells texts apart."""
    one = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    return docs.select(one, F.col("doc_id").alias("id"), row.alias("row"))


def numbered(df: DataFrame) -> DataFrame:
    """df with plain column names by place: mapInArrow takes no names with a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def once(box: DataFrame) -> DataFrame:
    """Of boxed rows alike in id and row, the one whose other columns have the smallest digest."""
    others = [F.col(f"d.`{c}`") for c in box.schema["d"].dataType.names if c not in ("doc_id", "text")]
    tie = F.md5(F.to_json(F.struct(*others)).cast("binary")) if others else F.lit("")
    nth = F.row_number().over(Window.partitionBy("id", "row").orderBy(tie))
    return box.withColumn("nth", nth).where("nth = 1").drop("nth")


def replaced(d: Column, docs: DataFrame, text: Column, changed: Column) -> Column:
    """The struct d with another text, and n_chars, where there is one, counted anew where changed."""
    out = d.withField("text", text)
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(d["n_chars"]))
    return out


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
