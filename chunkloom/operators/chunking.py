"""Files to chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gear


def chunk_table(files: DataFrame, file: str, content: str, target: int = gear.TARGET, table=None, keep_content: bool = False) -> DataFrame:
    """file, chunk_ord, offset, length, chunk_key (SHA-256) of a binary column's content-defined
    chunks, and chunk if asked for. One pass over Arrow batches: a file is cut once, no chunk carries
    its file's bytes, and rows leave as they are made. Null and empty contents have no chunks."""
    numbers = gear.default_table() if table is None else table
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_content
    names = ["file", "chunk_ord", "offset", "length", "chunk_key"] + ["chunk"] * keep_content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                ends = gear.cuts(data, target, numbers) if data else []
                # at most some 64 MiB of chunks to a batch
                step = max(1, (64 << 20) // (2 * target))
                for at in range(0, len(ends), step):
                    upto = ends[at : at + step]
                    starts = [ends[at - 1] if at else 0, *upto[:-1]]
                    parts = [data[x:y] for x, y in zip(starts, upto)]
                    cols = [range(at, at + len(upto)), starts, [y - x for x, y in zip(starts, upto)], [hashlib.sha256(p).hexdigest() for p in parts], parts]
                    key = pa.array([b.column(0)[i].as_py()] * len(upto), b.column(0).type)
                    yield pa.RecordBatch.from_arrays([key, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    kind = files.schema[file].dataType.simpleString()
    schema = f"file {kind}, chunk_ord long, offset long, length long, chunk_key string" + ", chunk binary" * keep_content
    return files.select(F.col(file).alias("file"), F.col(content).alias("content")).mapInArrow(run, schema)


def line_chunks(files: DataFrame, file: str, text: str) -> DataFrame:
    """Chunks given by a separator: the lines of a text, with their line feeds. The text is split once,
    after each line feed; the pieces' bytes are the text's."""
    f = files.select(F.col(file).alias("file"), F.posexplode(F.split(text, r"(?<=\n)")).alias("pos", "chunk")).where(F.octet_length("chunk") > 0)
    f = f.select("file", F.col("pos").cast("long").alias("chunk_ord"), F.octet_length("chunk").cast("long").alias("length"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_key"), "chunk")
    return with_offsets(f)


def with_offsets(chunks: DataFrame) -> DataFrame:
    before = F.sum("length").over(Window.partitionBy("file").orderBy("chunk_ord").rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("offset", F.coalesce(before, F.lit(0)))
