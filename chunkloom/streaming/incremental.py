"""Chunking and deduplication of data as it comes in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import gear


class Chunker:
    """Cuts blocks as a whole input would be cut: what follows the last cut is held (less than twice
    the target), and a cut counts once it can't move any more."""

    def __init__(self, target: int = gear.TARGET, table=None, held: bytes = b""):
        self.target, self.table, self.held = target, gear.default_table() if table is None else table, held

    def feed(self, block: bytes, final: bool = False) -> list[bytes]:
        data = self.held + block
        out, start = [], 0
        ends = gear.cuts(data, self.target, self.table)
        for end in ends:
            # the end of the input is a cut only if the rule would cut there too
            if end == len(data) and not final and not self._cuts_at(data, start, end):
                break
            out.append(data[start:end])
            start = end
        self.held = data[start:]
        return out

    def _cuts_at(self, data: bytes, start: int, end: int) -> bool:
        least, most, bits = gear.limits(self.target)
        if end - start < least:
            return False
        if end - start == most:
            return True
        # windows longer than the chunk so far count the held bytes only, as after a reset
        return int(gear.hashes(data[start:end][-gear.WINDOW :], self.table)[-1]) >> 64 - bits == 0


OUT = "file string, chunk_ord long, offset long, length long, chunk_key string"
STATE = "held binary, chunk_ord long, offset long"


def chunk_stream(blocks: DataFrame, target: int = gear.TARGET, table=None) -> DataFrame:
    """blocks, streaming: file, seq, data, final (the file's last block). Within a micro-batch blocks
    go by seq. State of an open file is what follows its last cut."""
    table = gear.default_table() if table is None else table

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ordinal, offset = state.get if state.exists else (b"", 0, 0)
        chunker, rows, done = Chunker(target, table, bytes(held)), [], False
        for r in pd.concat(list(pdfs)).sort_values("seq").itertuples():
            done = bool(r.final)
            for c in chunker.feed(bytes(r.data or b""), done):
                rows.append((key[0], ordinal, offset, len(c), hashlib.sha256(c).hexdigest()))
                ordinal, offset = ordinal + 1, offset + len(c)
        if done:
            state.remove()
        else:
            state.update((chunker.held, ordinal, offset))
        yield pd.DataFrame(rows, columns=["file", "chunk_ord", "offset", "length", "chunk_key"])

    return blocks.groupBy("file").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def block_stream(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a folder's files as they arrive, for chunk_stream: each file is one final block."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), F.lit(0).alias("seq"), F.col("content").alias("data"), F.lit(True).alias("final"))


def first_seen_stream(chunks: DataFrame, time: str, within: str) -> DataFrame:
    """Chunks of a stream whose key was not seen before in it. A key's state goes when the watermark has
    passed it by ``within``, so state is bounded by what arrives in that time; a key that comes again
    later is new again, as an answer that has expired."""
    return chunks.withWatermark(time, within).dropDuplicatesWithinWatermark(["chunk_key"])


def merge_new(chunks: DataFrame, index_path: str) -> int:
    """For foreachBatch: appends first occurrences that the index at index_path lacks; returns how
    many. A repeated batch adds nothing; an index that can't be read raises."""
    spark = chunks.sparkSession
    first = chunks.groupBy("chunk_key").agg(F.min(F.struct("file", "chunk_ord", "length")).alias("f")).select("chunk_key", "f.*")
    p = spark._jvm.org.apache.hadoop.fs.Path(index_path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        first = first.join(spark.read.parquet(index_path).select("chunk_key"), "chunk_key", "left_anti")
    first = first.persist()
    n = first.count()
    if n:
        first.write.mode("append").parquet(index_path)
    first.unpersist()
    return n
