"""New chunks to packs, files to terms.

Packing is next-fit in order: a chunk that does not fit seals the pack. That is sequential, so one
task walks an order; it sees the lengths alone, four bytes a chunk, as packed arrays of up to BLOCK
chunks that stream by in sorted order, and gives back for each array where packs begin in it. Keys
and places are joined to that by array afterwards, all in parallel. With ``groups`` each group
of files packs on its own, so walks are parallel too, at the price of pack borders a single session
wouldn't have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CHUNKS, MAX_BYTES = 8192, (64 << 20) - 8192 * 8
#: Chunks of a file whose lengths go as one array.
BLOCK = 65_536


class NextFit:
    """Fills packs with what comes, by jumps over prefix sums: one search for each pack, not each chunk."""

    def __init__(self, max_bytes: int = MAX_BYTES, max_chunks: int = MAX_CHUNKS):
        self.max_bytes, self.max_chunks = max_bytes, max_chunks
        self.pack = self.count = self.held = 0

    def feed(self, lengths: np.ndarray) -> list[int]:
        """The places of lengths at which a new pack begins; pack, count and held go on from there."""
        ends, at, cuts = np.cumsum(lengths), 0, []
        while at < len(lengths):
            before = int(ends[at - 1]) if at else 0
            stop = int(np.searchsorted(ends, before + self.max_bytes - self.held, "right"))
            # a chunk alone in a pack fits, whatever its length
            stop = min(max(stop, at + (self.count == 0)), at + self.max_chunks - self.count)
            if stop > at:
                self.held, self.count = self.held + int(ends[stop - 1]) - before, self.count + stop - at
            if stop < len(lengths):
                cuts.append(stop)
                self.pack, self.count, self.held = self.pack + 1, 0, 0
            at = stop
        return cuts


def next_fit(lengths: np.ndarray, max_bytes: int = MAX_BYTES, max_chunks: int = MAX_CHUNKS) -> np.ndarray:
    """The pack of each chunk."""
    out = np.zeros(len(lengths), np.int64)
    out[NextFit(max_bytes, max_chunks).feed(lengths)] = 1
    return np.cumsum(out)


def assign_packs(chunks: DataFrame, max_bytes: int = MAX_BYTES, max_chunks: int = MAX_CHUNKS, groups: str | None = None) -> DataFrame:
    """chunks: file, chunk_ord, length, chunk_key, distinct and new. Adds grp, pack and idx."""
    g = (F.col(groups) if groups else F.lit(0)).cast("long").alias("grp")
    own = Window.partitionBy("grp", "file", "block").orderBy("chunk_ord")
    slim = chunks.select("file", "chunk_ord", "length", "chunk_key", g, F.floor(F.col("chunk_ord") / BLOCK).cast("long").alias("block"))
    slim = slim.withColumn("pos", F.row_number().over(own) - 1)
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("pos", "length"))), lambda x: x["length"].cast("int"))
    arrays = slim.groupBy("grp", "file", "block").agg(lengths.alias("lengths"))
    kind = chunks.schema["file"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, fit = None, None
        for b in batches:
            first, idx, cuts = [], [], []
            for now, some in zip(b.column(0).to_pylist(), b.column(3)):
                if now != grp:
                    grp, fit = now, NextFit(max_bytes, max_chunks)
                first.append(fit.pack)
                idx.append(fit.count)
                cuts.append(fit.feed(some.values.to_numpy(zero_copy_only=False).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(first, pa.int64()), pa.array(idx, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))], ["grp", "file", "block", "first", "held", "cuts"])

    dealt = arrays.repartition("grp") if groups else arrays.repartition(1)
    walked = dealt.sortWithinPartitions("grp", "file", "block").mapInArrow(walk, f"grp long, file {kind}, block long, first long, held long, cuts array<int>")
    j = slim.join(walked, ["grp", "file", "block"])
    passed = F.filter("cuts", lambda c: c <= F.col("pos"))
    j = j.withColumn("passed", passed)
    idx = F.when(F.size("passed") > 0, F.col("pos") - F.element_at("passed", -1)).otherwise(F.col("held") + F.col("pos"))
    return j.select("file", "chunk_ord", "length", "chunk_key", "grp", (F.col("first") + F.size("passed")).alias("pack"), idx.cast("long").alias("idx"))


def pack_listing(packed: DataFrame) -> DataFrame:
    """packed with byte_range_start: the raw bytes of the pack before each chunk."""
    w = Window.partitionBy("grp", "pack").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("byte_range_start", F.coalesce(F.sum("length").over(w), F.lit(0)))


def placements(chunks: DataFrame, packed: DataFrame) -> DataFrame:
    """Every chunk of every file with the pack and index that hold it. A key that files repeat without end
    makes its part of the join large; packed has it once, so adaptive execution splits that part."""
    return chunks.join(packed.select("chunk_key", "grp", "pack", "idx"), "chunk_key")


def with_terms(placed: DataFrame) -> DataFrame:
    """placed with term_ord: runs of a file's chunks that stand in a row in one pack."""
    w = Window.partitionBy("file").orderBy("chunk_ord")
    same = (F.lag("pack").over(w) == F.col("pack")) & (F.lag("grp").over(w) == F.col("grp")) & (F.lag("idx").over(w) + 1 == F.col("idx"))
    t = placed.withColumn("opens", F.when(same, 0).otherwise(1))
    return t.withColumn("term_ord", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("opens")


def file_terms(placed: DataFrame) -> DataFrame:
    """file, term_ord, pack, start, end (exclusive), unpacked_length, chunks, first_chunk."""
    return with_terms(placed).groupBy("file", "term_ord").agg(
        F.min("grp").alias("grp"), F.min("pack").alias("pack"), F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"),
        F.sum("length").alias("unpacked_length"), F.count("*").alias("chunks"), F.min("chunk_ord").alias("first_chunk"),
    )


def term_hashes(placed: DataFrame) -> DataFrame:
    """placed with hash: file, term_ord, hashes (of its chunks, in order). A term holds no more chunks than
    a pack."""
    h = F.array_sort(F.collect_list(F.struct("chunk_ord", "hash")))
    return with_terms(placed).groupBy("file", "term_ord").agg(F.transform(h, lambda x: x["hash"]).alias("hashes"))


def ordered(placed: DataFrame) -> DataFrame:
    """file, nodes: its chunks' (hash, length) in order, for the tree aggregates."""
    node = F.array_sort(F.collect_list(F.struct("chunk_ord", "hash", "length")))
    return placed.groupBy("file").agg(F.transform(node, lambda x: F.struct(x["hash"].alias("hash"), x["length"].alias("length"))).alias("nodes"))
