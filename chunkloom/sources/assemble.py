"""Shards from tables, and packs kept by hash.

A shard is one file of 64 MiB at most. The records of each file and each pack are made in parallel; then
one task for a batch strings them together in order, and starts a further shard where the next would
not fit, so it holds no more than a shard at a time. Only a file or a pack that fits in no shard, with
some 700,000 terms or 1,400,000 chunks, raises an error. A row of 64 MiB is held several times over by each
operator that it passes in the JVM; where shards are read on, they go in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import ZERO
from . import shards
from .packs import FormatError

_TERM = ["term_ord", "pack", "unpacked_length", "start", "end", "verification"]
_CHUNK = ["idx", "chunk_hash", "byte_range_start", "length"]


def _records(rows: DataFrame, name: str, one: str, row: list[str], kind: int) -> DataFrame:
    """batch, kind, name, records, disk, bytes, verified: of each file (kind 0) or pack (kind 1). one: the
    column that its first row gives."""
    some = F.array_sort(F.collect_list(F.struct(*row)))
    by = rows.groupBy("batch", F.col(name).alias("name")).agg(F.min_by(one, row[0]).alias("one"), some.alias("rows"))

    def made(name: str, one, rows: list[tuple]) -> tuple:
        if kind:
            p = shards.Pack(name, tuple(x[1:] for x in rows), sum(x[-1] for x in rows), one)
            return shards.pack_records(p), p.disk, p.raw, None
        f = shards.File(name, tuple(shards.Term(*x[1:]) for x in rows), one)
        return shards.file_records(f), 0, sum(t.unpacked for t in f.terms), f.verified

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        for some in batches:
            for at in range(0, some.num_rows, 256):
                b = some.slice(at, 256)
                flat = zip(*(c.to_pylist() for c in b.column(3).flatten().flatten()))
                lengths = b.column(3).value_lengths().to_pylist()
                cols = zip(*(made(x, y, list(islice(flat, n))) for x, y, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), lengths)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * b.num_rows, pa.int32()), b.column(1), *map(pa.array, cols, kinds)], ["batch", "kind", "name", "records", "disk", "bytes", "verified"])

    return by.mapInArrow(run, f"batch {rows.schema['batch'].dataType.simpleString()}, kind int, name string, records binary, disk long, bytes long, verified boolean")


def write_shards(terms: DataFrame, chunks: DataFrame, created: int | None = None, expires: int | None = None, hmac_key: str = ZERO, max_bytes: int = shards.MAX_SHARD, piece: int | None = None) -> DataFrame:
    """terms: batch, file_hash, sha256, term_ord, pack, unpacked_length, start, end, verification; chunks:
    batch, pack, idx, chunk_hash, byte_range_start, length, disk_bytes (of the whole pack). Returns batch,
    part, path, content: of each batch in either one shard, or as many of max_bytes at most as it takes,
    numbered by part; files, then packs, in order of their hashes; each with footer totals of its own:
    materialized (the files), stored (the chunks) and disk bytes (the packs). piece: where given, a shard
    comes as rows of so many bytes at most, numbered by a column piece, that follow one another as
    read_shards takes them."""

    def shard(batch: pa.Array, part: int, held: tuple[list, list], sums: list[int]) -> Iterator[pa.RecordBatch]:
        key = batch[0].as_py()
        data = shards.framed(*held, shards.Footer(hmac_key, created, expires, *sums))
        path = f"part-{part}-of-batch-{key}" if part else f"batch-{key}"
        step = piece or len(data)
        for n, at in enumerate(range(0, len(data), step)):
            cols = [batch, pa.array([part], pa.int32()), pa.array([path]), pa.array([n], pa.int32()), pa.array([data[at : at + step]], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["batch", "part", "path", "piece", "content"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, part, size, held, sums, checks = None, 0, 0, ([], []), [0, 0, 0], set()
        frame = 3 * shards.RECORD + shards.FOOTER
        for b in batches:
            for i, (kind, records, disk, n, verified) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "records", "disk", "bytes", "verified")))):
                own = b.column(0).slice(i, 1)
                other = batch is not None and batch[0] != own[0]
                if size and (other or size + len(records) + frame > max_bytes):
                    yield from shard(batch, part, held, sums)
                    part, size, held, sums = part + 1, 0, ([], []), [0, 0, 0]
                if other or batch is None:
                    batch, part, checks = own, 0, set()
                if not kind:
                    checks.add(verified)
                    if len(checks) > 1:
                        raise FormatError("all files carry verification hashes, or none")
                held[kind].append(records)
                size += len(records)
                sums[0] += disk
                sums[1 + kind] += n
        if size:
            yield from shard(batch, part, held, sums)

    units = _records(terms, "file_hash", "sha256", _TERM, 0).unionByName(_records(chunks, "pack", "disk_bytes", _CHUNK, 1))
    dealt = units.repartition("batch").sortWithinPartitions("batch", "kind", "name")
    out = dealt.mapInArrow(walk, f"batch {units.schema['batch'].dataType.simpleString()}, part int, path string, piece int, content binary")
    return out if piece else out.drop("piece")


def united(batches: list[DataFrame], batch) -> DataFrame:
    """Rows of several batches as one batch."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.withColumn("batch", F.lit(batch))


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def store_packs(packs: DataFrame, path: str) -> None:
    """packs: pack_hash, data. Appends those that the store lacks, by the first two digits of their hash;
    a pack sent again changes nothing."""
    new = packs.select("pack_hash", "data").dropDuplicates(["pack_hash"])
    there = _known(packs.sparkSession, path)
    if there is not None:
        new = new.join(there.select("pack_hash"), "pack_hash", "left_anti")
    new.withColumn("prefix", F.substring("pack_hash", 1, 2)).write.mode("append").partitionBy("prefix").option("compression", "uncompressed").parquet(path)


def stored_packs(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """pack_hash, data of the packs of wanted (pack_hash), or of all. The prefix prunes what is read."""
    there = _known(spark, path)
    if there is None:
        return spark.createDataFrame([], "pack_hash string, data binary")
    there = there.select("pack_hash", "data", "prefix")
    if wanted is not None:
        w = wanted.select("pack_hash", F.substring("pack_hash", 1, 2).alias("prefix")).distinct()
        there = there.withColumn("prefix", F.col("prefix").cast("string")).join(w, ["prefix", "pack_hash"], "left_semi")
    return there.select("pack_hash", "data")
