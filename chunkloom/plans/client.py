"""Upload and download over tables: the dataflow from files to packs and shard rows and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gear
from ..functions.hashes import chunk_hash, file_root, pack_root, verification
from ..operators import chunking, dedup, packing, reconstruct
from ..sources import assemble
from ..sources import packs as pack_format

#: Columns of an index of what is stored: a row for each chunk of each pack of each shard.
INDEX = "shard_ord long, pack string, idx long, chunk_key string, expires_at timestamp"


class VerificationError(ValueError):
    """Data that is not what its hash or length says."""


@dataclass
class Upload:
    held: list[DataFrame]
    chunks: DataFrame
    #: New chunks in their packs: pack (its hash), idx, chunk_key, length, byte_range_start.
    packed: DataFrame
    #: New packs: pack_hash, data, disk_bytes, raw_bytes, chunk_count.
    packs: DataFrame
    #: Terms by pack hash, with verification.
    terms: DataFrame
    files: DataFrame
    #: By file: chunks, bytes, dedup_bytes.
    stats: DataFrame
    #: One row: packs, uploaded_bytes, dedup_bytes, queries.
    totals: DataFrame

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def upload(files: DataFrame, path: str = "path", content: str = "content", target: int = gear.TARGET, max_bytes: int = packing.MAX_BYTES, table=None, groups: str | None = None, index: DataFrame | None = None, stored: DataFrame | None = None, as_of=None, rate: int = dedup.SAMPLE_RATE) -> Upload:
    """files: a path and binary content. index: the shards at hand, stored: those of a service that sampled
    keys are asked of, as INDEX; both by chunk hash, and as_of is when. Raises for repeated paths and
    empty files."""
    spark = files.sparkSession
    f = files.select(F.col(path).alias("file"), F.col(content).alias("content"))
    if dedup.duplicate_paths(f, "file").limit(1).count() or f.where("content is null or length(content) = 0").limit(1).count():
        raise ValueError("paths must differ and files hold something")
    c = chunking.chunk_table(f, "file", "content", target, table, keep_content=True)
    c = c.withColumn("chunk_key", chunk_hash(F.col("chunk")))
    # hashes are made once: most tables of an upload follow from these two; release() lets go of them
    slim = c.select("file", "chunk_ord", "length", "chunk_key").persist()
    when = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
    places, asked = dedup.known_places(slim, index if index is not None else spark.createDataFrame([], INDEX), stored, when, rate)
    fresh = dedup.new_chunks(slim, places)
    packed = packing.assign_packs(fresh, max_bytes, groups=groups).persist()
    listed = packing.pack_listing(packed)
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_key", "length"))), lambda x: F.struct(x["chunk_key"].alias("hash"), x["length"].alias("length")))
    roots = listed.groupBy("grp", "pack").agg(nodes.alias("nodes"), F.sum("length").alias("raw_bytes"), F.count("*").alias("chunk_count"))
    roots = roots.withColumn("pack_hash", pack_root("nodes")).drop("nodes")
    bodies = pack_format.build_packs(packed.join(c.select("file", "chunk_ord", "chunk"), ["file", "chunk_ord"]))
    packs = bodies.join(roots, ["grp", "pack"]).drop("grp", "pack")
    own = listed.join(roots.select("grp", "pack", "pack_hash"), ["grp", "pack"]).drop("grp", "pack").withColumnRenamed("pack_hash", "pack")
    everywhere = own.select("chunk_key", "pack", "idx").unionByName(places)
    placed = packing.placements(slim, everywhere.withColumn("grp", F.lit(0))).withColumn("hash", F.col("chunk_key"))
    checks = packing.term_hashes(placed).select("file", "term_ord", verification("hashes").alias("verification"))
    terms = packing.file_terms(placed).drop("grp").join(checks, ["file", "term_ord"])
    roots_of = packing.ordered(placed).select("file", file_root("nodes").alias("file_hash"))
    shas = f.select("file", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))
    marked = slim.join(fresh.select("file", "chunk_ord", F.lit(False).alias("is_dup")), ["file", "chunk_ord"], "left").fillna(True, ["is_dup"])
    stats = dedup.storage_stats(marked, "file")
    sums = packs.agg(F.count("*").alias("packs"), F.coalesce(F.sum("disk_bytes"), F.lit(0)).alias("uploaded_bytes"))
    totals = sums.join(stats.agg(F.sum("dedup_bytes").alias("dedup_bytes"))).join(asked.agg(F.count("*").alias("queries")))
    return Upload([slim, packed], c, own, packs, terms, shas.join(roots_of, "file"), stats, totals)


def shard_of(up: Upload, batch: int = 0, created: int | None = None, expires: int | None = None) -> DataFrame:
    """batch, part, path, content: the shard that registers an upload's files and new packs, or several where
    they don't fit in one."""
    t = up.terms.join(up.files.select("file", "file_hash", "sha256"), "file").withColumn("batch", F.lit(batch))
    c = up.packed.join(up.packs.select(F.col("pack_hash").alias("pack"), "disk_bytes"), "pack").withColumnRenamed("chunk_key", "chunk_hash").withColumn("batch", F.lit(batch))
    return assemble.write_shards(t, c, created, expires)


def commit(up: Upload, store: str, known: DataFrame | None = None) -> DataFrame:
    """Sends the packs to the store, then checks that every pack that terms name is there (known: pack, of
    those that a service holds besides); returns the shards, which are to be sent last."""
    assemble.store_packs(up.packs, store)
    there = assemble.stored_packs(up.terms.sparkSession, store).select(F.col("pack_hash").alias("pack"))
    if known is not None:
        there = there.unionByName(known.select("pack"))
    if dedup.missing_packs(up.terms, there).limit(1).count():
        raise VerificationError("terms name packs that are not stored")
    return shard_of(up)


def download(terms: DataFrame, packs: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """terms: file, term_ord, pack, start, end, unpacked_length; packs: pack_hash, data. file, content: each file
    of terms, or its bytes [start, start + length). Raises if a term's chunks are not all there, or its
    length is not what they give."""
    chunks = pack_format.explode_packs(packs.select(F.col("pack_hash").alias("pack"), "data"))
    sized = chunks.select("pack", "idx", F.col("raw").alias("length"))
    if reconstruct.length_errors(terms, sized).limit(1).count():
        raise VerificationError("a term's length differs")
    e = reconstruct.expand_terms(terms.select("file", "term_ord", "pack", "start", "end"))
    placed = e.join(chunks.select("pack", "idx", F.col("raw").alias("length"), "chunk"), ["pack", "idx"])
    placed = placed.select("file", F.struct("term_ord", "idx").alias("chunk_ord"), "length", "chunk")
    placed = chunking.with_offsets(placed)
    end = F.lit((1 << 62) if length is None else start + length)
    return reconstruct.concatenated(reconstruct.trim(placed, F.lit(start), end))


def verify(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose rebuilt SHA-256 is another; must be empty."""
    return contents.join(files, "file").where(F.sha2("content", 256) != F.col("sha256")).select("file")
