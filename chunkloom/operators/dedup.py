"""What is stored already, and where each chunk was first seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import hmac_of, remainder_of

SAMPLE_RATE = 1024


def first_occurrence(chunks: DataFrame) -> DataFrame:
    """chunks with first_file, first_ord and is_dup. The first place of each key comes by a partial
    aggregation; joined back, a key that repeats without end makes its part of the join large, which
    adaptive execution splits, since the other side has each key once."""
    first = chunks.groupBy("chunk_key").agg(F.min(F.struct("file", "chunk_ord")).alias("f"))
    out = chunks.join(first, "chunk_key").select(*chunks.columns, F.col("f.file").alias("first_file"), F.col("f.chunk_ord").alias("first_ord"))
    return out.withColumn("is_dup", (F.col("file") != F.col("first_file")) | (F.col("chunk_ord") != F.col("first_ord")))


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """First occurrences that the index (chunk_key) lacks."""
    first = chunks.groupBy("chunk_key").agg(F.min(F.struct("file", "chunk_ord", "length")).alias("f"))
    fresh = first.join(index.select("chunk_key").distinct(), "chunk_key", "left_anti")
    return fresh.select("f.file", "f.chunk_ord", "f.length", "chunk_key")


def is_expired(expires_at: Column, as_of: Column) -> Column:
    return expires_at.isNotNull() & (expires_at <= as_of)


def is_eligible(key: Column, rate: int = SAMPLE_RATE) -> Column:
    """Whether a key is one that a global index is asked about."""
    return remainder_of(key, rate) == 0


def eligible_misses(chunks: DataFrame, index: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """chunk_key: the keys that a global index is asked about, once each."""
    miss = chunks.select("chunk_key").join(index.select("chunk_key"), "chunk_key", "left_anti")
    return miss.where(is_eligible(F.col("chunk_key"), rate)).distinct()


def known_places(chunks: DataFrame, shards: DataFrame, stored: DataFrame | None, as_of: Column, rate: int = SAMPLE_RATE) -> tuple[DataFrame, DataFrame]:
    """(chunk_key, pack, idx of what is stored already; the keys asked about). shards: those at hand, stored:
    all of a service, both shard_ord, pack, idx, chunk_key, expires_at. A sampled key that the shards
    at hand lack is asked about; a shard of the service that holds it and has not expired comes to hand
    whole, so chunks near by are found in it too."""
    live = lambda s: s.where(~F.coalesce(is_expired(F.col("expires_at"), as_of), F.lit(False)))
    asked = eligible_misses(chunks, live(shards), rate)
    near = live(shards)
    if stored is not None:
        got = live(stored).join(asked, "chunk_key", "left_semi").select("shard_ord").distinct()
        near = near.unionByName(live(stored).join(got, "shard_ord", "left_semi"))
    found = probe(chunks.select("chunk_key").distinct(), near, as_of).where("pack is not null")
    return found.select("chunk_key", "pack", "idx"), asked


def probe(chunks: DataFrame, shards: DataFrame, as_of: Column, key: str | None = None) -> DataFrame:
    """shards: shard_ord, pack, idx, chunk_key, expires_at; chunk_key is keyed by ``key`` if given. The
    first shard by order that has not expired wins, in it the first place. Distinct keys are hashed
    once each."""
    live = shards.where(~F.coalesce(is_expired(F.col("expires_at"), as_of), F.lit(False)))
    best = live.groupBy("chunk_key").agg(F.min(F.struct("shard_ord", "pack", "idx")).alias("at"))
    keys = chunks.select("chunk_key").distinct().withColumn("probe", hmac_of(F.col("chunk_key"), key) if key else F.col("chunk_key"))
    hits = keys.join(best.withColumnRenamed("chunk_key", "probe"), "probe").select("chunk_key", "at.shard_ord", "at.pack", "at.idx")
    return chunks.join(hits, "chunk_key", "left")


def storage_stats(chunks: DataFrame, by: str | None = None, rollup: bool = False) -> DataFrame:
    """chunks with is_dup: how many, their bytes, and what deduplication saves."""
    sums = [F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.sum(F.when(F.col("is_dup"), F.col("length")).otherwise(0)).alias("dedup_bytes")]
    g = chunks.rollup(by) if rollup else chunks.groupBy(by) if by else chunks.groupBy()
    return g.agg(*sums)


def shared_chunks(chunks: DataFrame) -> DataFrame:
    """Keys that stand in two files or more, and in how many."""
    once = chunks.groupBy("chunk_key", "file").agg(F.max("length").alias("length"))
    return once.groupBy("chunk_key").agg(F.count("*").alias("files"), F.max("length").alias("length")).where("files > 1")


def duplicate_paths(files: DataFrame, path: str) -> DataFrame:
    return files.groupBy(F.col(path).alias("path")).agg(F.count("*").alias("n")).where("n > 1")


def missing_packs(terms: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs that terms name and that are not there; must be empty before a commit."""
    return terms.select("pack").distinct().join(packs.select("pack"), "pack", "left_anti")
