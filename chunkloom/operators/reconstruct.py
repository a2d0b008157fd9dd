"""Terms back to bytes: the plan as joins, the cut to a range as arithmetic, the checks as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import checked


def expand_terms(terms: DataFrame) -> DataFrame:
    """A row for each chunk of each term."""
    return terms.select("*", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx")).where("end > start")


def plan_ranges(terms: DataFrame, fetches: DataFrame, partial: bool = False) -> DataFrame:
    """terms: file, term_ord, pack, start, end; fetches: pack, fetch_ord, range_ord, start, end. The
    first range by (fetch, range) that holds each chunk, runs of chunks of one range joined to
    segments: file, term_ord, pack, segment, fetch_ord, range_ord, start, end. Both sides are
    exploded to chunks, so an equi-join does a range join's work. A chunk that no range holds fails the
    job; with partial it has no fetch."""
    e = expand_terms(terms.select("file", "term_ord", "pack", "start", "end")).select("file", "term_ord", "pack", "idx")
    r = expand_terms(fetches.select("pack", "fetch_ord", "range_ord", "start", "end"))
    r = r.groupBy("pack", "idx").agg(F.min(F.struct("fetch_ord", "range_ord")).alias("f"))
    j = e.join(r, ["pack", "idx"], "left")
    found = F.col("f") if partial else checked(F.col("f"), F.col("f").isNull(), "a chunk of a term is in no fetched range")
    j = j.select("file", "term_ord", "pack", "idx", found.alias("f")).select("file", "term_ord", "pack", "idx", "f.fetch_ord", "f.range_ord")
    w = Window.partitionBy("file", "term_ord").orderBy("idx")
    same = (F.lag("fetch_ord").over(w) == F.col("fetch_ord")) & (F.lag("range_ord").over(w) == F.col("range_ord"))
    j = j.withColumn("segment", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return j.groupBy("file", "term_ord", "pack", "segment", "fetch_ord", "range_ord").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))


def fetch_liveness(segments: DataFrame) -> DataFrame:
    """For each fetch of a file, its place in order of first use and the last term that needs it."""
    g = segments.groupBy("file", "pack", "fetch_ord").agg(F.min(F.struct("term_ord", "start")).alias("first"), F.max("term_ord").alias("last_term"))
    w = Window.partitionBy("file").orderBy("first")
    return g.select("file", "pack", "fetch_ord", (F.dense_rank().over(w) - 1).alias("use_ord"), "last_term")


def uncovered(terms: DataFrame, fetches: DataFrame) -> DataFrame:
    """Chunks of terms that no fetched range holds; must be empty."""
    e = expand_terms(terms.select("file", "term_ord", "pack", "start", "end")).select("file", "term_ord", "pack", "idx")
    r = expand_terms(fetches.select("pack", "start", "end")).select("pack", "idx").distinct()
    return e.join(r, ["pack", "idx"], "left_anti")


def invalid_terms(terms: DataFrame, offset: Column) -> DataFrame:
    """Terms that break a plan's rules: empty or negative ranges, lengths below 1, an offset
    outside the first term."""
    first = F.col("term_ord") == 0
    return terms.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("unpacked_length") <= 0) | (first & ((offset < 0) | (offset >= F.col("unpacked_length")))))


def normalized_range(offset: Column, length: Column, size: Column) -> Column:
    """struct(whole, start, end inclusive): what a request reads of a file of that size (null:
    unknown); start and end are null where it reads nothing or all."""
    whole = (offset == 0) & (length.isNull() | F.coalesce(length >= size, F.lit(False)))
    end = F.least(F.when(length.isNotNull(), offset + length - 1).otherwise(size - 1), F.coalesce(size - 1, F.lit((1 << 63) - 1)))
    some = ~whole & (offset >= 0) & F.coalesce(offset < size, F.lit(True)) & (end >= offset)
    return F.struct(whole.alias("whole"), F.when(some, offset).alias("start"), F.when(some, end).alias("end"))


def trim(placed: DataFrame, start: Column, end: Column) -> DataFrame:
    """placed: file, chunk_ord, offset, length, chunk (bytes or text as binary). The part of each chunk
    within [start, end) of its file; chunks outside go before any byte is read."""
    lo = F.greatest(F.lit(0), start - F.col("offset"))
    hi = F.least(F.col("length"), end - F.col("offset"))
    p = placed.where((F.col("offset") < end) & (F.col("offset") + F.col("length") > start))
    return p.select("file", "chunk_ord", F.substr("chunk", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"), (hi - lo).alias("bytes"))


def concatenated(pieces: DataFrame) -> DataFrame:
    """file, content: pieces in order, joined by an ordered aggregate over their bytes. A file becomes one row,
    so this is for files that fit in one; larger ones are written piece by piece, in order."""
    return pieces.groupBy("file").agg(F.expr("listagg(piece) within group (order by chunk_ord)").alias("content"))


def length_errors(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Terms whose declared length is not the sum of their chunks: pack, idx, length."""
    e = expand_terms(terms).join(chunks.select("pack", "idx", "length"), ["pack", "idx"], "left")
    g = e.groupBy("file", "term_ord").agg(F.max("unpacked_length").alias("declared"), F.sum("length").alias("found"))
    return g.where("found is null or declared <> found")
