"""Chunk and byte ranges of plans and requests: lengths, rules, and the match of answers to what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MAX, LONG_MAX = (1 << 31) - 1, (1 << 63) - 1


def holds(start: Column, end: Column, idx: Column) -> Column:
    """Whether a half-open range of chunks holds idx."""
    return (idx >= start) & (idx < end)


def byte_length(first: Column, last: Column) -> Column:
    """Bytes of a range whose end is inclusive."""
    return last - first + 1


def invalid_chunk_range(start: Column, end: Column) -> Column:
    """Missing, negative, backwards, or beyond 32 bits."""
    return F.coalesce((start < 0) | (end < start) | (end > INT_MAX), F.lit(True))


def invalid_byte_range(first: Column, last: Column) -> Column:
    return F.coalesce((first < 0) | (last < first), F.lit(True))


def checked(value: Column, bad: Column, message: str) -> Column:
    """value; the job fails with the message where bad holds."""
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def fetch_bytes(fetches: DataFrame) -> DataFrame:
    """fetches: file, pack, fetch_ord, range_ord, first_byte, last_byte -> file, pack, fetch_ord, ranges, bytes."""
    return fetches.groupBy("file", "pack", "fetch_ord").agg(F.count("*").alias("ranges"), F.sum(byte_length(F.col("first_byte"), F.col("last_byte"))).alias("bytes"))


def content_lengths(terms: DataFrame) -> DataFrame:
    """terms: file, offset (into the first term), unpacked_length -> file, unpacked, content: what the terms
    hold, and what of it the request gets."""
    g = terms.groupBy("file").agg(F.sum("unpacked_length").alias("unpacked"), F.first("offset").alias("offset"))
    return g.select("file", "unpacked", (F.col("unpacked") - F.col("offset")).alias("content"))


def request_error(offset: Column, length: Column, size: Column) -> Column:
    """Why a partial read is refused: null if it is not. An end beyond 64 bits would wrap around."""
    return (
        F.when(offset < 0, F.lit("negative offset"))
        .when(length < 0, F.lit("negative length"))
        .when((length > 0) & (offset > LONG_MAX - (length - 1)), F.lit("end beyond 64 bits"))
        .when(length.isNull() & size.isNull() & (offset != 0), F.lit("length needed for a file of unknown size"))
    )


def match_parts(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """ranges: fetch, range_ord, first_byte, last_byte; parts: fetch, first_byte, last_byte, data. By the range
    that a part declares, not by its place: every range with its data, null where no part answers it."""
    once = parts.groupBy("fetch", "first_byte", "last_byte").agg(F.min("data").alias("data"))
    return ranges.join(once, ["fetch", "first_byte", "last_byte"], "left")


def unanswered(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """Ranges that no part declares; must be empty."""
    return ranges.join(parts.select("fetch", "first_byte", "last_byte"), ["fetch", "first_byte", "last_byte"], "left_anti")


def miscounted(ranges: DataFrame, parts: DataFrame) -> DataFrame:
    """fetch, asked, got where the numbers differ; must be empty."""
    asked = ranges.groupBy("fetch").agg(F.count("*").alias("asked"))
    got = parts.groupBy("fetch").agg(F.count("*").alias("got"))
    j = asked.join(got, "fetch", "full").select("fetch", F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("got", F.lit(0)).alias("got"))
    return j.where("asked <> got")
