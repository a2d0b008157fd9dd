"""Scalar expressions of the wire and text formats, plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRYABLE = [408, 429, 500, 502, 503, 504]


def u24(raw: Column, at: int) -> Column:
    """Three little-endian bytes from place at (from 1) as an int."""
    return F.conv(F.concat(*[F.hex(F.substring(raw, at + i, 1)) for i in (2, 1, 0)]), 16, 10).cast("int")


def range_header(ranges: Column) -> Column:
    """``bytes=a-b,c-d`` of an array of struct(start, end), ends inclusive."""
    one = lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))
    return F.concat(F.lit("bytes="), F.array_join(F.transform(ranges, one), ","))


def signed_range(url: Column, name: str = r"[\w-]*signed-range") -> Column:
    """The range that a signed url carries as a query parameter, in any case; null without one."""
    found = F.regexp_extract(url, rf"(?i)[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))))


def content_range(header: Column) -> Column:
    """struct(start, end, total) of ``bytes s-e/total``; total null for ``*``, all null if malformed."""
    part = lambda k: F.regexp_extract(header, r"^bytes (\d+)-(\d+)/(\d+|\*)$", k)
    number = lambda k: F.when(part(k).rlike(r"^\d+$"), part(k).cast("long"))
    return F.struct(number(1).alias("start"), number(2).alias("end"), number(3).alias("total"))


def redact(url: Column) -> Column:
    return F.split(url, r"\?")[0]


def is_http(url: Column) -> Column:
    return url.rlike(r"^(?i:https?)://[^/?#]+")


def fraction(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total)))


def unix_or_null(seconds: Column) -> Column:
    return F.when(seconds != 0, F.timestamp_seconds(seconds))


def null_to_zero(ts: Column) -> Column:
    return F.coalesce(F.unix_timestamp(ts), F.lit(0)).cast("long")


def escaped_path(path: Column) -> Column:
    """Percent-encoding by segment; a space is %20 and a tilde stays."""
    one = lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def backoff(attempt: Column, base: Column, most: Column, jitter: Column | None = None) -> Column:
    """Seconds to wait after a failed attempt (from 1): base, doubled each time, most at most, times jitter
    (0 to 1; drawn evenly if not given)."""
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), most) * (F.rand() if jitter is None else jitter)


def known_total(c: Column) -> Column:
    """The sum, null unless every row has a value; an aggregate."""
    return F.when(F.count("*") == F.count(c), F.sum(c))
