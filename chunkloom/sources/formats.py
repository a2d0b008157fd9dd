"""Text and JSON formats: listings, reconstruction plans, event streams, multipart bodies, commits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = "STRUCT<`start`: BIGINT, `end`: BIGINT>"
PLAN = f"""STRUCT<offset_into_first_range: BIGINT,
  terms: ARRAY<STRUCT<hash: STRING, unpacked_length: BIGINT, range: {_RANGE}>>,
  xorbs: MAP<STRING, ARRAY<STRUCT<url: STRING, ranges: ARRAY<STRUCT<chunks: {_RANGE}, bytes: {_RANGE}>>>>>,
  fetch_info: MAP<STRING, ARRAY<STRUCT<range: {_RANGE}, url: STRING, url_range: {_RANGE}>>>>"""


def listing(lines: Column) -> Column:
    """``<hash> <length>`` as struct(hash, length)."""
    parts = F.split(lines, " ")
    return F.struct(F.get(parts, F.lit(0)).alias("hash"), F.get(parts, F.lit(1)).cast("long").alias("length"))


def plan(json: Column) -> Column:
    """A reconstruction plan of either version: struct(offset, terms, fetches), fetches by pack as
    array of (url, ranges of chunks and bytes)."""
    p = F.from_json(json, PLAN)
    old = F.transform_values(p["fetch_info"], lambda _, v: F.transform(v, lambda x: F.struct(x["url"].alias("url"), F.array(F.struct(x["range"].alias("chunks"), x["url_range"].alias("bytes"))).alias("ranges"))))
    return F.struct(p["offset_into_first_range"].alias("offset"), p["terms"].alias("terms"), F.coalesce(p["xorbs"], old).alias("fetches"))


def plan_terms(plans: DataFrame) -> DataFrame:
    """file, plan -> file, offset, term_ord, pack, unpacked_length, start, end."""
    t = plans.select("file", "plan.offset", F.posexplode("plan.terms").alias("term_ord", "t"))
    return t.select("file", "offset", "term_ord", F.col("t.hash").alias("pack"), "t.unpacked_length", F.col("t.range.start").alias("start"), F.col("t.range.end").alias("end"))


def plan_fetches(plans: DataFrame) -> DataFrame:
    """file, pack, fetch_ord, range_ord, url, start, end (chunks), first_byte, last_byte (inclusive)."""
    f = plans.select("file", F.explode("plan.fetches").alias("pack", "v")).select("file", "pack", F.posexplode("v").alias("fetch_ord", "f"))
    r = f.select("file", "pack", "fetch_ord", "f.url", F.posexplode("f.ranges").alias("range_ord", "r"))
    return r.select("file", "pack", "fetch_ord", "range_ord", "url", F.col("r.chunks.start").alias("start"), F.col("r.chunks.end").alias("end"), F.col("r.bytes.start").alias("first_byte"), F.col("r.bytes.end").alias("last_byte"))


def events(lines: DataFrame, stream: str, value: str, terminal: tuple[str, ...] = ("result", "error"), known: tuple[str, ...] = ("progress", "result", "error")) -> DataFrame:
    """NDJSON: stream, events, ended (a terminal one came), unknown (types that are not known)."""
    kind = F.get_json_object(value, "$.type")
    e = lines.select(F.col(stream).alias("stream"), kind.alias("type"))
    return e.groupBy("stream").agg(F.count("*").alias("events"), F.max(F.coalesce(F.col("type").isin(*terminal), F.lit(False))).alias("ended"), F.count_if(~F.coalesce(F.col("type").isin(*known), F.lit(False))).alias("unknown"))


def multipart(body: bytes, boundary: str) -> list[tuple[int, int, bytes]]:
    """(first, last, bytes) of each part of a multipart/byteranges body. A delimiter counts at the
    start of a line only; a part's content-range must give its length."""
    mark = b"--" + boundary.encode()
    at, out = (0 if body.startswith(mark) else body.find(b"\r\n" + mark) + 2), []
    if at == 1:
        raise ValueError("no delimiter")
    while not body[at + len(mark) :].startswith(b"--"):
        head = body.index(b"\r\n", at) + 2
        blank = body.index(b"\r\n\r\n", head - 2)
        m = re.search(rb"(?im)^content-range:\s*bytes (\d+)-(\d+)/(?:\d+|\*)\s*$", body[head : blank + 2])
        end = body.find(b"\r\n" + mark, blank + 2)
        if not m or end < 0:
            raise ValueError("part")
        first, last, data = int(m[1]), int(m[2]), body[blank + 4 : end]
        if last - first + 1 != len(data):
            raise ValueError("length")
        out.append((first, last, data))
        at = end + 2
    return out


def multipart_parts(bodies: DataFrame) -> DataFrame:
    """bodies: fetch, boundary, body -> fetch, part_ord, first_byte, last_byte, data."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                parts = multipart(b.column(2)[i].as_py(), b.column(1)[i].as_py())
                if parts:
                    cols = [range(len(parts)), *zip(*parts)]
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(parts), b.column(0).type), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["fetch", "part_ord", "first_byte", "last_byte", "data"])

    kind = bodies.schema["fetch"].dataType.simpleString()
    return bodies.select("fetch", "boundary", "body").mapInArrow(run, f"fetch {kind}, part_ord int, first_byte long, last_byte long, data binary")


def commit_lines(files: DataFrame, summary: str, description: str = "", parent: str | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """files: path, sha256, size. One row, payload: the header's line, then files and deletions by
    path. The payload is one text of some 150 bytes a file, so it holds a few million files at most."""
    from pyspark.sql import SparkSession

    spark: SparkSession = files.sparkSession
    head = {"summary": F.lit(summary), "description": F.lit(description)} | ({"parentCommit": F.lit(parent)} if parent else {})
    line = lambda key, v: F.to_json(F.struct(F.lit(key).alias("key"), v.alias("value")))
    rows = spark.range(1).select(F.lit(0).alias("part"), F.lit("").alias("path"), line("header", F.struct(*[v.alias(k) for k, v in head.items()])).alias("line"))
    lfs = F.struct(F.col("path"), F.lit("sha256").alias("algo"), F.col("sha256").alias("oid"), F.col("size").alias("size"))
    rows = rows.unionByName(files.select(F.lit(1).alias("part"), "path", line("lfsFile", lfs).alias("line")))
    if deleted is not None:
        rows = rows.unionByName(deleted.select(F.lit(2).alias("part"), "path", line("deletedFile", F.struct("path")).alias("line")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "path", "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    return rows.agg(F.array_join(ordered, "").alias("payload"))
