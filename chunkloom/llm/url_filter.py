"""URL filters: rules by host and path prefix, and a Bloom filter cascade for listed domains.

The cascade holds, level by level, a Bloom filter of what the level before gets wrong: level 0
encodes the listed keys, level 1 those keys of the universe that level 0 passes by mistake, level
2 the listed keys that level 1 passes by mistake, and so on until a level passes nothing wrongly.
The universe is every domain of the corpus (each host and its parent domains), so membership is
exact for every url, without a join. Keys are dealt into shards by hash, each with a cascade of
its own; a pass over the urls loads at most ``max_bytes`` of them, and further passes do the rest.

Defined results: a null url or one without :// has empty host and path and is allowed unless a
rule or an empty listed key says otherwise; repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, staged

#: (verdict, host, path) of the contract.
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
#: Domains that the list blocks where no rule fits.
LISTED = [f"{name}.example.{tld}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-money") for tld in ("com", "net", "org")]
KEYS_PER_SHARD = 2_000_000
#: Bits a key and hashes of level 0, then of all others.
FIRST, LATER = (10, 7), (2, 1)


def url_parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits (longer host, then block, on ties)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> Column:
    """host and its parent domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def _shard(key: str, shards: int) -> int:
    return xxhash.xxh64_intdigest(key.encode(), seed=977) % shards


def _bits(key: str, level: int, bits: int) -> list[int]:
    return [xxhash.xxh64_intdigest(key.encode(), seed=1000 * level + j) % bits for j in range((LATER if level else FIRST)[1])]


def _holds(levels: Sequence[tuple[int, bytes]], key: str, level: int) -> bool:
    bits, data = levels[level]
    return all(data[b >> 3] >> (b & 7) & 1 for b in _bits(key, level, bits)) if bits else False


def member(levels: Sequence[tuple[int, bytes]], key: str) -> bool:
    """Whether a shard's cascade lists key: the first level that misses it decides."""
    for level in range(len(levels)):
        if not _holds(levels, key, level):
            return level % 2 == 1
    return len(levels) % 2 == 1


class Cascade:
    """shards[s]: that shard's levels, each (bits, filter bytes)."""

    def __init__(self, shards: list[list[tuple[int, bytes]]]):
        self.shards = shards

    def bytes(self) -> int:
        return sum(len(d) for s in self.shards for _, d in s)

    def __contains__(self, key: str) -> bool:
        return member(self.shards[_shard(key, len(self.shards))], key)


def build_cascade(universe: DataFrame, listed: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> Cascade:
    """universe, listed: one column ``key`` each. Each level is one aggregation by filter word;
    the driver gets the filters' words only, some ten bits a listed key in all."""
    listed = listed.select("key").where("key is not null").distinct()
    shards = max(1, -(-listed.count() // keys_per_shard))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_shard(k, shards) for k in b.column(0).to_pylist()], pa.int32())], ["key", "shard"])

    mark = lambda df: df.mapInArrow(placed, "key string, shard int")
    include = staged(mark(listed), "cascade-in")
    exclude = staged(mark(universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti")), "cascade-out")
    built: list[list[tuple[int, bytes]]] = [[] for _ in range(shards)]
    level = 0
    while True:
        counts = {r["shard"]: r["n"] for r in include.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        sizes = [-(-counts.get(s, 0) * (LATER if level else FIRST)[0] // 64) * 64 for s in range(shards)]

        def words(batches: Iterator[pa.RecordBatch], level=level, sizes=sizes) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got: dict[tuple[int, int], int] = {}
                for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for x in _bits(key, level, sizes[s]):
                        got[s, x >> 6] = got.get((s, x >> 6), 0) | 1 << (x & 63)
                vals = np.array(list(got.values()), dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.int32()), pa.array([k[1] for k in got], pa.int64()), pa.array(vals, pa.int64())], ["shard", "word", "mask"])

        tables = [np.zeros(n // 64, np.uint64) for n in sizes]
        for r in include.mapInArrow(words, "shard int, word long, mask long").groupBy("shard", "word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            tables[r["shard"]][r["word"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
        for s in range(shards):
            built[s].append((sizes[s], tables[s].tobytes()))

        def passed(batches: Iterator[pa.RecordBatch], level=level, built=[list(x) for x in built]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([_holds(built[s], k, level) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.bool_()))

        wrong = staged(exclude.mapInArrow(passed, "key string, shard int"), "cascade-fp")
        include, exclude, level = wrong, include, level + 1
    return Cascade(built)


def mark_listed(df: DataFrame, cascade: Cascade, keys: str = "keys", out: str = "listed", max_bytes: int = 32 << 20) -> DataFrame:
    """df with ``out``: whether any string of the array column ``keys`` is listed. One pass where
    the filters take max_bytes or less, else one for each group of shards that does."""
    groups: list[dict[int, list]] = [{}]
    for s, levels in enumerate(cascade.shards):
        if groups[-1] and sum(len(d) for x in groups[-1].values() for _, d in x) + sum(len(d) for _, d in levels) > max_bytes:
            groups.append({})
        groups[-1][s] = levels
    total = len(cascade.shards)
    df = df.withColumn(out, F.lit(False))
    for i, group in enumerate(groups):
        def look(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, was = b.schema.get_field_index(keys), b.schema.get_field_index(out)
                hit = [w or any(member(group[s], k) for k in ks or () if (s := _shard(k, total)) in group) for ks, w in zip(b.column(at).to_pylist(), b.column(was).to_pylist())]
                yield b.set_column(was, out, pa.array(hit, pa.bool_()))

        df = df.mapInArrow(look, df.schema)
        if i + 1 < len(groups):
            df = staged(df, "listed")
    return df


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Iterable[str] | DataFrame = LISTED, url: str = "url", id_col: str = "page_id", max_bytes: int = 32 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    spark: SparkSession = pages.sparkSession
    host, path = url_parts(F.col(url))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # hosts first: few against urls, and a common one is pre-aggregated before the shuffle
    universe = p.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(k,) for k in listed], "key string")
    cascade = build_cascade(universe, listed)
    p = mark_listed(p.withColumn("keys", domains(F.col("host"))), cascade, max_bytes=max_bytes)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return p.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )
