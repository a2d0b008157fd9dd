"""SimHash fingerprints, natively.

Terms are pairs of neighbouring words, weighted by the first word's length, up to HEAVIEST; a term's
64-bit hash votes, with its weight, for or against each bit of the fingerprint. Votes are counted for two bits in one
long: 32 sums of ``weight * (hash >> k & 0x0000000100000001)``, so all stays in generated code. Each
document's terms are summed where they are made; only sums could ever be shuffled.

Near fingerprints are found by permuted block tables: 64 bits in ``b`` blocks; two fingerprints
within radius r agree on b - r blocks at least, so each choice of b - r blocks is a table keyed by
those blocks' bits, and candidates of an equal key are checked exactly.

Defined results: a null text counts as empty; a text of less than two words has one term, all of
it; equal texts have equal fingerprints; the order of documents is by descending doc_id, nulls
last, equal ids by their text; a lone document is its own next one; repeated rows stay; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LANES = 0x0000000100000001
LOW = 0xFFFFFFFF
#: Weights go up to this; a document's weights may add up to 2**32.
HEAVIEST = 12
RADIUS = 3


def terms(text: Column) -> Column:
    """Array of (h, w)."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    # zipped, not indexed: a lambda would split the text anew for each word
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.size(words)),
        lambda x, y: F.struct(F.xxhash64(x, y).alias("h"), F.least(F.lit(HEAVIEST), F.length(x)).cast("long").alias("w")),
    )
    whole = F.array(F.struct(F.xxhash64(F.array_join(words, " ")).alias("h"), F.lit(1).cast("long").alias("w")))
    return F.when(F.size(words) < 2, whole).otherwise(pairs)


def votes(h: Column, w: Column) -> list[Column]:
    return [F.sum(w * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{k}") for k in range(32)] + [F.sum(w).alias("all")]


def fingerprint() -> Column:
    """The long whose set bits are those with more than half of all weight."""
    out = F.lit(0).cast("long")
    for k in range(32):
        for bit, n in ((k, F.col(f"v{k}").bitwiseAND(F.lit(LOW))), (k + 32, F.shiftrightunsigned(F.col(f"v{k}"), 32))):
            out = out.bitwiseOR(F.when(n * 2 > F.col("all"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return out


def written(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bounds_of(docs: DataFrame, c: str, n: int) -> list[int]:
    """n approximate quantiles of an integer column: the lower ends of ranges, n a power of two less 1."""
    row = docs.agg(F.percentile_approx(F.col(c).cast("long"), [(i + 1) / (n + 1) for i in range(n)], 10 * n).alias("q")).first()
    return list(row["q"] or [])


def range_of(c: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below c, by binary search; -1 for null."""
    if not bounds:
        return F.when(c.isNull(), -1).otherwise(0)
    steps = int(math.log2(len(bounds) + 1))
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    got = F.aggregate(powers, F.lit(0), lambda at, k: F.when(F.get(every, at + k - 1) <= c, at + k).otherwise(at))
    return F.when(c.isNull(), -1).otherwise(got)


def near_fingerprints(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """fps: fp, n (how many documents have it), distinct; queries: fp, distinct. Returns fp, near_docs:
    documents whose fingerprint is within radius, itself included. blocks: so many that a table's
    key has more bits than the number of fingerprints, unless given."""
    if blocks is None:
        need = max(16.0, math.log2(max(2, fps.count())))
        blocks = next((b for b in range(radius + 1, 17) if 64 * (b - radius) / b >= need), 16)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    left = queries.select(F.col("fp").alias("q"), F.explode(keys).alias("key"))
    right = fps.select("fp", "n", F.explode(keys).alias("key"))
    pairs = left.join(right, "key").where(distance(F.col("q"), F.col("fp")) <= radius)
    # a pair meets in several tables: counted once
    return pairs.groupBy("q", "fp").agg(F.first("n").alias("n")).groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("near_docs"))


def edited_fingerprints(docs: DataFrame, query_mod: int = 100, radius: int = RADIUS) -> DataFrame:
    """The contract's columns, and near_docs: for ids divisible by query_mod, how many other
    documents have a fingerprint within radius; null for all others."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = (1 << max(3, math.ceil(math.log2(4 * parts)))) - 1
    bounds = bounds_of(docs, "doc_id", n)
    d = d.withColumn("range", range_of(F.col("doc_id"), bounds)).withColumn("guest", F.lit(False))
    # each range's first document is a guest at the end of the range before it, so that its last
    # document finds the next one; a row for each range
    order = Window.orderBy(F.col("range").desc())
    heads = d.select("range", "doc_id").groupBy("range").agg(F.max("doc_id").alias("head"))
    heads = heads.withColumn("to", F.coalesce(F.lag("range").over(order), F.min("range").over(Window.partitionBy())))
    first = d.join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    rows = d.unionByName(first.select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("guest")))
    w = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = rows.withColumns({"next": F.lead("text").over(w), "at": F.row_number().over(w), "n_chars": F.length("text").cast("long")})
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("next", F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(~F.col("guest"), edited))
    tag = lambda t, k: F.transform(t, lambda x: F.struct(F.lit(k).alias("of"), x["h"].alias("h"), x["w"].alias("w")))
    both = F.concat(tag(terms(F.col("text")), 0), F.when(F.col("guest"), F.array().cast("array<struct<of:int,h:bigint,w:bigint>>")).otherwise(tag(terms(F.col("edited")), 1)))
    own = ["range", "at", "guest", "doc_id", "n_chars", "sha"]
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    voted = rows.select(*own, F.explode(both).alias("x")).select(*own, "x.of", "x.h", "x.w")
    fps = voted.groupBy(*own, "of").agg(*votes(F.col("h"), F.col("w"))).select(*own, "of", fingerprint().alias("fp"))
    fps = fps.groupBy(*own).agg(F.max(F.when(F.col("of") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("of") == 1, F.col("fp"))).alias("edited_fp"))
    fps = fps.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("range").orderBy("at"))).where(~F.col("guest"))
    like = lambda c: (F.lit(1.0) - distance(F.col("fp"), F.col(c)) / F.lit(64.0))
    out = staged(fps.select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), "fp", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"), like("edited_fp").alias("near_edited"), like("next_fp").alias("near_next")), "fingerprints")
    asked = F.coalesce(F.col("doc_id") % query_mod == 0, F.lit(False))
    known = staged(out.groupBy("fp").agg(F.count("*").alias("n"), F.max(asked).alias("asked")), "fingerprints-known")
    near = near_fingerprints(known.select("fp", "n"), known.where("asked").select("fp"), radius)
    found = out.where(asked).join(near, "fp").withColumn("near_docs", F.col("near_docs") - 1)
    rest = out.where(~asked).withColumn("near_docs", F.lit(None).cast("long"))
    return found.unionByName(rest).drop("fp")
