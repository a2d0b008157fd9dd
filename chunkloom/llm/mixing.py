"""Mixing sources to target weights by weighted fair queueing, natively.

Each source's documents, shuffled by a hash, wait in a queue, as often as ``repeats`` allows. A
copy's virtual finish time is the source's words up to and with it, divided by the source's
target. Copies are range-sorted by finish time over all sources and the order is truncated at the
total budget; the copy in service when its source's target is full is cut there, at time 1.

Running sums are kept in two levels (slots of the hash within a source, then rows of a slot;
ranges of finish time, then rows of a range), so no task holds a whole source.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source
of its own, last in order; rows with the same doc_id count as documents of their own and are told
apart by their text; an empty table gives no rows. The table of sources (a row for each) is
ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, once, replaced, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
SLOT_DIGITS, RANGES = 3, 4096


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources: source, source_size. Adds weight and target: shares of the budget by weight, none
    above repeats times the source's size, what is cut reshared by weight. Sorted by cap over
    weight, the capped sources come first; the level is set by the first source that is not."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("nth", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = s.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(repeats)})
    by = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    every = Window.partitionBy()
    s = s.withColumns({
        "budget": F.lit(float(share)) * F.sum("source_size").over(every),
        "before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    s = s.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    s = s.withColumn("at", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(per document, order of the mix). Per document: doc_id, size, source_size, target, taken,
    row (a hash of the text, which tells apart rows of one doc_id). Order: doc_id, row, copy,
    words, finish, upto (words of the mix up to and with this copy), for every copy taken."""
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("row"))
    d = d.withColumn("u", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("row")).cast("binary")))
    d = staged(d.withColumns({"slot": F.substring("u", 1, SLOT_DIGITS), "key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))}), "mix-docs")
    slots = d.groupBy("source", "key", "slot").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("base", F.coalesce(F.sum("words").over(w), F.lit(0)))
    targets = source_targets(slots.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    d = d.drop("source").join(slots.select("key", "slot", "base").join(targets, "key"), ["key", "slot"])
    inner = Window.partitionBy("key", "slot").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.col("base") + F.sum("size").over(inner))
    full = F.floor(F.col("target")).cast("long")
    copies = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    end = F.col("upto") + F.col("copy") * F.col("source_size")
    copies = copies.withColumns({"words": F.greatest(F.lit(0), F.least(end, full) - F.least(end - F.col("size"), full)), "finish": F.least(F.lit(1.0), end / F.col("target"))})
    copies = copies.where("words > 0").withColumn("bin", F.floor(F.col("finish") * RANGES).cast("int"))
    bins = copies.groupBy("bin").agg(F.sum("words").alias("n"))
    bins = bins.select("bin", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = Window.partitionBy("bin").orderBy("finish", "u", "copy", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = copies.join(F.broadcast(bins), "bin")  # at most RANGES + 1 rows
    budget = targets.agg(F.floor(F.sum("target") + 0.5).cast("long").alias("budget"))
    order = order.withColumn("upto", F.col("before") + F.sum("words").over(rank)).join(F.broadcast(budget))  # one row
    left = F.col("budget") - (F.col("upto") - F.col("words"))
    order = order.withColumn("words", F.greatest(F.lit(0), F.least(F.col("words"), left))).where("words > 0")
    order = staged(order.select("doc_id", "row", "copy", "words", "finish", F.least("upto", "budget").alias("upto")), "mix-order")
    # repeated rows are alike, so each gets the mean of what they took; sums stay whole
    taken = order.groupBy(F.col("doc_id").alias("i"), F.col("row").alias("r")).agg(F.sum("words").alias("all"))
    alike = Window.partitionBy("doc_id", "row").orderBy("u")
    many = Window.partitionBy("doc_id", "row")
    d = d.withColumns({"k": F.row_number().over(alike), "n": F.count("*").over(many)})
    d = d.join(taken, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left")
    got = F.coalesce("all", F.lit(0))
    share_of = F.floor(got / F.col("n")).cast("long") + F.when(F.col("k") <= got % F.col("n"), 1).otherwise(0)
    return d.select("doc_id", "size", "source_size", "target", share_of.cast("long").alias("taken"), "row"), order


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs' columns, whatever their names, each document as often as the mix takes it; a copy that is cut
    keeps its first words, with a space between. Rows alike in doc_id and text count as one: that whose
    other columns have the smallest digest, so reruns agree however the rows are dealt."""
    d = once(boxed(docs, F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    _, order = mix(d.select(F.col("id").alias("doc_id"), F.col("d.source").alias("source"), F.col("d.text").alias("text")), **options)
    order = order.select(F.col("doc_id").alias("i"), F.col("row").alias("r"), "words")
    out = d.join(order, F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")))
    text = F.col("d.text")
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.col("words") < word_count(text)
    return out.select(replaced(F.col("d"), docs, F.when(cut, short).otherwise(text), cut).alias("d")).select("d.*")
