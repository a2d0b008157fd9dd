"""Chat formatting by relational expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role merged by
array functions, and joined to one string. Control strings: ``<s>[role]`` opens a block, ``[+]``
stands between the merged turns of a block, ``</s>`` closes it. All of them hold ``<`` or ``[``;
inside texts and roles the five characters & < > [ ] become the references in ESCAPES, so no text can
hold a control string, and unescaping gives the text back.

Defined results: a null text or role counts as empty; turns sort by turn (nulls first), then role,
then text; repeated rows stay as turns of their own; rows with a null conv_id form one
conversation; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in the order of escaping; unescaping goes backwards.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;")]
OPEN, MID, JOIN, CLOSE = "<s>[", "]", "[+]", "</s>"


def escape(c: Column) -> Column:
    for plain, ref in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(ref))
    return c


def unescape(c: Column) -> Column:
    for plain, ref in reversed(ESCAPES):
        c = F.replace(c, F.lit(ref), F.lit(plain))
    return c


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of start, length in code
    points of ``formatted``, one per turn of a loss role, in order)."""
    t = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"esc": escape(F.col("text")), "tag": escape(F.col("role"))})
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    prior = F.lag("role").over(w)
    opening = F.concat(F.lit(OPEN), F.col("tag"), F.lit(MID))
    t = t.withColumn(
        "lead_in",
        F.when(prior.isNull(), opening).when(prior == F.col("role"), F.lit(JOIN)).otherwise(F.concat(F.lit(CLOSE), opening)),
    )
    # where the turn's text starts: all that stands before it, by a running sum over the rows
    t = t.withColumns({
        "pos": F.row_number().over(w),
        "at": F.sum(F.length("lead_in") + F.length("esc")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("esc"),
    })
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "tag", "esc", "at"))).alias("t")
    )
    n = F.size("t")
    firsts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]),
    )
    g = g.withColumn("b", firsts)

    def block(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("b", k + 1), n)
        texts = F.transform(F.slice("t", i + 1, end - i), lambda x: x["esc"])
        return F.concat(F.lit(OPEN), F.get("t", i)["tag"], F.lit(MID), F.array_join(texts, JOIN), F.lit(CLOSE))

    mask = F.transform(
        F.filter("t", lambda x: x["role"].isin(*loss_roles)),
        lambda x: F.struct(x["at"].alias("start"), F.length(x["esc"]).cast("long").alias("length")),
    )
    return g.select("conv_id", F.array_join(F.transform("b", block), "").alias("formatted"), mask.alias("loss_mask"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """formatted rows back to conv_id, turns (array of role, text), loss_text, formatted_chars."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda x: x != "")

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), MID, 1))
        # the role holds no ] any more, so the first one ends it
        body = F.substr(b, F.instr(b, MID) + 1)
        return F.transform(F.split(body, r"\[\+\]", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    def cut(m: Column) -> Column:
        return unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))

    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.array_join(F.transform("loss_mask", cut), "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
