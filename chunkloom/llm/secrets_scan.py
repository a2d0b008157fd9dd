"""Secret scans over a ledger of blobs, natively.

Every version of a document is content-addressed by the SHA-256 of its text. The ledger holds, for
each blob and rule version scanned, what was found; a scan takes the versions whose (blob, rule
version) the ledger has not, reads each such blob once, appends, and joins findings back to all
paths (documents) that hold the blob.

Spans are kind:start:end in code points, end exclusive. Regular expressions give the matches and
the pieces between them; lengths, added up, give the places.

Defined results: a null text counts as empty (no findings); repeated rows and repeated ids give a
row each; other columns are ignored; an empty table gives no rows and leaves the ledger as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, new_path, replaced

RULE_VERSION = "1.1"
_BASE64 = "A-Za-z0-9+/_.=-"

# A private key runs from its BEGIN through the next END of one. Where another BEGIN or END, or the
# end of the text, comes first, it runs over what looks like a key: header fields, whole lines of
# base64 characters, and runs of 16 or more of them with the rest that follows the last one.
# Loops are possessive: Java runs those without recursion, and no text is read twice.
_KEY_NAME = r"[A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_INNER = r"(?:[^-]|-(?!----(?:BEGIN|END) ))*+"
_GAP = r"""(?:[\s>#*|"'`,;]|\\+[nrt"']|\+(?=\s))*+"""
_RUN = "[A-Za-z0-9+/=]"
_FIELDS = rf"(?:{_GAP}(?:(?:Proc-Type|DEK-Info):\x20?[^\s\\]*+|(?:Version|Comment|Hash|Charset|MessageID):[^\r\n\\]*+))*+"
_LINES = rf"""(?:{_GAP}{_RUN}{{16,}}+|[\x20\t"'`,;+]*+(?:[\r\n]|\\+[rn]){_GAP}{_RUN}++(?=[\x20\t"'`,;+]*+(?:[\r\n\\]|$)))"""
_REST = rf"(?:[\x20\t]++{_RUN}++|{_GAP}[A-Za-z]*+[0-9+/=]{_RUN}*+)?+(?:{_GAP}={_RUN}{{4}})?+"
_PEM = rf"-----BEGIN {_KEY_NAME}(?:{_INNER}-----END {_KEY_NAME}|{_FIELDS}(?:{_LINES}++{_REST})?+)"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and without overlap; those stay whose group is long enough."""

    kind: str
    pattern: str
    group: int
    least: int
    #: A cheap test that every text with a match passes.
    hint: str


BASE = [
    Rule("assign", rf"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([{_BASE64}]+)""", 2, 8, r"(?i:word|passwd|secret|token|key)[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
]
#: Kinds that this operator adds.
MORE = [
    Rule("pem", _PEM, 0, 1, r"PRIVATE KEY(?: BLOCK)?-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, r"gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1, "eyJ"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abprs]-"),
]
#: Matches of a block, whose places are summed up together.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value made once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def before(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each of values, array of int from 0 on, what both makes of all that come before it, from 0 on. In
    two levels: first over blocks of values, then within each block, so no value copies all before it."""
    grow = lambda acc, x: F.concat(acc, F.array(both(F.element_at(acc, -1), x)))
    within = lambda b, at: F.slice(F.aggregate(b, F.array(at), grow), F.lit(1), F.size(b))

    def over(blocks: Column) -> Column:
        bases = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), both)), F.array(F.lit(0)), grow)
        return F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), within))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(cut(v), over)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (start, kind's number, end)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    sizes = F.transform(
        F.arrays_zip(found.alias("m"), held.alias("g"), between.alias("b")),
        lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("len"), F.length(x["g"]).alias("held")),
    )

    def placed(z: Column) -> Column:
        ahead = before(F.transform(z, lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0))), lambda a, b: a + b)
        each = F.zip_with(z, ahead, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["len"]).alias("end"), x["held"].alias("held")))
        # the last piece has no match after it, so nothing held
        return F.filter(each, lambda x: F.coalesce(x["held"] >= rule.least, F.lit(False)))

    got = F.transform(bound(sizes, placed), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(rule.hint), got).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame, rules: list[Rule] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """blobs: blob, text -> blob, found (array of start, kind, end by start, then kind)."""
    text = F.col("text")
    each = [spans(text, r, i) for i, r in enumerate(rules)]
    hit = text.rlike("|".join(f"(?:{r.hint})" for r in rules))
    return blobs.select("blob", F.when(hit, F.array_sort(F.concat(*each))).otherwise(F.array().cast(SPAN)).alias("found"))


def written(found: Column, rules: list[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def update_ledger(versions: DataFrame, ledger: DataFrame | None, rules: list[Rule], rule_version: str) -> DataFrame:
    """versions: path, text, blob. Rows to append: blob, rule_version, found, for every pair that the
    ledger lacks. A blob is read at one of its paths: copies move no text."""
    unseen = versions.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("z"), "path"))["path"].alias("at"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    texts = versions.select("blob", "path", "text").alias("v").join(unseen.alias("u"), (F.col("v.blob") == F.col("u.blob")) & F.col("v.path").eqNullSafe(F.col("u.at")), "left_semi")
    found = scan(texts, rules).groupBy("blob").agg(F.first("found").alias("found"))
    return found.select("blob", F.lit(rule_version).alias("rule_version"), "found")


def blob_of(text: str) -> Column:
    """A blob's name: the hash of the text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def ledger_hits(versions: DataFrame, ledger_path: str | None = None, rules: list[Rule] = BASE + MORE, rule_version: str = RULE_VERSION) -> DataFrame:
    """versions: path, text, blob. Brings the ledger at ledger_path (one of its own, if None) up to
    date; returns blob, found for the blobs with findings."""
    spark = versions.sparkSession
    path = ledger_path or new_path(spark, "ledger")
    schema = f"blob binary, rule_version string, found {SPAN}"
    old = None
    if ledger_path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.schema(schema).parquet(path)
    new = update_ledger(versions, old, rules, rule_version)
    new.write.mode("append").option("compression", "zstd").parquet(path)
    ledger = spark.read.schema(schema).parquet(path)
    return ledger.where((F.col("rule_version") == rule_version) & (F.size("found") > 0)).select("blob", "found")


def scan_versions(versions: DataFrame, ledger_path: str | None = None, rules: list[Rule] = BASE + MORE, rule_version: str = RULE_VERSION) -> DataFrame:
    """versions: path, text (more columns are dropped). Returns path, found, for every row."""
    v = versions.select("path", F.coalesce("text", F.lit("")).alias("text"), blob_of("text").alias("blob"))
    out = v.select("path", "blob").join(ledger_hits(v, ledger_path, rules, rule_version), "blob", "left")
    return out.select("path", F.coalesce("found", F.array().cast(SPAN)).alias("found"))


def redact(text: Column, found: Column, rules: list[Rule] = BASE + MORE) -> Column:
    """text with every span of found replaced by its kind in brackets; of spans that overlap, the
    first one names the mask and the cover runs to the furthest end."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    ends = before(F.transform(found, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    each = F.zip_with(found, ends, lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at")))
    # a span that starts before the furthest end so far belongs to the cover before it
    pieces = F.transform(F.filter(each, lambda x: x["start"] >= x["at"]), lambda x: F.concat(F.substr(text, x["at"] + 1, x["start"] - x["at"]), F.lit("["), F.get(names, x["kind"]), F.lit("]")))
    rest = F.substr(text, F.array_max(F.transform(found, lambda x: x["end"])) + 1)
    return F.when(F.size(found) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def redacted(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """docs, all columns, whatever their names: spans of texts masked, n_chars (where there is one) counted
    anew. Repeated rows stay; a null text stays null."""
    box = boxed(docs, blob_of("text"))
    versions = box.select(F.col("id").alias("path"), F.coalesce("d.text", F.lit("")).alias("text"), F.col("row").alias("blob"))
    out = box.join(ledger_hits(versions, ledger_path).withColumnRenamed("blob", "row"), "row", "left")
    text, hit = F.col("d.text"), F.col("found").isNotNull()
    return out.select(replaced(F.col("d"), docs, F.when(hit, redact(text, F.col("found"))).otherwise(text), hit).alias("d")).select("d.*")


def secret_digests(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    rules = BASE + MORE
    s = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"), ledger_path, rules)
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    return s.select(
        F.col("path").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written(base, rules).cast("binary"), 256).alias("base_sha256"), written(F.col("found"), rules).alias("spans"),
    )
