"""The contract's queries opN_<name> and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, fingerprints, jaccard, media, mixing, secrets_scan, token_files, toxicity, url_filter
from .common import staged, table


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write_tokens(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), end_id=1)
    return token_files.token_digests(written)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.Codec.from_ranks_file(_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), codec)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].drop("row")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_digests(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    p = chat_format.parse_chats(staged(chat_format.format_chats(turns), "chats"))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return p.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listing.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_toxicity, op3_byte_bpe, op4_url_filter, op5_fingerprints, op6_jaccard_join, op7_mixing, op8_secret_scan, op9_chat_format, op10_media)}

_LISTED = ", ".join(f"'{k}'" for k in url_filter.LISTED)
SQL = {
    "op4_url_filter": rf"""
with p as (select page_id, coalesce(url, '') as u from pages),
r as (select page_id, case when position('://' in u) > 0 then substr(u, position('://' in u) + 3) else '' end as rest from p),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from r),
k as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from h),
c as (select *, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule,
  len(list_filter([{_LISTED}], lambda x: host = x or ends_with(host, '.' || x))) > 0 as listed from k)
select page_id, host, path, rule, listed,
  case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' when rule is not null then 'allow'
       when listed then 'block' else 'allow' end as verdict from c""",
    "op7_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as u, md5(coalesce(text, '')) as r, coalesce('s' || source, '') as key from documents),
s as (select key, any_value(source) as source, sum(size)::bigint as source_size from d group by key),
n as (select *, row_number() over (order by source is null, source) - 1 as nth from s),
w as (select *, case nth % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2 as cap from n),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, nth rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, nth rows between current row and unbounded following) as level from w),
a as (select *, first_value(level) over (order by (case when level * weight < cap then 0 else 1 end), cap / weight, nth) as lev,
      max(case when level * weight < cap then 1 else 0 end) over () as any_open from l),
t as (select key, source_size, least(cap::double, case when any_open = 1 then lev * weight else cap::double end) as target from a),
o as (select d.doc_id, d.size, d.u, d.r, t.source_size, t.target, sum(d.size) over (partition by d.key order by d.u, d.doc_id rows unbounded preceding)::bigint as upto
      from d join t using (key)),
c as (select *, floor(target)::bigint as f from o)
select doc_id, size, source_size, target,
  (least(upto, f) - least(upto - size, f) + least(upto + source_size, f) - least(upto + source_size - size, f))::bigint as taken from c""",
    "op9_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as prior,
  length(text) + 3 * (length(text) - length(translate(text, '<>[]', ''))) + 4 * (length(text) - length(replace(text, '&', ''))) as n,
  length(role) + 3 * (length(role) - length(translate(role, '<>[]', ''))) + 4 * (length(role) - length(replace(role, '&', ''))) as m from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n + case when prior is null then 5 + m + 4 when prior = role then 3 else 5 + m + 4 end)::bigint as formatted_chars
from e group by conv_id""",
}
