"""The registered queries of the storage engine and their DuckDB SQL.

Chunks come by content-defined cuts (target 1024) where the query's name ends in ``_cdc`` or says
chunk_lengths, else by lines: the operators take any chunk table, and each of them is held against
SQL over both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gear, hashes, text
from ..functions.hashes import chunk_hash, file_root, pack_root, verification
from ..operators import chunking, dedup, packing, ranges, reconstruct
from ..sources import assemble, formats, packs, shards

PACK = 262_144
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_chunks(read(spark, sf_dir, "documents"), "doc_id", "text")


LINES = """l as (select doc_id as file, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, len(string_split(text, chr(10))) as n from documents),
c0 as (select file, pos::bigint as chunk_ord, case when pos + 1 < n then line || chr(10) else line end as chunk from l),
c as (select file, chunk_ord, strlen(chunk)::bigint as length, sha256(chunk) as chunk_key, chunk from c0 where strlen(chunk) > 0)"""
_FIRST = """,
f as (select *, first_value(file) over w as first_file, first_value(chunk_ord) over w as first_ord from c window w as (partition by chunk_key order by file, chunk_ord)),
m as (select *, file <> first_file or chunk_ord <> first_ord as is_dup from f)"""
#: New chunks in order with the bytes before each; then one step of recursion for each pack.
_PACKED = f""",
s as (select file, chunk_ord, length, chunk_key, row_number() over w as seq, sum(length) over (w rows unbounded preceding) as upto from m where not is_dup window w as (order by file, chunk_ord)),
p as (select 0::bigint as pack, 1::bigint as start, least((select min(seq) from s where upto > {PACK}), 8193)::bigint as stop
  union all
  select p.pack + 1, p.stop, least(coalesce(min(s.seq) filter (where s.upto > b.upto + {PACK} and s.seq > p.stop), 1099511627776), p.stop + 8192)
  from p join s b on b.seq = p.stop - 1 join s on s.seq >= p.stop group by p.pack, p.stop),
k as (select s.*, p.pack, (s.seq - p.start)::bigint as idx from s join p on s.seq >= p.start and s.seq < coalesce(p.stop, 1099511627776))"""
_TERMS = """,
pl as (select c.file, c.chunk_ord, c.length, k.pack, k.idx from c join k using (chunk_key)),
op as (select *, case when lag(pack) over w = pack and lag(idx) over w + 1 = idx then 0 else 1 end as opens from pl window w as (partition by file order by chunk_ord)),
tn as (select *, sum(opens) over (partition by file order by chunk_ord rows unbounded preceding) - 1 as term_ord from op),
t as (select file, term_ord::bigint as term_ord, min(pack)::bigint as pack, min(idx)::bigint as "start", (max(idx) + 1)::bigint as "end", sum(length)::bigint as unpacked_length, count(*)::bigint as chunks, min(chunk_ord)::bigint as first_chunk from tn group by file, term_ord)"""
FIRST = LINES + _FIRST
PACKED = FIRST + _PACKED
TERMS = PACKED + _TERMS


def packed_of(c: DataFrame) -> DataFrame:
    none = c.sparkSession.createDataFrame([], "chunk_key string")
    return packing.assign_packs(dedup.new_chunks(c, none), PACK)


def packed_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = lines(spark, sf_dir).drop("chunk")
    return c, packed_of(c)


def line_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, packed = packed_lines(spark, sf_dir)
    return packing.file_terms(packing.placements(c.select("file", "chunk_ord", "length", "chunk_key"), packed))


# Scans, chunks, hashes


def _cuts(target: int) -> str:
    """Common tables up to cut: file, chunk_ord, offset, e (the end), n."""
    least, most, bits = gear.limits(target)
    numbers = ", ".join(f"{int(x)}::hugeint" for x in gear.default_table())
    last, steps = "h0", []
    for i, k in enumerate((1, 2, 4, 8, 16, 32)):
        steps.append(f"h{i + 1} as (select file, i, (h + coalesce(lag(h, {k}) over (partition by file order by i), 0) * {1 << k}::hugeint) % 18446744073709551616::hugeint as h from {last})")
        last = f"h{i + 1}"
    return f"""d as (select doc_id as file, hex(encode(text)) as x, strlen(text)::bigint as n from documents where text <> ''),
b as (select file, x, unnest(range(1, n + 1)) as i from d),
h0 as (select file, i, ([{numbers}])[(instr('0123456789ABCDEF', substr(x, (2 * i - 1)::bigint, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, (2 * i)::bigint, 1))] as h from b),
{", ".join(steps)},
cand as (select file, i from {last} where h < {1 << (64 - bits)}::hugeint),
cut as (select file, 0::bigint as chunk_ord, 0::bigint as "offset", least(coalesce((select min(i) from cand where cand.file = d.file and i >= {least}), n), {most}, n)::bigint as e, n from d
  union all
  select cut.file, cut.chunk_ord + 1, cut.e, least(coalesce(min(cand.i), cut.n), cut.e + {most}, cut.n)::bigint, cut.n
  from cut left join cand on cand.file = cut.file and cand.i >= cut.e + {least} where cut.e < cut.n group by cut.file, cut.chunk_ord, cut.e, cut.n)"""


def _cuts_sql(target: int) -> str:
    return f"""with recursive {_cuts(target)} select file, chunk_ord, "offset", (e - "offset")::bigint as length from cut"""


#: The same tables over content-defined chunks.
CDC_FIRST = _cuts(1024) + """,
c as (select cut.file, chunk_ord, (e - "offset")::bigint as length, sha256(unhex(substr(x, 2 * "offset" + 1, 2 * (e - "offset")))) as chunk_key from cut join d on d.file = cut.file)""" + _FIRST
CDC_PACKED = CDC_FIRST + _PACKED
CDC_TERMS = CDC_PACKED + _TERMS


def cdc(spark: SparkSession, sf_dir: str, target: int) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return chunking.chunk_table(d, "doc_id", "content", target)


@query(_cuts_sql(1024))
def chunk_lengths_t1024(spark, sf_dir):
    return cdc(spark, sf_dir, 1024).select("file", "chunk_ord", "offset", "length")


@query(_cuts_sql(65_536))
def chunk_lengths_t65536(spark, sf_dir):
    return cdc(spark, sf_dir, 65_536).select("file", "chunk_ord", "offset", "length")


@query("select doc_id, sha256(text) as sha256, strlen(text)::bigint as bytes from documents")
def file_sha256(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query()
def chunk_hash_blake3(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", chunk_hash(F.col("text").cast("binary")).alias("chunk_hash"))


@query()
def file_hash_blake3(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    c = chunking.chunk_table(d, "doc_id", "content", 1024, keep_content=True).withColumn("hash", chunk_hash("chunk"))
    return packing.ordered(c).select("file", file_root("nodes").alias("file_hash"))


@query()
def pack_hash_blake3(spark, sf_dir):
    c = lines(spark, sf_dir)
    _, packed = packed_lines(spark, sf_dir)
    h = packed.join(c.select("file", "chunk_ord", chunk_hash(F.col("chunk").cast("binary")).alias("hash")), ["file", "chunk_ord"])
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash", "length"))), lambda x: F.struct(x["hash"].alias("hash"), x["length"].alias("length")))
    return h.groupBy("pack").agg(nodes.alias("nodes")).select("pack", pack_root("nodes").alias("pack_hash"))


@query()
def term_verification(spark, sf_dir):
    c = lines(spark, sf_dir).select("file", "chunk_ord", "length", "chunk_key", chunk_hash(F.col("chunk").cast("binary")).alias("hash"))
    placed = packing.placements(c, packed_of(c.drop("hash")))
    return packing.term_hashes(placed).select("file", "term_ord", verification("hashes").alias("verification"))


@query(f"""with recursive {TERMS} select file, term_ord::bigint as term_ord, sha256(string_agg(chunk_key, '' order by chunk_ord)) as digest
from (select tn.file, tn.chunk_ord, tn.term_ord, c.chunk_key from tn join c on c.file = tn.file and c.chunk_ord = tn.chunk_ord) group by file, term_ord""")
def term_digest(spark, sf_dir):
    """What term_verification hashes, by SHA-256 of the chunks' keys in order."""
    c, packed = packed_lines(spark, sf_dir)
    placed = packing.placements(c.select("file", "chunk_ord", "length", "chunk_key"), packed).withColumn("hash", F.col("chunk_key"))
    return packing.term_hashes(placed).select("file", "term_ord", F.sha2(F.array_join("hashes", "").cast("binary"), 256).alias("digest"))


@query("""with h as (select doc_id, sha256(text) as x from documents),
s as (select doc_id, x, list_aggregate([list_aggregate([substr(x, 16 * g + 2 * b + 1, 2) for b in [7, 6, 5, 4, 3, 2, 1, 0]], 'string_agg', '') for g in [0, 1, 2, 3]], 'string_agg', '') as swapped from h)
select doc_id, swapped, x as back from s""")
def hex_word_swap(spark, sf_dir):
    h = read(spark, sf_dir, "documents").select("doc_id", hashes.swapped(F.sha2(F.col("text").cast("binary"), 256)).alias("swapped"))
    return h.withColumn("back", hashes.swapped(F.col("swapped")))


@query(f"""with recursive {LINES}, h as (select distinct chunk_key from c),
v as (select chunk_key, (instr('0123456789abcdef', substr(chunk_key, 62, 1)) - 1) * 256 + (instr('0123456789abcdef', substr(chunk_key, 63, 1)) - 1) * 16 + instr('0123456789abcdef', substr(chunk_key, 64, 1)) - 1 as low from h)
select chunk_key, (low % 16)::bigint as rest from v where low % 16 = 0""")
def hash_mod_sample(spark, sf_dir):
    h = lines(spark, sf_dir).select("chunk_key").distinct()
    return h.where(dedup.is_eligible(F.col("chunk_key"), 16)).select("chunk_key", hashes.remainder_of(F.col("chunk_key"), 16).alias("rest"))


# Deduplication


@query(f"with recursive {FIRST} select file, chunk_ord, length, chunk_key, first_file, first_ord, is_dup from m")
def first_occurrence(spark, sf_dir):
    return dedup.first_occurrence(lines(spark, sf_dir).select("file", "chunk_ord", "length", "chunk_key"))


@query(f"""with recursive {FIRST} select source, count(*)::bigint as chunks, sum(length)::bigint as bytes, coalesce(sum(length) filter (where is_dup), 0)::bigint as dedup_bytes
from m join documents on doc_id = file group by source""")
def dedup_stats_by_source(spark, sf_dir):
    m = dedup.first_occurrence(lines(spark, sf_dir).select("file", "chunk_ord", "length", "chunk_key"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "source")
    return dedup.storage_stats(m.join(d, "file"), "source")


@query(f"""with recursive {FIRST} select file, count(*)::bigint as chunks, sum(length)::bigint as bytes, coalesce(sum(length) filter (where is_dup), 0)::bigint as dedup_bytes from m group by rollup (file)""")
def dedup_rollup(spark, sf_dir):
    return dedup.storage_stats(dedup.first_occurrence(lines(spark, sf_dir).select("file", "chunk_ord", "length", "chunk_key")), "file", rollup=True)


@query(f"""with recursive {FIRST}, st as (select distinct chunk_key from c where file in (select doc_id from labels where quality = 1))
select file, chunk_ord, length, chunk_key from m where not is_dup and chunk_key not in (select chunk_key from st)""")
def new_chunks_anti(spark, sf_dir):
    """What good documents hold counts as stored."""
    c = lines(spark, sf_dir)
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("file"))
    return dedup.new_chunks(c, c.join(good, "file", "left_semi"))


@query(f"""with recursive {LINES} select chunk_key, count(distinct file)::bigint as files, max(length)::bigint as length from c group by chunk_key having count(distinct file) > 1""")
def shared_chunks_between_docs(spark, sf_dir):
    return dedup.shared_chunks(lines(spark, sf_dir))


@query("select source || '/' || lang as path, count(*)::bigint as n from documents group by 1 having count(*) > 1")
def duplicate_paths(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang").alias("path"))
    return dedup.duplicate_paths(d, "path")


AS_OF = "2024-01-01 00:00:00"
LANGS = ["de", "en", "es", "fr"]


def _index(spark, sf_dir):
    """A shard of stored lines for each language; the first has expired, others have not or never do."""
    lang = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "lang")
    c = lines(spark, sf_dir).join(lang, "file")
    at = F.to_timestamp(F.lit(AS_OF))
    order = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    expiry = F.when(order == 0, at).when(order == 1, at + F.expr("interval 1 second"))
    return c.select(order.alias("shard_ord"), F.col("file").alias("pack"), F.col("chunk_ord").alias("idx"), "chunk_key", expiry.alias("expires_at"))


@query(f"""with recursive {LINES}, sh as (select list_position(['de', 'en', 'es', 'fr'], lang) - 1 as shard_ord, file as pack, chunk_ord as idx, chunk_key from c join documents on doc_id = file where lang <> 'de'),
b as (select *, row_number() over (partition by chunk_key order by shard_ord, pack, idx) as rn from sh)
select c.file, c.chunk_ord, b.shard_ord::bigint as shard_ord, b.pack, b.idx from c left join b on b.chunk_key = c.chunk_key and b.rn = 1""")
def shard_search(spark, sf_dir):
    found = dedup.probe(lines(spark, sf_dir).select("file", "chunk_ord", "chunk_key"), _index(spark, sf_dir), F.to_timestamp(F.lit(AS_OF)))
    return found.select("file", "chunk_ord", "shard_ord", "pack", "idx")


@query(SQL["shard_search"])
def hmac_probe(spark, sf_dir):
    key = "0123456789abcdef" * 4
    index = _index(spark, sf_dir)
    keyed = index.withColumn("chunk_key", hashes.hmac_of(F.col("chunk_key"), key))
    found = dedup.probe(lines(spark, sf_dir).select("file", "chunk_ord", "chunk_key"), keyed, F.to_timestamp(F.lit(AS_OF)), key)
    return found.select("file", "chunk_ord", "shard_ord", "pack", "idx")


# Packing and terms


@query(f"with recursive {PACKED} select file, chunk_ord, length, chunk_key, pack, idx from k")
def pack_assignment(spark, sf_dir):
    return packed_lines(spark, sf_dir)[1].drop("grp")


@query(f"with recursive {PACKED} select pack, idx, chunk_key, length, (coalesce(sum(length) over (partition by pack order by idx rows between unbounded preceding and 1 preceding), 0))::bigint as byte_range_start from k")
def pack_listing(spark, sf_dir):
    return packing.pack_listing(packed_lines(spark, sf_dir)[1]).select("pack", "idx", "chunk_key", "length", "byte_range_start")


@query(f"with recursive {TERMS} select * from t")
def file_terms(spark, sf_dir):
    return line_terms(spark, sf_dir).drop("grp")


@query(f"with recursive {TERMS} select file, count(*)::bigint as terms, sum(chunks)::bigint as chunks, sum(chunks)::double / count(*) as chunks_per_term from t group by file")
def fragmentation_stats(spark, sf_dir):
    g = line_terms(spark, sf_dir).groupBy("file").agg(F.count("*").alias("terms"), F.sum("chunks").alias("chunks"))
    return g.withColumn("chunks_per_term", F.col("chunks") / F.col("terms"))


@query(f"""with recursive {TERMS} select 48 * (3 + (select count(distinct file) from t) * 2 + (select count(*) from t) * 2 + (select count(distinct pack) from k) + (select count(*) from k))::bigint + 200 as shard_bytes""")
def shard_sizes(spark, sf_dir):
    c, packed = packed_lines(spark, sf_dir)
    t = line_terms(spark, sf_dir).agg((F.count_distinct("file") * 2 + F.count("*") * 2).alias("n"))
    p = packed.agg((F.count_distinct("pack") + F.count("*")).alias("m"))
    return t.join(F.broadcast(p)).select((F.lit(48) * (3 + F.col("n") + F.col("m")) + 200).alias("shard_bytes"))


# Reconstruction


@query(f"""with recursive {TERMS} select file, term_ord, pack, unnest(range("start", "end"))::bigint as idx from t""")
def term_expand(spark, sf_dir):
    return reconstruct.expand_terms(line_terms(spark, sf_dir)).select("file", "term_ord", "pack", "idx")


def _fetches(spark, sf_dir):
    """Ranges of 64 chunks of each pack, two to a fetch, and one that overlaps each fetch's first."""
    _, packed = packed_lines(spark, sf_dir)
    r = packed.groupBy("pack", F.floor(F.col("idx") / 64).alias("r")).agg((F.max("idx") + 1).alias("end"))
    own = r.select("pack", F.floor(F.col("r") / 2).alias("fetch_ord"), (F.col("r") % 2).alias("range_ord"), (F.col("r") * 64).alias("start"), "end")
    again = own.where("range_ord = 0").select("pack", "fetch_ord", F.lit(2).cast("long").alias("range_ord"), "start", "end")
    return own.unionByName(again)


PLAN = TERMS + """,
x as (select file, term_ord, pack, unnest(range("start", "end")) as idx from t),
y as (select *, idx // 128 as fetch_ord, (idx // 64) % 2 as range_ord from x),
z as (select *, case when lag(fetch_ord) over w = fetch_ord and lag(range_ord) over w = range_ord then 0 else 1 end as opens from y window w as (partition by file, term_ord order by idx)),
sg as (select *, sum(opens) over (partition by file, term_ord order by idx rows unbounded preceding) - 1 as segment from z),
plan as (select file, term_ord, pack, segment::bigint as segment, fetch_ord::bigint as fetch_ord, range_ord::bigint as range_ord, min(idx)::bigint as "start", (max(idx) + 1)::bigint as "end" from sg group by file, term_ord, pack, segment, fetch_ord, range_ord)"""


@query(f"with recursive {PLAN} select * from plan")
def range_plan(spark, sf_dir):
    return reconstruct.plan_ranges(line_terms(spark, sf_dir), _fetches(spark, sf_dir))


@query(f"""with recursive {PLAN}, g as (select file, pack, fetch_ord, min(struct_pack(a := term_ord, b := "start")) as first, max(term_ord) as last_term from plan group by file, pack, fetch_ord)
select file, pack, fetch_ord, (dense_rank() over (partition by file order by first) - 1)::bigint as use_ord, last_term from g""")
def fetch_liveness(spark, sf_dir):
    segments = reconstruct.plan_ranges(line_terms(spark, sf_dir), _fetches(spark, sf_dir))
    return reconstruct.fetch_liveness(segments).withColumn("use_ord", F.col("use_ord").cast("long"))


@query(f"""with recursive {TERMS}, x as (select file, term_ord, pack, unnest(range("start", "end"))::bigint as idx from t) select * from x where idx // 64 % 3 = 0""")
def coverage_violations(spark, sf_dir):
    some = _fetches(spark, sf_dir).where("start / 64 % 3 <> 0")
    return reconstruct.uncovered(line_terms(spark, sf_dir), some)


@query(f"""with recursive {LINES}, o as (select *, coalesce(sum(length) over (partition by file order by chunk_ord rows between unbounded preceding and 1 preceding), 0) as "offset" from c)
select file, chunk_ord, (least(length, 900 - "offset") - greatest(0, 100 - "offset"))::bigint as bytes from o where "offset" < 900 and "offset" + length > 100""")
def range_read_trim(spark, sf_dir):
    c = chunking.with_offsets(lines(spark, sf_dir)).withColumn("chunk", F.col("chunk").cast("binary"))
    return reconstruct.trim(c, F.lit(100), F.lit(900)).select("file", "chunk_ord", "bytes")


@query("select doc_id as file, sha256(text) as sha256, strlen(text)::bigint as bytes from documents where text <> ''")
def reconstruct_text(spark, sf_dir):
    """Every document rebuilt from its packs by its terms."""
    c, packed = packed_lines(spark, sf_dir)
    bodies = packed.join(lines(spark, sf_dir).select("file", "chunk_ord", "chunk"), ["file", "chunk_ord"]).select("pack", "idx", "length", F.col("chunk").cast("binary").alias("chunk"))
    placed = reconstruct.expand_terms(line_terms(spark, sf_dir).select("file", "term_ord", "pack", "start", "end")).join(bodies, ["pack", "idx"])
    pieces = placed.select("file", F.struct("term_ord", "idx").alias("chunk_ord"), F.col("chunk").alias("piece"))
    return reconstruct.concatenated(pieces).select("file", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


@query(f"with recursive {TERMS} select file, term_ord, unpacked_length + 1 as declared, unpacked_length as found from t where file % 10 = 3")
def verify_lengths(spark, sf_dir):
    c, packed = packed_lines(spark, sf_dir)
    t = line_terms(spark, sf_dir).withColumn("unpacked_length", F.col("unpacked_length") + F.when(F.col("file") % 10 == 3, 1).otherwise(0))
    return reconstruct.length_errors(t, packed)


# Codecs and formats


@query("""with d as (select doc_id, hex(encode(text)) as x, strlen(text) as n from documents)
select doc_id, lower(concat(list_aggregate([substr(x, 2 * i + 1, 2) for i in range(0, n, 4)], 'string_agg', ''), list_aggregate([substr(x, 2 * i + 1, 2) for i in range(1, n, 4)], 'string_agg', ''),
  list_aggregate([substr(x, 2 * i + 1, 2) for i in range(2, n, 4)], 'string_agg', ''), list_aggregate([substr(x, 2 * i + 1, 2) for i in range(3, n, 4)], 'string_agg', ''))) as grouped from d""")
def byte_group4(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("c"))
    return d.select("doc_id", F.lower(F.hex(packs.grouped("c"))).alias("grouped"))


def _choices(spark, sf_dir) -> DataFrame:
    @F.pandas_udf("struct<scheme:int,stored:bigint,raw:bigint>")
    def choose(c):
        import pandas as pd

        got = [packs.chosen(bytes(x)) for x in c]
        return pd.DataFrame({"scheme": [s for s, _ in got], "stored": [len(p) for _, p in got], "raw": [len(x) for x in c]})

    return read(spark, sf_dir, "documents").select("doc_id", choose(F.col("text").cast("binary")).alias("c")).select("doc_id", "c.*")


@query()
def compress_choice(spark, sf_dir):
    return _choices(spark, sf_dir)


@query("select doc_id, strlen(text)::bigint as raw, true as no_larger, true as raw_if_equal from documents")
def compress_bounds(spark, sf_dir):
    """What a choice of scheme must keep to: no stored form is larger, and only the raw one is as large."""
    c = _choices(spark, sf_dir)
    return c.select("doc_id", "raw", (F.col("stored") <= F.col("raw")).alias("no_larger"), ((F.col("stored") == F.col("raw")) == (F.col("scheme") == packs.RAW)).alias("raw_if_equal"))


@query(f"with recursive {PACKED} select pack, idx, chunk_key, length as raw from k")
def pack_roundtrip(spark, sf_dir):
    """Packs written to the binary format and read back."""
    _, packed = packed_lines(spark, sf_dir)
    bodies = packed.join(lines(spark, sf_dir).select("file", "chunk_ord", F.col("chunk").cast("binary").alias("chunk")), ["file", "chunk_ord"])
    return packs.explode_packs(packs.build_packs(bodies)).select("pack", F.col("idx").cast("long").alias("idx"), F.sha2("chunk", 256).alias("chunk_key"), "raw")


@query(f"""with recursive {TERMS} select sha256(file::varchar) as file_hash, term_ord, sha256('pack' || pack) as pack, unpacked_length, "start", "end" from t""")
def shard_roundtrip(spark, sf_dir):
    """Terms written as one shard for each file and read back."""
    t = line_terms(spark, sf_dir).select(F.sha2(F.col("file").cast("string").cast("binary"), 256).alias("file_hash"), "term_ord", F.sha2(F.concat(F.lit("pack"), "pack").cast("binary"), 256).alias("pack"), "unpacked_length", "start", "end")

    def write(pdf):
        import pandas as pd

        terms = tuple(shards.Term(r.pack, int(r.unpacked_length), int(r.start), int(r.end)) for r in pdf.sort_values("term_ord").itertuples())
        return pd.DataFrame({"path": [pdf["file_hash"].iloc[0]], "content": [shards.write_shard(shards.Shard((shards.File(pdf["file_hash"].iloc[0], terms),)))]})

    back = shards.read_shards(t.groupBy("file_hash").applyInPandas(write, "path string, content binary"), "terms")
    return back.select("file_hash", F.col("term_ord").cast("long").alias("term_ord"), "pack", "unpacked_length", "start", "end")


@query("""with f as (select doc_id::varchar as path, sha256(text) as s, strlen(text) as n from documents)
select sha256('{"key":"header","value":{"summary":"all","description":""}}' || chr(10) || string_agg('{"key":"lfsFile","value":{"path":"' || path || '","algo":"sha256","oid":"' || s || '","size":' || n || '}}' || chr(10), '' order by path)) as payload_sha256 from f""")
def commit_payload(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    return formats.commit_lines(d, "all").select(F.sha2(F.col("payload").cast("binary"), 256).alias("payload_sha256"))


@query("select source, case when count(*) = count(nullif(n_chars, 100)) then sum(n_chars)::bigint end as total from documents group by source")
def known_total_or_null(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("n", F.nullif("n_chars", F.lit(100)))
    return d.groupBy("source").agg(text.known_total(F.col("n")).alias("total"))


@query("""with u as (select page_id, url, (page_id * 1000)::bigint as done from pages)
select page_id, string_split(url, '?')[1] as redacted, regexp_matches(url, '^(?i:https?)://[^/?#]+') as is_http, 'bytes=' || page_id || '-' || (page_id + 9) || ',' || (page_id + 20) || '-' || (page_id + 29) as range_header,
  greatest(0.0::double, least(1.0::double, done::double / 50000)) as fraction, page_id as first, (page_id + 9)::bigint as last, 100::bigint as total from u""")
def text_formats(spark, sf_dir):
    u = read(spark, sf_dir, "pages")
    one = lambda a: F.struct((F.col("page_id") + a).alias("start"), (F.col("page_id") + a + 9).alias("end"))
    got = text.content_range(F.concat(F.lit("bytes "), F.col("page_id"), F.lit("-"), F.col("page_id") + 9, F.lit("/100")))
    return u.select("page_id", text.redact(F.col("url")).alias("redacted"), text.is_http(F.col("url")).alias("is_http"), text.range_header(F.array(one(0), one(20))).alias("range_header"), text.fraction(F.col("page_id") * 1000, F.lit(50_000)).alias("fraction"), got["start"].alias("first"), got["end"].alias("last"), got["total"].alias("total"))


@query("""select doc_id, case when doc_id % 7 = 0 then true else false end as whole,
  case when doc_id % 7 <> 0 and 100 < n_chars then 100::bigint end as "start", case when doc_id % 7 <> 0 and 100 < n_chars then least(299, n_chars - 1)::bigint end as "end" from documents""")
def range_normalized(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    all_ = F.col("doc_id") % 7 == 0
    r = reconstruct.normalized_range(F.when(all_, 0).otherwise(100).cast("long"), F.when(~all_, 200).cast("long"), F.col("n_chars"))
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("""select user_id::varchar as stream, count(*)::bigint as events, bool_or(event_type = 'purchase') as ended, count_if(event_type not in ('view', 'click', 'purchase'))::bigint as unknown from events group by 1""")
def event_streams(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("value"))
    return formats.events(e, "user_id", "value", ("purchase",), ("view", "click", "purchase"))


# The same operators over content-defined chunks


def cdc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc(spark, sf_dir, 1024).select("file", "chunk_ord", "length", "chunk_key")


@query(f"with recursive {CDC_FIRST} select file, chunk_ord, length, chunk_key, first_file, first_ord, is_dup from m")
def first_occurrence_cdc(spark, sf_dir):
    return dedup.first_occurrence(cdc_chunks(spark, sf_dir))


@query(f"""with recursive {CDC_FIRST} select source, count(*)::bigint as chunks, sum(length)::bigint as bytes, coalesce(sum(length) filter (where is_dup), 0)::bigint as dedup_bytes
from m join documents on doc_id = file group by source""")
def dedup_stats_cdc(spark, sf_dir):
    m = dedup.first_occurrence(cdc_chunks(spark, sf_dir))
    return dedup.storage_stats(m.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "source"), "file"), "source")


@query(f"with recursive {CDC_PACKED} select file, chunk_ord, length, chunk_key, pack, idx from k")
def pack_assignment_cdc(spark, sf_dir):
    return packed_of(cdc_chunks(spark, sf_dir)).drop("grp")


@query(f"with recursive {CDC_TERMS} select * from t")
def file_terms_cdc(spark, sf_dir):
    c = cdc_chunks(spark, sf_dir)
    return packing.file_terms(packing.placements(c, packed_of(c))).drop("grp")


@query("select doc_id as file, sha256(text) as sha256, strlen(text)::bigint as bytes from documents where text <> ''")
def reconstruct_cdc(spark, sf_dir):
    """Every document cut by content, packed, and rebuilt from the packs' bytes by its terms."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    c = chunking.chunk_table(d, "doc_id", "content", 1024, keep_content=True)
    slim = c.drop("chunk", "offset")
    packed = packed_of(slim)
    bodies = packed.join(c.select("file", "chunk_ord", "chunk"), ["file", "chunk_ord"]).select("pack", "idx", "chunk")
    terms = packing.file_terms(packing.placements(slim, packed)).select("file", "term_ord", "pack", "start", "end")
    pieces = reconstruct.expand_terms(terms).join(bodies, ["pack", "idx"]).select("file", F.struct("term_ord", "idx").alias("chunk_ord"), F.col("chunk").alias("piece"))
    return reconstruct.concatenated(pieces).select("file", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"))


# An upload against what is stored


_SHARDS = LINES + """,
sh as (select list_position(['de', 'en', 'es', 'fr'], lang) - 1 as shard_ord, file as pack, chunk_ord as idx, chunk_key from c join documents on doc_id = file where lang <> 'de'),
v as (select distinct chunk_key, (instr('0123456789abcdef', substr(chunk_key, 64, 1)) - 1) % 4 as rest from c),
asked as (select chunk_key from v where rest = 0 and chunk_key not in (select chunk_key from sh where shard_ord = 1))"""


def _at_hand(spark, sf_dir):
    """The shards at hand (English) and those of a service (all; the German one has expired)."""
    every = _index(spark, sf_dir)
    return every.where("shard_ord = 1"), every


@query(f"with recursive {_SHARDS} select chunk_key from asked")
def global_queries(spark, sf_dir):
    """Sampled keys, one in four, that the shards at hand lack."""
    return dedup.eligible_misses(lines(spark, sf_dir), _at_hand(spark, sf_dir)[0], 4)


@query(f"""with recursive {_SHARDS}, near as (select * from sh where shard_ord = 1 or shard_ord in (select shard_ord from sh where chunk_key in (select chunk_key from asked))),
b as (select *, row_number() over (partition by chunk_key order by shard_ord, pack, idx) as rn from near)
select b.chunk_key, b.pack, b.idx from b where rn = 1 and chunk_key in (select chunk_key from c)""")
def known_places(spark, sf_dir):
    hand, every = _at_hand(spark, sf_dir)
    return dedup.known_places(lines(spark, sf_dir).select("chunk_key"), hand, every, F.to_timestamp(F.lit(AS_OF)), 4)[0]


@query(f"with recursive {TERMS} select distinct pack from t where pack % 2 = 1")
def missing_packs(spark, sf_dir):
    """Packs that terms name, where the odd ones were not sent."""
    return dedup.missing_packs(line_terms(spark, sf_dir), packed_lines(spark, sf_dir)[1].where("pack % 2 = 0"))


# Trees


@query(f"""with recursive {LINES}, z0 as (select file, chunk_key, row_number() over (partition by file order by chunk_ord) - 1 as i, count(*) over (partition by file) as n from c),
z as (select file, i, n, (instr('0123456789abcdef', substr(chunk_key, 64, 1)) - 1) % 4 = 0 as hit from z0),
g as (select file, 0::bigint as group_ord, 0::bigint as "start", (min(i) + 1)::bigint as "end" from z where i = 8 or (i >= 2 and hit) or i = n - 1 group by file
  union all
  select g.file, g.group_ord + 1, g."end", (min(z.i) + 1)::bigint from g join z on z.file = g.file and z.i >= g."end"
  where z.i - g."end" = 8 or (z.i - g."end" >= 2 and hit) or z.i = n - 1 group by g.file, g.group_ord, g."end")
select file, group_ord, "start", "end" from g""")
def merkle_groups(spark, sf_dir):
    """Where each group of the lowest level ends, over the lines' SHA-256 keys."""
    nodes = packing.ordered(lines(spark, sf_dir).select("file", "chunk_ord", F.col("chunk_key").alias("hash"), "length"))
    ends = nodes.select("file", hashes.groups_of("nodes").alias("ends"))
    e = ends.select("file", F.posexplode("ends").alias("group_ord", "end"), "ends")
    return e.select("file", F.col("group_ord").cast("long").alias("group_ord"), F.coalesce(F.get("ends", F.col("group_ord") - 1), F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# Shards from tables


def _assembled(spark, sf_dir) -> DataFrame:
    """Four batches of files, and packs: each a shard, or several of 64 MiB at most, under one path, in pieces."""
    digest = lambda *parts: F.sha2(F.concat(*parts).cast("binary"), 256)
    c, packed = packed_lines(spark, sf_dir)
    sha = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    t = line_terms(spark, sf_dir).join(sha, "file")
    t = t.select((F.col("file") % 4).alias("batch"), digest(F.col("file").cast("string")).alias("file_hash"), "sha256", "term_ord", digest(F.lit("pack"), F.col("pack").cast("string")).alias("pack"), "unpacked_length", "start", "end", digest(F.lit("v"), F.col("term_ord").cast("string")).alias("verification"))
    p = packing.pack_listing(packed).withColumn("batch", F.col("pack") % 4)
    p = p.select("batch", digest(F.lit("pack"), F.col("pack").cast("string")).alias("pack"), "idx", F.col("chunk_key").alias("chunk_hash"), "byte_range_start", "length", (F.col("pack") + 7).alias("disk_bytes"))
    parts = [t.where(F.col("batch") < 2), t.where(F.col("batch") >= 2)]
    return assemble.write_shards(parts[0].unionByName(parts[1]), p, 5, 9, piece=shards.PIECE).withColumn("path", F.concat(F.lit("batch-"), "batch"))


@query(f"""with recursive {TERMS} select 'batch-' || (file % 4) as path, sha256(file::varchar) as file_hash, sha256(text) as sha256, term_ord::int as term_ord, sha256('pack' || pack) as pack, unpacked_length, "start", "end", sha256('v' || term_ord) as verification
from t join documents on doc_id = file""")
def assembled_terms(spark, sf_dir):
    return shards.read_shards(_assembled(spark, sf_dir), "terms")


@query(f"""with recursive {PACKED}, q as (select *, (sum(length) over (partition by pack order by idx) - length)::bigint as byte_range_start, (sum(length) over (partition by pack))::bigint as raw_bytes from k)
select 'batch-' || (pack % 4) as path, sha256('pack' || pack) as pack, raw_bytes, pack + 7 as disk_bytes, idx::int as idx, chunk_key as chunk_hash, byte_range_start, length from q""")
def assembled_chunks(spark, sf_dir):
    return shards.read_shards(_assembled(spark, sf_dir), "chunks")


@query(f"""with recursive {TERMS}, a as (select file % 4 as b, sum(unpacked_length) as m from t group by 1), d as (select pack % 4 as b, sum(length) as s from k group by 1), e as (select pack % 4 as b, sum(distinct pack + 7) as n from k group by 1)
select 'batch-' || coalesce(a.b, d.b) as path, '{hashes.ZERO}' as hmac_key, 5::bigint as created, 9::bigint as expires, coalesce(n, 0)::bigint as disk_bytes, coalesce(m, 0)::bigint as materialized_bytes, coalesce(s, 0)::bigint as stored_bytes
from a full join d on a.b = d.b left join e on e.b = coalesce(a.b, d.b)""")
def assembled_footers(spark, sf_dir):
    """By batch: the totals of all its shards."""
    f = shards.read_shards(_assembled(spark, sf_dir), "footers")
    sums = [F.sum(c).alias(c) for c in ("disk_bytes", "materialized_bytes", "stored_bytes")]
    return f.groupBy("path", "hmac_key", "created", "expires").agg(*sums)


# Ranges of packs


def _built(spark, sf_dir) -> DataFrame:
    _, packed = packed_lines(spark, sf_dir)
    return packs.build_packs(packed.join(lines(spark, sf_dir).select("file", "chunk_ord", F.col("chunk").cast("binary").alias("chunk")), ["file", "chunk_ord"]))


@query(f"with recursive {PACKED} select pack, idx::int as idx, length as raw from k")
def pack_headers(spark, sf_dir):
    """Headers alone: payloads are skipped."""
    return packs.explode_packs(_built(spark, sf_dir), decode=False).select("pack", "idx", "raw")


@query(f"with recursive {PACKED} select pack, idx, chunk_key, length as raw from k where idx between 2 and 5 and pack in (select pack from k where idx = 5)")
def pack_ranges(spark, sf_dir):
    """Chunks 2 to 5 of each pack, cut out of its bytes and read as a range."""
    built = _built(spark, sf_dir)
    at = packs.explode_packs(built, decode=False).where("idx between 2 and 5")
    span = at.groupBy("pack").agg(F.min("offset").alias("a"), F.max(F.col("offset") + packs.HEADER + F.col("stored")).alias("b"), F.count("*").alias("n")).where("n = 4")
    cut = built.join(span, "pack").select("pack", F.lit(2).cast("long").alias("first"), F.lit(4).cast("long").alias("count"), F.substr("data", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")).alias("data"))
    return packs.range_chunks(cut).select("pack", "idx", F.sha2("chunk", 256).alias("chunk_key"), "raw")


# Plans, answers and requests


@query(f"with recursive {TERMS} select file, sum(unpacked_length)::bigint as unpacked, (sum(unpacked_length) - file % 3)::bigint as content from t group by file")
def content_lengths(spark, sf_dir):
    return ranges.content_lengths(line_terms(spark, sf_dir).withColumn("offset", F.col("file") % 3))


@query("""select doc_id as file, doc_id % 3 as "offset", unnest([0, 1])::int as term_ord, unnest([source || 'a', source || 'b']) as pack, unnest([n_chars + 1, 7])::bigint as unpacked_length, unnest([0, 2])::bigint as "start", unnest([doc_id + 1, 3])::bigint as "end" from documents""")
def plan_terms(spark, sf_dir):
    """Plans of both versions, by turns, written as JSON and read."""
    return formats.plan_terms(_plans(spark, sf_dir))


@query("""select doc_id as file, source || 'a' as pack, 0::int as fetch_ord, 0::int as range_ord, 'https://h/' || doc_id as url, 0::bigint as "start", doc_id + 1 as "end", 5::bigint as first_byte, n_chars::bigint + 5 as last_byte from documents""")
def plan_fetches(spark, sf_dir):
    return formats.plan_fetches(_plans(spark, sf_dir))


def _plans(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    whole, last = span(F.lit(0), F.col("doc_id") + 1), span(F.lit(5), F.col("n_chars") + 5)
    url = F.concat(F.lit("https://h/"), F.col("doc_id"))
    terms = F.array(F.struct(F.concat("source", F.lit("a")).alias("hash"), (F.col("n_chars") + 1).alias("unpacked_length"), whole.alias("range")), F.struct(F.concat("source", F.lit("b")).alias("hash"), F.lit(7).cast(d.schema["n_chars"].dataType).alias("unpacked_length"), span(F.lit(2), F.lit(3).cast("long")).alias("range")))
    pack = F.concat("source", F.lit("a"))
    new = F.to_json(F.struct((F.col("doc_id") % 3).alias("offset_into_first_range"), terms.alias("terms"), F.create_map(pack, F.array(F.struct(url.alias("url"), F.array(F.struct(whole.alias("chunks"), last.alias("bytes"))).alias("ranges")))).alias("xorbs")))
    old = F.to_json(F.struct((F.col("doc_id") % 3).alias("offset_into_first_range"), terms.alias("terms"), F.create_map(pack, F.array(F.struct(whole.alias("range"), url.alias("url"), last.alias("url_range")))).alias("fetch_info")))
    return d.select(F.col("doc_id").alias("file"), F.when(F.col("doc_id") % 2 == 0, new).otherwise(old).alias("json")).select("file", formats.plan(F.col("json")).alias("plan"))


def _asked(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("fetch"), (F.col("doc_id") % 10).alias("range_ord"), (F.col("doc_id") * 100).alias("first_byte"), (F.col("doc_id") * 100 + F.col("n_chars") % 50).alias("last_byte"))


@query("""select doc_id // 10 as fetch, count(*)::bigint as ranges, sum(n_chars % 50 + 1)::bigint as bytes from documents group by 1""")
def fetch_byte_counts(spark, sf_dir):
    g = ranges.fetch_bytes(_asked(spark, sf_dir).withColumns({"file": F.lit(0), "pack": F.lit("p"), "fetch_ord": F.col("fetch")}))
    return g.select(F.col("fetch_ord").alias("fetch"), "ranges", "bytes")


@query("select doc_id // 10 as fetch, doc_id % 10 as range_ord, doc_id * 100 as first_byte, (doc_id * 100 + n_chars % 50)::bigint as last_byte from documents where doc_id % 4 = 0")
def unanswered_ranges(spark, sf_dir):
    """Ranges that a multipart answer lacks; the others' parts are written as one body a fetch and read."""
    asked = _asked(spark, sf_dir)
    some = asked.where((F.col("fetch") * 10 + F.col("range_ord")) % 4 != 0)
    part = F.concat(F.lit("--b\r\nContent-Range: bytes "), "first_byte", F.lit("-"), "last_byte", F.lit("/*\r\n\r\n"), F.repeat(F.lit("x"), (F.col("last_byte") - F.col("first_byte") + 1).cast("int")), F.lit("\r\n"))
    bodies = some.groupBy("fetch").agg(F.concat(F.array_join(F.collect_list(part), ""), F.lit("--b--")).cast("binary").alias("body")).withColumn("boundary", F.lit("b"))
    parts = formats.multipart_parts(bodies)
    return ranges.unanswered(asked, parts).select("fetch", "range_ord", "first_byte", "last_byte")


@query("select doc_id, sha256(text) as hash, strlen(text)::bigint as length from documents")
def chunk_listing(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    line = F.concat_ws(" ", F.sha2(F.col("text").cast("binary"), 256), F.octet_length("text").cast("string"))
    return d.select("doc_id", formats.listing(line).alias("l")).select("doc_id", "l.*")


@query("""select doc_id, case when doc_id % 5 = 0 then 'negative offset' when doc_id % 5 = 1 then 'negative length' when doc_id % 5 = 2 then 'end beyond 64 bits' when doc_id % 5 = 3 then 'length needed for a file of unknown size' end as error from documents""")
def request_errors(spark, sf_dir):
    kind = F.col("doc_id") % 5
    offset = F.when(kind == 0, -1).when(kind == 2, ranges.LONG_MAX).otherwise(10).cast("long")
    length = F.when(kind == 1, -5).when(kind == 3, None).otherwise(9).cast("long")
    size = F.when(kind == 3, None).otherwise(F.col("n_chars")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", ranges.request_error(offset, length, size).alias("error"))


@query("""select page_id, (400 + page_id % 120) in (408, 429, 500, 502, 503, 504) as retry, least(0.5::double * pow(2, page_id % 12), 20.0::double) * 0.25::double as wait, case when page_id % 5 > 0 then page_id % 5 * 1000 end as expires, (page_id % 5 * 1000)::bigint as stored,
  (page_id % 256 + 256 * (page_id % 7) + 65536 * (page_id % 3))::int as u24, page_id between 10 and 19 as held, page_id % 4 = 0 as bad_range from pages""")
def protocol_scalars(spark, sf_dir):
    """Retries and waits, times that are 0 where there are none, three-byte numbers, range rules."""
    i = F.col("page_id")
    when = text.unix_or_null(i % 5 * 1000)
    raw = F.unhex(F.concat(*[F.lpad(F.hex(x), 2, "0") for x in (i % 256, i % 7, i % 3)]))
    bad = ranges.invalid_chunk_range(F.when(i % 4 == 0, i + 1).otherwise(0), i) | ranges.invalid_byte_range(F.when(i % 4 == 0, -1).otherwise(0), i)
    return read(spark, sf_dir, "pages").select("page_id", text.is_retryable(400 + i % 120).alias("retry"), text.backoff(i % 12 + 1, F.lit(0.5), F.lit(20.0), F.lit(0.25)).alias("wait"), F.unix_timestamp(when).alias("expires"), text.null_to_zero(when).alias("stored"), text.u24(raw, 1).alias("u24"), ranges.holds(F.lit(10), F.lit(20), i).alias("held"), bad.alias("bad_range"))
