import hashlib

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import text
from chunkloom.operators import ranges, reconstruct
from chunkloom.plans import client
from chunkloom.plans import queries as Q
from chunkloom.sources import assemble, formats, shards
from chunkloom.streaming import incremental

from .test_chunks import TABLE
from .test_hashes import stream

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["first_occurrence", "dedup_stats_by_source", "file_terms", "range_plan", "shard_search", "reconstruct_text", "text_formats", "range_normalized", "term_digest", "known_places", "assembled_terms", "assembled_footers", "pack_ranges", "plan_terms", "unanswered_ranges", "protocol_scalars", "file_terms_cdc"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))


def test_upload_and_download(spark):
    data = stream(40_000)
    rows = [("a", bytearray(data)), ("b", bytearray(data[:20_000] + b"new" * 500 + data[20_000:])), ("c", bytearray(b"x"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    up = client.upload(files, target=1024, max_bytes=16_384, table=TABLE)
    assert up.packs.count() > 1
    back = {r["file"]: bytes(r["content"]) for r in client.download(up.terms, up.packs).collect()}
    assert back == {k: bytes(v) for k, v in rows}
    part = {r["file"]: bytes(r["content"]) for r in client.download(up.terms, up.packs, 1000, 5000).collect()}
    assert part == {k: bytes(v)[1000:6000] for k, v in rows if len(v) > 1000}
    assert client.verify(client.download(up.terms, up.packs), up.files).count() == 0
    stats = {r["file"]: r for r in up.stats.collect()}
    assert stats["a"]["dedup_bytes"] == 0 and stats["b"]["dedup_bytes"] > 20_000
    totals = up.totals.first()
    assert totals["packs"] == up.packs.count() and totals["uploaded_bytes"] == up.packs.agg(F.sum("disk_bytes")).first()[0] and totals["dedup_bytes"] == stats["b"]["dedup_bytes"]
    with pytest.raises(ValueError):
        client.upload(files.unionByName(files), table=TABLE)
    broken = up.terms.withColumn("unpacked_length", F.col("unpacked_length") + 1)
    with pytest.raises(client.VerificationError):
        client.download(broken, up.packs)


def test_upload_against_what_is_stored(spark, tmp_path):
    data, store = stream(30_000), str(tmp_path / "store")
    files = lambda *rows: spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "path string, content binary")
    one = client.upload(files(("a", data[:20_000])), target=1024, max_bytes=8192, table=TABLE)
    shard = spark.createDataFrame(client.commit(one, store).collect())
    n = assemble.stored_packs(spark, store).count()
    assert n == one.packs.count() and client.commit(one, store).count() == 1 and assemble.stored_packs(spark, store).count() == n
    held = spark.createDataFrame(shards.read_shards(shard, "chunks").collect())
    index = lambda expires: held.select(F.lit(0).cast("long").alias("shard_ord"), "pack", F.col("idx").cast("long").alias("idx"), F.col("chunk_hash").alias("chunk_key"), F.to_timestamp(F.lit(expires)).alias("expires_at"))
    more = files(("b", data), ("c", data[:20_000]))
    opts = {"target": 1024, "max_bytes": 8192, "table": TABLE, "as_of": "2024-01-01 00:00:00"}
    two = client.upload(more, index=index("2024-01-01 00:00:01"), **opts)
    stats = {r["file"]: r for r in two.stats.collect()}
    assert stats["b"]["dedup_bytes"] > 17_000 and stats["c"]["dedup_bytes"] == 20_000
    known = held.select("pack").distinct()
    with pytest.raises(client.VerificationError):
        client.commit(two, str(tmp_path / "elsewhere"))
    client.commit(two, str(tmp_path / "elsewhere"), known)
    client.commit(two, store)
    back = {r["file"]: bytes(r["content"]) for r in client.download(two.terms, assemble.stored_packs(spark, store, two.terms.withColumnRenamed("pack", "pack_hash"))).collect()}
    assert back == {"b": data, "c": data[:20_000]} and client.verify(client.download(two.terms, assemble.stored_packs(spark, store)), two.files).count() == 0
    # an expired shard counts no more; sampled keys are asked of the service, and bring its whole shard
    old = client.upload(more, index=index("2024-01-01 00:00:00"), **opts)
    assert {r["file"]: r["dedup_bytes"] for r in old.stats.collect()}["b"] < 1000
    asked = client.upload(more, stored=index("2024-01-01 00:00:01"), rate=1, **opts)
    assert {r["file"]: r["dedup_bytes"] for r in asked.stats.collect()}["c"] == 20_000 and asked.totals.first()["queries"] > 15
    foot = shards.read_shards(shard, "footers").first()
    assert (foot["materialized_bytes"], foot["stored_bytes"], foot["disk_bytes"]) == (20_000, 20_000, one.packs.agg(F.sum("disk_bytes")).first()[0])
    terms = shards.read_shards(client.shard_of(one), "terms").collect()
    for up in (one, two, old, asked):
        up.release()
    assert all(t["verification"] for t in terms) and len({t["file_hash"] for t in terms}) == 1 and terms[0]["sha256"] == hashlib.sha256(data[:20_000]).hexdigest()


def test_no_plan_meets_in_one_task(spark):
    """Packing sends one task arrays of lengths alone; terms and files are matched by more than the file."""
    plan = Q.QUERIES["pack_assignment"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert len(single) == 1 and "FlatMapGroupsIn" not in plan
    for name in ("term_verification", "term_digest"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "first_chunk" not in plan and ">=" not in "".join(x for x in plan.split("\n") if "Join" in x)


def test_batches_beyond_a_shard(spark):
    """A batch too large for one shard of 64 MiB goes into several, whole and in order."""
    hex_ = lambda *c: F.sha2(F.concat_ws("-", *c).cast("binary"), 256)
    terms = spark.range(3000).select((F.col("id") % 2).alias("batch"), hex_(F.col("id") % 500).alias("file_hash"), hex_(F.lit("s")).alias("sha256"), F.floor(F.col("id") / 500).alias("term_ord"), hex_(F.lit("p"), F.col("id")).alias("pack"), F.lit(7).cast("long").alias("unpacked_length"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), hex_(F.lit("v"), F.col("id")).alias("verification"))
    chunks = spark.range(1_500_000).select(F.lit(1).cast("long").alias("batch"), hex_(F.lit("p"), F.floor(F.col("id") / 8192)).alias("pack"), (F.col("id") % 8192).alias("idx"), hex_("id").alias("chunk_hash"), (F.col("id") % 8192 * 3).alias("byte_range_start"), F.lit(3).cast("long").alias("length"), F.lit(11).cast("long").alias("disk_bytes"))
    full = assemble.write_shards(terms, chunks, 5, 9).persist()
    assert sorted((r["batch"], r["part"], r["path"]) for r in full.collect()) == [(0, 0, "batch-0"), (1, 0, "batch-1"), (1, 1, "part-1-of-batch-1")]
    got = shards.read_shards(full.where("batch = 1"), "chunks").agg(F.count("*"), F.countDistinct("chunk_hash"), F.sum("length"), F.countDistinct("pack")).first()
    foot = shards.read_shards(full.where("batch = 1"), "footers").agg(F.sum("stored_bytes"), F.sum("disk_bytes"), F.sum("materialized_bytes")).first()
    full.unpersist()
    assert tuple(got) == (1_500_000, 1_500_000, 4_500_000, 184) and tuple(foot) == (4_500_000, 184 * 11, 1500 * 7)
    # many small shards hold what one holds, each within the limit
    some, rows = chunks.where("idx < 200"), lambda f, p: sorted(map(tuple, shards.read_shards(f.withColumn("path", F.lit("")), p).collect()))
    one, many = (assemble.write_shards(terms, some, max_bytes=n).persist() for n in (64 << 20, 500_000))
    assert one.count() == 2 and all(len(r["content"]) <= 500_000 for r in many.collect()) and many.count() > 4
    assert all(rows(one, p) == rows(many, p) for p in ("terms", "chunks"))
    with pytest.raises(Exception, match="shard size"):
        assemble.write_shards(terms, chunks.withColumn("pack", F.lit("ab" * 32))).collect()


def test_shards_in_pieces(spark):
    """Shards that are read on pass as rows of few bytes, and are what they are as one row each."""
    hex_ = lambda *c: F.sha2(F.concat_ws("-", *c).cast("binary"), 256)
    long = lambda n: F.lit(n).cast("long")
    terms = spark.range(90).select((F.col("id") % 2).alias("batch"), hex_("id").alias("file_hash"), hex_(F.lit("s")).alias("sha256"), F.lit(0).alias("term_ord"), hex_(F.lit("p")).alias("pack"), long(7).alias("unpacked_length"), long(0).alias("start"), long(1).alias("end"), hex_(F.lit("v")).alias("verification"))
    chunks = spark.range(60).select((F.col("id") % 2).alias("batch"), hex_(F.lit("p"), F.col("id") % 2).alias("pack"), F.col("id").alias("idx"), hex_("id").alias("chunk_hash"), (F.col("id") * 3).alias("byte_range_start"), long(3).alias("length"), long(11).alias("disk_bytes"))
    one, cut = (assemble.write_shards(terms, chunks, 5, 9, max_bytes=5000, piece=n) for n in (None, 1000))
    rows = sorted((r["batch"], r["part"], r["piece"], bytes(r["content"])) for r in cut.collect())
    assert max(len(r[3]) for r in rows) == 1000 and len({r[:2] for r in rows}) > 4
    assert {(r["batch"], r["part"]): bytes(r["content"]) for r in one.collect()} == {k: b"".join(r[3] for r in rows if r[:2] == k) for k in {r[:2] for r in rows}}
    # several shards under one path, as the queries read them
    read = lambda f, part: sorted(map(tuple, shards.read_shards(f.withColumn("path", F.lit("")), part).collect()), key=str)
    assert all(len(got := read(cut, p)) >= n and got == read(one, p) for p, n in (("terms", 90), ("chunks", 60), ("footers", 4)))
    with pytest.raises(Exception, match="not in a row"):
        read(cut.where("piece <> 1"), "terms")
    assert max(r["n"] for r in Q._assembled(spark, SF).select(F.length("content").alias("n"), "piece").collect()) <= shards.PIECE


def test_shard_source(spark, tmp_path):
    from .test_chunks import some_shard

    (tmp_path / "s").write_bytes(shards.write_shard(some_shard()))
    spark.dataSource.register(shards.ShardSource)
    read = lambda part: spark.read.format("shard").option("part", part).load(str(tmp_path / "s")).collect()
    assert [len(read(p)) for p in ("terms", "chunks", "footers")] == [3, 3, 1]
    by = spark.read.format("binaryFile").load(str(tmp_path / "s")).select("path", "content")
    assert [r[1:] for r in map(tuple, shards.read_shards(by, "chunks").collect())] == [r[1:] for r in map(tuple, read("chunks"))]


def test_ranges(spark):
    r = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 20, 29), (2, 0, 0, 4)], "fetch long, range_ord long, first_byte long, last_byte long")
    p = spark.createDataFrame([(1, 20, 29, b"x" * 10), (1, 0, 9, b"y" * 10), (3, 0, 0, b"z")], "fetch long, first_byte long, last_byte long, data binary")
    got = {(x["fetch"], x["range_ord"]): x["data"] and bytes(x["data"][:1]) for x in ranges.match_parts(r, p).collect()}
    assert got == {(1, 0): b"y", (1, 1): b"x", (2, 0): None}
    assert [tuple(x) for x in ranges.unanswered(r, p).select("fetch", "range_ord").collect()] == [(2, 0)]
    assert sorted(map(tuple, ranges.miscounted(r, p).collect())) == [(2, 1, 0), (3, 0, 1)]
    terms = spark.createDataFrame([("f", 0, "p", 0, 3)], "file string, term_ord int, pack string, start long, end long")
    fetches = spark.createDataFrame([("p", 0, 0, 0, 2)], "pack string, fetch_ord int, range_ord int, start long, end long")
    assert reconstruct.plan_ranges(terms, fetches, partial=True).count() == 2
    with pytest.raises(Exception, match="no fetched range"):
        reconstruct.plan_ranges(terms, fetches).collect()


def test_first_seen_is_bounded(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    for i, rows in enumerate([[("k", 0), ("k", 1), ("l", 1)], [("k", 2), ("m", 59)], [("k", 59)]]):
        spark.createDataFrame([(k, at(m)) for k, m in rows], "chunk_key string, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    c = spark.readStream.schema("chunk_key string, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withColumn("t", F.to_timestamp("t"))
    q = incremental.first_seen_stream(c, "t", "10 minutes").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r["chunk_key"] for r in spark.sql("select * from seen").collect())
    # the second k lies within ten minutes of the first; the last one came long after
    assert got in (["k", "k", "l", "m"], ["k", "l", "m"]) and set(got) == {"k", "l", "m"}


def test_files_as_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x").write_bytes(stream(9000))
    q = incremental.chunk_stream(incremental.block_stream(spark, str(tmp_path / "in")), 1024, TABLE).writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(length) as n from blocks").first()["n"] == 9000


def test_plans_of_both_versions(spark):
    new = '{"offset_into_first_range": 3, "terms": [{"hash": "p", "unpacked_length": 9, "range": {"start": 0, "end": 2}}], "xorbs": {"p": [{"url": "http://h/x", "ranges": [{"chunks": {"start": 0, "end": 2}, "bytes": {"start": 0, "end": 99}}]}]}}'
    old = '{"offset_into_first_range": 3, "terms": [{"hash": "p", "unpacked_length": 9, "range": {"start": 0, "end": 2}}], "fetch_info": {"p": [{"range": {"start": 0, "end": 2}, "url": "http://h/x", "url_range": {"start": 0, "end": 99}}]}}'
    p = spark.createDataFrame([("n", new), ("o", old)], "file string, json string").select("file", formats.plan(F.col("json")).alias("plan"))
    a, b = (sorted(tuple(r)[1:] for r in f.where(F.col("file") == k).collect()) for f in (formats.plan_fetches(p),) for k in ("n", "o"))
    assert a == b == [("p", 0, 0, "http://h/x", 0, 2, 0, 99)]
    t = formats.plan_terms(p)
    assert reconstruct.invalid_terms(t, F.col("offset")).count() == 0
    assert reconstruct.invalid_terms(t, F.lit(9)).count() == 2


def test_text(spark):
    r = spark.createDataFrame([("https://h/p?X-Signed-Range=bytes%3D0-9&y=1", "bytes 1-2/*", "a b/ü~")], "u string, c string, p string").select(text.signed_range(F.col("u")).alias("s"), text.content_range(F.col("c")).alias("c"), text.escaped_path(F.col("p")).alias("p")).first()
    assert (r["s"], tuple(r["c"]), r["p"]) == ("bytes=0-9", (1, 2, None), "a%20b/%C3%BC~")


def test_streams(spark, tmp_path):
    data = stream(30_000)
    for i, at in enumerate(range(0, 30_000, 7_000)):
        spark.createDataFrame([("f", i, bytearray(data[at : at + 7_000]), at + 7_000 >= 30_000)], "file string, seq long, data binary, final boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    blocks = spark.readStream.schema("file string, seq long, data binary, final boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.chunk_stream(blocks, 1024, TABLE).writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    from chunkloom.functions import gear

    got = [r["offset"] + r["length"] for r in spark.sql("select * from chunked order by chunk_ord").collect()]
    assert got == gear.cuts(data, 1024, TABLE)


def test_index_grows_once(spark, tmp_path):
    c = spark.createDataFrame([("a", 0, 1, "k"), ("b", 0, 1, "k"), ("b", 1, 2, "l")], "file string, chunk_ord int, length int, chunk_key string")
    path = str(tmp_path / "index")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        incremental.merge_new(c, str(tmp_path / "broken"))
    assert [incremental.merge_new(c, path), incremental.merge_new(c, path)] == [2, 0]
