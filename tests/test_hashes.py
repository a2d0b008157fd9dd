"""Published values of the format, and the vectorised hash against them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.functions import gear, hashes

# Chunk hashes of nothing and of 1000 SplitMix64 bytes, and the root and salted file
# hashes of small trees.
EMPTY = "e0f2cf784e7e5f10c34f84af150e9a5ff9664216debad915364d741049870f67"
SMALL = "83cb1074082640e86bf18ec2a232fce94677d0a25799bbeb15dfe416590e9b7c"
ONE = "cfc5d07f6f03c29bbf424132963fe08d19a37d5757aaf520bf08119f05cd56d6"
FILES = [
    (hashes.ZERO, 0, hashes.ZERO, "638a6bc391964a85939d48f008e8bdbae6a7975e7ca2d87a3ce2492f4e4d8a4c"),
    (ONE, 100, hashes.ZERO, "8e16257caa3fe079d484d872a8975264b2ff683b0d6db9028cc7c0f968a45661"),
    (ONE, 100, "285371a6a3c8c4e561469c97766c46f0b9799bd8ea51a4ad27a082df8c28b7da", "6c18994ed5e6a223aeff68a6e386dbba7b3c25de076245dc77892b4ad49ac978"),
]
# The chunks of 1,000,000 SplitMix64 bytes under the published table.
BOUNDARIES = [84493, 134421, 144853, 243318, 271793, 336457, 467529, 494581, 582000, 596735, 616815, 653164, 678202, 724510, 815591, 827760, 958832, 991092, 1000000]
FIRST_CHUNK = "6eca1e7dadaf08cca5d82d318c800f07c2ddcec115a7e8627e5edd9605b94b8d"
LAST_CHUNK = "03e5b5f5a088269ec4b329f1e04debfac4cb54b9c0facf038f7e8e0f054be7e2"
ALL_CHUNKS = "6daf15a7ed258b91f607e8f5e6723a8564292d12c8104c156f7bad9c255a0180"

# Roots and salted file hashes of trees of several leaves. Leaves by letter, with their lengths.
LEAVES = {
    "O": hashes.ZERO,
    "A": ONE,
    "B": "c3e67584b5c4fc2a89837ec39e40f2c8a6bb0b2987ac94cd4b31e5fbdd210a72",
    "C": "0d2beb91b9196929a5ddec9f6e306924ddf4a24268e3e59fd8464738d525af37",
    "D": "adf8773496a9b7319b2e50dc98093f344053b17d8ad37100b9c07d9805988784",
    "E": "4ac202caf347fc1e9c874b1ef6a1c5e619141eb775a6f43f0f0124ccd0060d9e",
}
TREES = [
    ("A100 B200 C300", "71ec1275fca074724e2dd666921b3277c7cee603e4d025bcab2d4050015be2bc", "b286606709ef32a1cfede1e603a39f83fef56772d8234c0e35d8920071d80b69", "337f1f046e4cfc1057f0f3edbd87cf977fdfaf3c2b0c0031ca2d1d2a34aa2270"),
    ("A100 A100 A100 A100", "89f2ada89ff8c96763c6b25010e6dd76a4c05b1466207633ea559acf2093211b", "705cc0697edd49c5258951922f5df72e16deaa58f85e78c381a574c4e3c9ad94", "a3da5ccdbea87eafe6400ad30e45df94bcad053d72c246ff94a7934a5a35abdd"),
    ("A100 B200 A100 B200", "90f8313ef12df385d237a067aded02562c35ded12116e32eba401dbc86c38031", "d08d1b24938b34a558972c6fe99f6153ef502f064b74d8ca890cdfb8eb4f953c", "6812247dc5740215154ace7e4ffe271914da445524492677d36bdb6ec1282142"),
    ("A100 B200 A100 B200 C300 D400", "52c826f99507aa05d0b45e9837fa1709e0485425cfbcb1e80db3905cf98b3ee9", "fceabc1f6c6aaaa176bc53b2d6899a3ab99eaebd13b5f0cf36080e6f894bbbf5", "b70b051189a20b58d0c832111e0470396094518b6af8bd8c813c9ccb764ab602"),
    ("O0 A100 O0 A100", "e1755c85be07fd6b7a8d7becc85e6d8c5f507f2a3d38b316bcb6f97855e72188", "031f44db2e13e20c068a83d67c607b5134ddd0e627c2a4f9a6335feb0340625f", "5d343ba4d940ae1a7039774456702e1e45400d47f2a04ae987046984a440b2b5"),
    ("O0 A100 O0 A100 O0", "f36c6a6374a567efd36ed087aeb680b57e3af4e0b5b8e7be2593df4cb647a2de", "80d0b5a2922c67f61ffdc2b9f6e9272a92542a3ab319ed0e6bfc40224b0e033f", "82505151e4e8ad313359150eaa7c13cff3130458e52cdc33c49a6199e47896d5"),
    ("A100 O0", "e8660f81494ca836a58e395c1395ef97870ed71e2b113eec1fab6b3361f46dd6", "b0fd0f1d42902c9e8156968aff956ace74cc286d5f4ad84b98865069175e3d1e", "1472e0ec0085c508d31759d0d2df6656e00080d83340130e28772d231bf5a8d7"),
    ("C300 D400 E500 C300", "73b9dc802ab03a0855c66823a18d95c2a785af594535756abf405038b6270cb8", "d255e7a939311ec686dc825070a5e603147539a80035999a4dcaa698afd4aa7f", "7c58c7b4130ac526c98fff562bb4317581846a04e6ba4f08fa8a829e1c033c78"),
    ("C300 D400 E500 E500 E500", "2c1fd1eca47e284512fcb40fcf45a1874939f9b91c774d46aeba5d004d9d263d", "498ba54b410ea8f05c4b92aa5a6f01165615f6a8d1ec1d7cee76a85fd800ba28", "c98a2a18e6df96f4d6dc5da396e17a2c22867b49b977ab6860de5b3241776baf"),
]


def stream(n):
    return gear.splitmix(0, -(-n // 8)).astype("<u8").tobytes()[:n]


def test_generator():
    data = stream(1_000_000)
    assert (data[0], data[127], data[111111]) == (175, 132, 118)


def test_chunk_hashes():
    assert hashes.chunk_hashes([b"", stream(1000)]) == [EMPTY, SMALL]


def test_chunks_of_a_megabyte():
    data = stream(1_000_000)
    parts = [data[i:j] for i, j in zip([0, *BOUNDARIES], BOUNDARIES)]
    got = hashes.chunk_hashes(parts)
    assert (got[0], got[-1], hashes.verification_hash(got)) == (FIRST_CHUNK, LAST_CHUNK, ALL_CHUNKS)


@pytest.mark.parametrize("leaf, n, salt, want", FILES)
def test_file_hashes(leaf, n, salt, want):
    assert hashes.file_hash([(leaf, n)], salt) == want
    assert hashes.merkle_root([(leaf, n)]) == leaf


@pytest.mark.parametrize("leaves, root, salt, want", TREES)
def test_trees(leaves, root, salt, want):
    nodes = [(LEAVES[x[0]], int(x[1:])) for x in leaves.split()]
    assert hashes.merkle_root(nodes) == root and hashes.file_hash(nodes, salt) == want


def test_tree_columns(spark):
    rows = [(k, [(LEAVES[x[0]], int(x[1:])) for x in leaves.split()]) for k, (leaves, *_) in enumerate(TREES)]
    d = spark.createDataFrame([*rows, (99, None), (100, [])], "k int, nodes array<struct<hash:string,length:long>>")
    got = {r["k"]: r["root"] for r in d.select("k", hashes.pack_root("nodes").alias("root")).collect()}
    assert got == {k: t[1] for k, t in enumerate(TREES)} | {99: None, 100: hashes.ZERO}


def test_no_chunks():
    assert hashes.file_hash([], ONE) == hashes.merkle_root([]) == hashes.ZERO


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**256 - 1), max_size=40))
def test_groups(numbers):
    nodes = [(f"{n:064x}", 1) for n in numbers]
    ends = hashes.group_ends(nodes)
    sizes = [j - i for i, j in zip([0, *ends], ends)]
    assert sum(sizes) == len(nodes) and all(1 <= s <= 9 for s in sizes)
    for end, size in zip(ends[:-1], sizes):
        assert size == 9 or (size >= 3 and hashes.remainder(nodes[end - 1][0], 4) == 0)


def test_text_form(spark):
    from pyspark.sql import functions as F

    raw = bytes(range(32))
    text = hashes.to_text(raw)
    assert hashes.to_raw(text.upper()) == raw
    r = spark.createDataFrame([(bytearray(raw), text), (None, "zz")], "raw binary, text string").select(hashes.text_of(F.col("raw")).alias("t"), hashes.raw_of(F.col("text")).alias("r"), F.when(F.col("raw").isNotNull(), hashes.remainder_of(F.col("text"), 1000)).alias("m")).collect()
    assert (r[0]["t"], bytes(r[0]["r"]), r[0]["m"]) == (text, raw, hashes.remainder(text, 1000))
    assert r[1]["r"] is None
