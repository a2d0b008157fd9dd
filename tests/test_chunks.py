import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.functions import gear
from chunkloom.operators import packing
from chunkloom.sources import formats, packs, shards
from chunkloom.streaming.incremental import Chunker

from .test_hashes import BOUNDARIES, ONE, stream

TABLE = gear.splitmix(7, 256)


def stepwise(data, target):
    least, most, bits = gear.limits(target)
    return gear._stepwise(data, least, most, bits, TABLE)


@pytest.mark.parametrize("target", [512, 1024, 4096])
def test_kernel_is_the_rule(target):
    data = stream(60_000) + bytes(20_000)
    assert gear.cuts(data, target, TABLE) == stepwise(data, target)


def test_small_targets_and_ends():
    assert gear.cuts(b"", 1024, TABLE) == []
    assert gear.cuts(stream(5000), 128, TABLE) == stepwise(stream(5000), 128)
    with pytest.raises(ValueError):
        gear.limits(1000)


# A pattern whose end sets off cuts, and the published cuts of 64 KiB of it with so many zero
# bytes after it, doubled again and again.
PATTERN = [
    154, 52, 42, 34, 159, 75, 126, 224, 70, 236, 12, 196, 79, 236, 178, 124, 127, 50, 99, 178, 44, 176, 174, 126, 250, 235, 205, 174, 252, 122, 35, 10,
    20, 101, 214, 69, 193, 8, 115, 105, 158, 228, 120, 111, 136, 162, 198, 251, 211, 183, 253, 252, 164, 147, 63, 16, 186, 162, 117, 23, 170, 36, 205, 187,
    174, 76, 210, 174, 211, 175, 12, 173, 145, 59, 2, 70, 222, 181, 159, 227, 182, 156, 189, 51, 226, 106, 24, 50, 183, 157, 140, 10, 8, 23, 212, 70,
    10, 234, 23, 33, 219, 254, 39, 236, 70, 49, 191, 116, 9, 115, 15, 101, 26, 159, 165, 220, 15, 170, 56, 125, 92, 163, 94, 235, 38, 40, 49, 81,
]
PATTERN_CUTS = {
    0: [8256, 16448, 24640, 32832, 41024, 49216, 57408, 65536],
    1: [8320, 16576, 24832, 33088, 41344, 49600, 57856, 65536],
    2: [8254, 16574, 24894, 33214, 41534, 49854, 58174, 65536],
    3: [8317, 16570, 24823, 33076, 41329, 49582, 57835, 65536],
    4: [8248, 16564, 24880, 33196, 41512, 49828, 58144, 65536],
    5: [8310, 16556, 24802, 33048, 41294, 49540, 57786, 65536],
    10: [8206, 16486, 24766, 33046, 41326, 49606, 57886, 65536],
    11: [8265, 16466, 24667, 32868, 41069, 49270, 57471, 65536],
    13: [8242, 16561, 24880, 33199, 41518, 49837, 58156, 65536],
}


@pytest.mark.parametrize("padding", PATTERN_CUTS)
def test_published_cuts_of_the_pattern(padding):
    data = bytes(PATTERN) + bytes(padding)
    while len(data) < 65_536:
        data += data[: 65_536 - len(data)]
    assert gear.cuts(data) == PATTERN_CUTS[padding]


def test_constant_bytes_are_cut_at_the_maximum():
    assert gear.cuts(bytes([59]) * 1_000_000) == [131072 * i for i in range(1, 8)] + [1_000_000]


def test_published_table_is_the_default(monkeypatch):
    monkeypatch.delenv("CHUNKLOOM_GEAR_TABLE", raising=False)
    assert gear.cuts(stream(1_000_000)) == BOUNDARIES


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=12), st.sampled_from([128, 512, 1024]))
def test_blocks_do_not_matter(sizes, target):
    data = stream(sum(sizes))
    c, got, at = Chunker(target, TABLE), [], 0
    for i, n in enumerate(sizes):
        got += c.feed(data[at : at + n], i + 1 == len(sizes))
        at += n
    ends = gear.cuts(data, target, TABLE)
    assert got == [data[i:j] for i, j in zip([0, *ends], ends)]


@given(st.lists(st.integers(1, 50), max_size=60))
def test_next_fit(lengths):
    import numpy as np

    got, pack, held, n = [], 0, 0, 0
    for x in lengths:
        if n and (held + x > 100 or n == 5):
            pack, held, n = pack + 1, 0, 0
        held, n = held + x, n + 1
        got.append(pack)
    assert packing.next_fit(np.array(lengths, np.int64), 100, 5).tolist() == got


@given(st.lists(st.lists(st.integers(1, 120), min_size=1, max_size=20), max_size=8))
def test_next_fit_goes_on(parts):
    """Fed in parts, packs are those of the whole."""
    import numpy as np

    fit, got = packing.NextFit(100, 5), []
    for p in parts:
        first, held, cuts = fit.pack, fit.count, fit.feed(np.array(p, np.int64))
        for i in range(len(p)):
            passed = [c for c in cuts if c <= i]
            got.append((first + len(passed), i - passed[-1] if passed else held + i))
    whole = packing.next_fit(np.array(sum(parts, []), np.int64), 100, 5).tolist()
    assert got == [(k, whole[:i].count(k)) for i, k in enumerate(whole)]


@given(st.binary(max_size=600))
def test_codecs(data):
    assert packs.ungroup4(packs.group4(data)) == data
    for s in (0, 1, 2):
        assert packs.decompress(packs.compress(data, s), s, len(data)) == data
    assert packs.read_pack(packs.write_pack([data, data[:3], b"x" * 500])) == [data, data[:3], b"x" * 500]


def test_broken_packs():
    good = packs.write_pack([b"abc" * 50])
    for bad in (b"\1" + good[1:], good[:4] + b"\7" + good[5:], good[:-1]):
        with pytest.raises(packs.FormatError):
            packs.read_pack(bad)
    assert packs.read_pack(good + b"short") == [b"abc" * 50]
    with pytest.raises(packs.FormatError):
        packs.checked_range(good, 0, 2)


def some_shard(footer=True, checks=True):
    t = shards.Term(ONE, 300, 0, 2, ONE if checks else None)
    p = shards.Pack(ONE, ((ONE, 0, 100), (ONE, 100, 200), ("ab" * 32, 300, 5)), 305, 200)
    return shards.Shard((shards.File(ONE, (t, t), "cd" * 32), shards.File("ab" * 32, (t,))), (p,), shards.Footer(created=5, stored=9) if footer else None)


@pytest.mark.parametrize("footer", [True, False])
@pytest.mark.parametrize("checks", [True, False])
def test_shards(footer, checks):
    s = some_shard(footer, checks)
    data = shards.write_shard(s)
    assert len(data) == s.size() and shards.read_shard(data) == s
    assert s.find(ONE) == (ONE, 0) and s.find("11" * 32) is None
    assert shards.keyed(s, "22" * 32).find("ab" * 32) == (ONE, 2)


def test_broken_shards():
    data = shards.write_shard(some_shard())
    for bad in (b"x" + data[1:], data[:32] + b"\7" + data[33:], data[:-8], data[:84] + b"\xff\xff\xff\x7f" + data[88:], data + b"x"):
        with pytest.raises(ValueError):
            shards.read_shard(bad)
    mixed = shards.Shard((some_shard().files[0], some_shard(checks=False).files[1]))
    with pytest.raises(packs.FormatError):
        shards.write_shard(mixed)


def test_multipart():
    body = b"--b\r\nContent-Range: bytes 0-2/9\r\n\r\na--b\r\n--b\r\ncontent-range: bytes 5-6/9\r\n\r\nxy\r\n--b--".replace(b"0-2", b"0-3")
    assert formats.multipart(body, "b") == [(0, 3, b"a--b"), (5, 6, b"xy")]
    with pytest.raises(ValueError):
        formats.multipart(body.replace(b"5-6", b"5-7"), "b")
