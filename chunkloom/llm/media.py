"""GIF files as media columns.

The decoder reads GIF87a and GIF89a: LZW code streams, global and local palettes, interlace, and
over the frames transparency, disposal and delays; frames come with their time and a colour
histogram. The writer stores bytes losslessly as pixels under a grey palette, 64 a row, as many
frames as needed, LZW-coded with a clear code where the table is full.

The decoder takes a stream between two clear codes at a time. Widths there depend on a code's place
only, so all codes are cut out at once. A code of the table stands for what an earlier place of the
output holds, one sample longer than the code there: lengths, and then samples, are found by following
all these references at once, each step twice as far.

Defined results: a null text counts as empty (one row of padding); equal texts give equal files;
very long texts take several frames; repeated rows stay; other columns are ignored, whatever their names;
an empty table gives no rows. A broken file raises ValueError; a null file has no frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kind_of as _kind
from .common import small as _small
from .common import staged

WIDTH, ROWS, DELAY = 64, 16_384, 4
#: Entries of a full table, and bits of its codes.
FULL, MOST_BITS = 4096, 12
GREY = bytes(v for i in range(256) for v in (i, i, i))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (WIDTH if not data else 0))


@lru_cache(16)
def _widths(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the codes after a clear code, as many as fill the table and one more: bits of each, and bits before
    it. The table has grown by one entry with each code but the first; full, its codes keep their width."""
    entries = (1 << min_size) + 2 + np.maximum(np.arange(FULL - (1 << min_size)) - 1, 0)
    bits = np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, MOST_BITS)
    return bits, np.cumsum(bits) - bits


def encode_lzw(samples: bytes, min_size: int = 8) -> bytes:
    """A code stream of samples (none above 1 << min_size): a clear code first and where the table is full."""
    clear = 1 << min_size
    out: list[np.ndarray] = []
    codes, table, new, last = [], {}, clear + 2, -1
    for s in samples:
        if last < 0:
            last = s
            continue
        found = table.get(last << 8 | s)
        if found is not None:
            last = found
            continue
        codes.append(last)
        table[last << 8 | s] = new
        new, last = new + 1, s
        if new == FULL:
            out.append(np.array([*codes, clear], np.uint64))
            codes, table, new = [], {}, clear + 2
    out.append(np.array([*codes, *([last] if last >= 0 else []), clear + 1], np.uint64))
    all_codes = np.concatenate([np.array([clear], np.uint64), *out])
    bits = np.concatenate([[min_size + 1], *[_widths(min_size)[0][: len(x)] for x in out]])
    at = np.cumsum(bits) - bits
    # a code lies within three bytes; those of its bits that share a byte with others never overlap
    stream = np.zeros(int(at[-1] + bits[-1] + 7) // 8 + 2, np.int64)
    value = all_codes.astype(np.int64) << (at & 7)
    for k in range(3):
        stream += np.bincount((at >> 3) + k, weights=value >> 8 * k & 255, minlength=len(stream))[: len(stream)].astype(np.int64)
    return stream[:-2].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(payload: bytes, delay: int = DELAY) -> bytes:
    """payload, a positive multiple of WIDTH, as an animated GIF."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), GREY]
    for at in range(0, rows, ROWS):
        part = np.frombuffer(payload[at * WIDTH : (at + ROWS) * WIDTH], np.uint8)
        # disposal 2: a short last frame starts from an empty screen
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(encode_lzw(part.tobytes()))]
    return b"".join([*out, b"\x3b"])


def _cut(data: np.ndarray, at: int, bits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Codes from bit at on; data has three bytes more than the stream."""
    o = at + before
    byte = o >> 3
    word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
    return word >> (o & 7) & ((1 << bits) - 1)


def _segments(data: bytes, min_size: int) -> Iterator[np.ndarray]:
    """The codes between clear codes, up to the end code or the stream's last whole code."""
    clear, (bits, before) = 1 << min_size, _widths(min_size)
    held, at, total = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64), 0, 8 * len(data)
    while at < total:
        parts, first = [], True
        while True:
            # the schedule from the clear code on; past it all codes are of the greatest width
            own, prior = (bits, before) if first else (np.full(FULL, MOST_BITS), np.arange(FULL) * MOST_BITS)
            n = int(np.searchsorted(prior + own, total - at, "right"))
            codes = _cut(held, at, own[:n], prior[:n])
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop):
                k = int(stop[0])
                parts.append(codes[:k])
                at += int(prior[k] + own[k])
                yield np.concatenate(parts)
                if codes[k] == clear + 1:
                    return
                break
            parts.append(codes)
            if n < len(own):
                yield np.concatenate(parts)
                return
            at, first = at + int(prior[-1] + own[-1]), False


def _followed(to: np.ndarray) -> np.ndarray:
    """Where each reference ends: to points at earlier places, or at the place itself where it ends."""
    while True:
        far = to[to]
        if np.array_equal(far, to):
            return to
        to = far


def _samples(codes: np.ndarray, clear: int) -> tuple[np.ndarray, bool]:
    """What codes stand for, and whether all of them were in the table."""
    place = np.arange(len(codes))
    entry = codes - (clear + 2)
    bad = np.flatnonzero(entry >= place)
    if len(bad):
        codes, entry, place = codes[: bad[0]], entry[: bad[0]], place[: bad[0]]
    refers = entry >= 0
    # entry k is the string of code k and one sample more: the first of code k + 1
    to, size = np.where(refers, entry, place), refers.astype(np.int64)
    while size[to].any():
        size, to = size + size[to], to[to]
    size += 1
    start = np.cumsum(size) - size
    back = np.where(refers, start - start[np.where(refers, entry, 0)], 0)
    first = _followed((np.arange(int(size.sum())) - np.repeat(back, size)).astype(np.int32))
    plain = np.zeros(len(first), np.uint8)
    plain[start[~refers]] = codes[~refers] & 255
    return plain[first], not len(bad)


def decode_lzw(data: bytes, min_size: int, n: int) -> np.ndarray:
    """n samples of a code stream; a stream that ends early leaves the rest 0."""
    if not 2 <= min_size <= 11:
        raise ValueError("code size")
    out, have = np.zeros(n, np.uint8), 0
    for codes in _segments(data, min_size):
        got, whole = _samples(codes, 1 << min_size)
        out[have : have + len(got)] = got[: n - have]
        have += len(got)
        if have >= n:
            break
        if not whole:
            raise ValueError("code beyond the table")
    return out


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    #: The file's own samples of this frame, before palette and screen.
    samples: np.ndarray
    #: The screen with this frame on it, height x width x RGBA.
    screen: np.ndarray


def read_gif(data: bytes) -> list[Frame]:
    return list(each_frame(data))


def each_frame(data: bytes) -> Iterator[Frame]:
    """One at a time, so that a long file's screens are not all held."""

    def need(at: int, n: int) -> bytes:
        if at + n > len(data):
            raise ValueError("the file ends early")
        return data[at : at + n]

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := need(at, 1)[0]:
            parts.append(need(at + 1, n))
            at += n + 1
        return b"".join(parts), at + 1

    if need(0, 6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, back, _ = struct.unpack("<HHBBB", need(6, 7))
    at, shared = 13, None

    def colours(n: int) -> np.ndarray:
        """RGBA of 256 colours; those beyond the palette are its last one."""
        rgb = np.frombuffer(need(at, 3 * n), np.uint8).reshape(-1, 3)
        out = np.full((256, 4), 255, np.uint8)
        out[:n, :3], out[n:, :3] = rgb[:256], rgb[-1]
        return out.view("<u4").ravel()

    if flags & 0x80:
        shared = colours(n := 1 << (flags & 7) + 1)
        at += 3 * n
    canvas = np.zeros((height, width), "<u4")
    now, delay, disposal, clear_to = 0, 0, 0, None
    while True:
        kind = need(at, 1)[0]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = need(at, 1)[0]
            body, at = sub_blocks(at + 1)
            if label == 0xF9:
                f, delay, c = struct.unpack("<BHB", body[:4])
                disposal, clear_to = f >> 2 & 7, c if f & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, f = struct.unpack("<HHHHB", need(at, 9))
        at += 9
        palette = shared
        if f & 0x80:
            palette = colours(n := 1 << (f & 7) + 1)
            at += 3 * n
        if palette is None:
            raise ValueError("no palette")
        size = need(at, 1)[0]
        body, at = sub_blocks(at + 1)
        samples = decode_lzw(body, size, w * h).reshape(h, w)
        if f & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        view = canvas[y : y + h, x : x + w]
        seen = samples[: view.shape[0], : view.shape[1]]
        np.copyto(view, palette[seen], where=True if clear_to is None else seen != clear_to)
        yield Frame(now, delay * 10, samples, canvas.copy().view(np.uint8).reshape(height, width, 4))
        if disposal == 2:
            view[...] = 0
        elif disposal == 3:
            canvas = before
        now, delay, disposal, clear_to = now + delay * 10, 0, 0, None


def histogram(frame: Frame, bins: int = 8) -> list[int]:
    """The screen's pixels by the mean of their colour, in bins of equal width, without transparent ones."""
    p = frame.screen.reshape(-1, 4)
    p = p if p[:, 3].all() else p[p[:, 3] > 0]
    grey = (p[:, 0].astype(np.uint16) + p[:, 1] + p[:, 2]) // 3
    return np.bincount(grey, minlength=256)[:256].reshape(bins, -1).sum(1).tolist()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8, padded, as a GIF file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 256):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([write_gif(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, n_bytes long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """doc_id, frame, start_ms, delay_ms, width, height, rgba, histogram: one row per frame."""
    names = ["doc_id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for b in _small(batches, 1):
            if b.column(1)[0].as_py() is None:
                continue
            i = b.column(0)[0].as_py()
            for k, f in enumerate(each_frame(b.column(1)[0].as_py())):
                row = i, k, f.start_ms, f.delay_ms, f.screen.shape[1], f.screen.shape[0], f.screen.tobytes(), histogram(f)
                yield pa.RecordBatch.from_arrays([pa.array([c], t or b.schema.field(0).type) for c, t in zip(row, kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {_kind(media)}, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<long>")


def digest(m: bytes) -> tuple:
    """A file's payload, bytes and feature: of each frame the time and the histogram of its screen."""
    sha, tail, n, feature = hashlib.sha256(), b"", 0, []
    for f in each_frame(m):
        back = f.samples.tobytes()
        sha.update(back)
        tail, n = (tail + back)[-WIDTH:], n + len(back)
        feature.append(f"{f.start_ms}+{f.delay_ms}:{','.join(map(str, histogram(f)))}")
    return n, sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), ";".join(feature)


def media_digests(docs: DataFrame) -> DataFrame:
    """The files are written to the shared folder and read back from there; nothing is shuffled."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in _small(batches, 256):
            rows = [digest(m.as_py()) for m in b.column(2)]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    kind = _kind(docs)
    files = staged(store(docs), "media", "uncompressed")
    return files.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
