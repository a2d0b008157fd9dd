"""Content-defined cuts by the gear rolling hash.

``h = (h << 1) + table[byte]`` over 64 bits depends on the last 64 bytes only, so the hash at every
place comes from six doubling passes over the whole input: after pass k it covers 2**k bytes. A
place is a candidate if the top log2(target) bits are 0; of the candidates the first that is a
minimum away cuts, else the maximum does. For targets under 512 the minimum is less than the window, so
what went before a cut matters; there the rule is followed byte by byte.

The table of 256 numbers is the format's published one; another is a parameter, or is read from a
file by ``load_table``.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .gear_table import PUBLISHED

TARGET, WINDOW = 65_536, 64


def splitmix(seed: int, n: int) -> np.ndarray:
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def load_table(path: str) -> np.ndarray:
    """The 256 hexadecimal 64-bit numbers of a text file, in order."""
    with open(path) as f:
        found = re.findall(r"0x([0-9a-fA-F]{16})", f.read())
    if len(found) != 256:
        raise ValueError(f"{len(found)} numbers, not 256")
    return np.array([int(x, 16) for x in found], np.uint64)


def default_table() -> np.ndarray:
    path = os.environ.get("CHUNKLOOM_GEAR_TABLE")
    return load_table(path) if path else np.array(PUBLISHED, np.uint64)


def limits(target: int) -> tuple[int, int, int]:
    """least, most, bits."""
    if target <= WINDOW or target & (target - 1):
        raise ValueError("the target must be a power of two above 64")
    return target // 8, target * 2, target.bit_length() - 1


def hashes(data: bytes, table: np.ndarray) -> np.ndarray:
    h = table[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16, 32):
        if k < len(h):
            h[k:] += h[:-k] << np.uint64(k)
    return h


def cuts(data: bytes, target: int = TARGET, table: np.ndarray | None = None) -> list[int]:
    """Where each chunk ends; none for an empty input."""
    table = default_table() if table is None else table
    least, most, bits = limits(target)
    if least < WINDOW:
        return _stepwise(data, least, most, bits, table)
    marks = np.concatenate([_marks(data, at, bits, table) for at in range(0, len(data), 1 << 22)] or [np.empty(0, np.int64)])
    out, start, n = [], 0, len(data)
    while start < n:
        i = int(np.searchsorted(marks, start + least))
        end = min(int(marks[i]) if i < len(marks) else n, start + most, n)
        out.append(end)
        start = end
    return out


def _marks(data: bytes, at: int, bits: int, table: np.ndarray, size: int = 1 << 22) -> np.ndarray:
    """Candidate ends of a stretch; the 63 bytes before it complete its first windows."""
    lead = min(at, WINDOW - 1)
    h = hashes(data[at - lead : at + size], table)[lead:]
    return np.flatnonzero(h >> np.uint64(64 - bits) == 0) + at + 1


def _stepwise(data: bytes, least: int, most: int, bits: int, table: np.ndarray) -> list[int]:
    t, out, h, size = [int(x) for x in table], [], 0, 0
    for i, b in enumerate(data):
        h = (h << 1) + t[b] & 0xFFFFFFFFFFFFFFFF
        size += 1
        if size == most or (size >= least and h >> 64 - bits == 0):
            out.append(i + 1)
            h = size = 0
    if size:
        out.append(len(data))
    return out
