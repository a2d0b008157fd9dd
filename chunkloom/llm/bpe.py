"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

The tokenizer is built from a rank file: bytes become characters by the byte-to-character mapping,
and the merges are recovered from the ranks (a token's last merge joins the two parts that lower ranks
leave of it). Texts are cut at places that no token spans and each distinct piece is encoded once
a cache's lifetime, since the pieces of a text repeat far more than texts do.

Defined results: a null text counts as empty and has no ids; very long texts are whole; repeated
rows stay; other columns are ignored; an empty table gives no rows. Lone surrogates can't occur in
Spark strings. Ids outside the vocabulary raise an error when decoded.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

from .common import kind_of as _kind
from .common import small as _small
from .common import numbered, tidy

#: Pieces in a generation of a worker's cache (some 200 bytes each).
CACHE = 250_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others for the
    characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def recovered_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """By rank, the pair whose merge makes each token of more than one byte. Tokens that no merges
    of lower rank lead to have none."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            near = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, i = min(near)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Pieces:
    """Encodes pieces by a tokenizer, each distinct one once while the cache lasts. The cache has two
    generations: where the young one is full it becomes the old one, and pieces still in use come
    back from there, so frequent ones stay however many rare ones pass.

    word_end: the suffix of tokens that end a word, for tokenizers that drop white space. Pieces of
    letters are then encoded many at a time as one text and told apart by these tokens; where their
    number isn't that of the pieces, each of them is encoded alone."""

    def __init__(self, tokenizer: Tokenizer, dtype: str, word_end: str | None = None):
        # a task has one core; threads over pieces of a few bytes take twice the CPU time
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.dtype, self.kept, self.old, self.ends = tokenizer, dtype, {}, {}, None
        if word_end:
            vocab = tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values(), default=-1) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(word_end)]] = True
        self.bare = _bare(tokenizer) if word_end else None

    def learn(self, wanted: set[str]) -> None:
        if len(self.kept) + len(wanted) > CACHE:
            self.kept, self.old = {}, self.kept
        new = []
        for p in wanted.difference(self.kept):
            ids = self.old.get(p)
            if ids is None:
                new.append(p)
            else:
                self.kept[p] = ids
        if self.ends is not None:
            words = [p for p in new if p.isalpha()]
            plain = [p for p in words if self.bare and p.isascii() and p.islower()]
            new = [p for p in new if not p.isalpha()] + self._learn_words(plain, self.bare) + self._learn_words(list(set(words).difference(plain)), self.tokenizer)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.kept[p] = np.array(e.ids, self.dtype).tobytes()

    def _learn_words(self, words: list[str], tokenizer: Tokenizer) -> list[str]:
        """Returns the words that have to be encoded alone."""
        alone, width = [], np.dtype(self.dtype).itemsize
        lines = [words[i : i + 64] for i in range(0, len(words), 64)]
        for at in range(0, len(lines), 64):
            part = lines[at : at + 64]
            for line, e in zip(part, tokenizer.encode_batch_fast([" ".join(x) for x in part], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = (np.flatnonzero(self.ends[ids]) + 1) * width
                if len(ends) != len(line):
                    alone += line
                    continue
                raw, start = ids.tobytes(), 0
                for p, end in zip(line, ends.tolist()):
                    self.kept[p] = raw[start:end]
                    start = end
        return alone

    def encode(self, texts: list[str], cut: Callable[[str], list[str]]) -> Iterator[bytes]:
        """Each text's ids as little-endian integers. Texts go in groups, so that memory holds a
        bounded number of pieces besides those of one text."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(cut(text))
            held += len(group[-1])
            if held > 100_000:
                yield from self._join(group)
                group, held = [], 0
        yield from self._join(group)

    def _join(self, group: list[list[str]]) -> Iterator[bytes]:
        self.learn(set().union(*group))
        get = self.kept.__getitem__
        for g in group:
            yield b"".join(map(get, g))


def _bare(tokenizer: Tokenizer) -> Tokenizer | None:
    """The model behind a cut at white space alone: for words of lower-case ASCII letters, which normalizers
    and patterns leave as they are, if they do (all pairs of letters are tried)."""
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    probe = " ".join([a + b for a in letters for b in letters] + letters)
    same = bare.encode(probe, add_special_tokens=False).ids == tokenizer.encode(probe, add_special_tokens=False).ids
    return bare if same else None


def cut_at_spaces(text: str) -> list[str]:
    """Pieces that start with a single space before a character that is no white space, after one
    that is none, and single line feeds between such characters. PATTERN's tokens start there: they
    hold white space only as one leading space, or nothing else."""
    out: list[str] = []
    for line in _joined(text.split("\n"), "\n"):
        if out:
            out.append("\n")
        out.extend(_joined_spaces(line))
    return out


def _joined(parts: list[str], by: str) -> list[str]:
    """parts, those joined again whose ends at the cut are empty or white space."""
    if len(parts) == 1:
        return parts if parts[0] else []
    out = [parts[0]]
    for p in parts[1:]:
        last = out[-1]
        if p and last and not p[0].isspace() and not last[-1].isspace():
            out.append(p)
        else:
            out[-1] = last + by + p
    return out


def _joined_spaces(line: str) -> list[str]:
    parts = _joined(line.split(" "), " ")
    return [parts[0], *[" " + p for p in parts[1:]]] if parts else []


class Codec:
    """A byte-level BPE codec that travels to the executors as text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        chars = byte_chars()
        spell = lambda b: "".join(chars[x] for x in b)
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in recovered_merges(ranks)], ignore_merges=True)
        t = Tokenizer(model)
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        t.decoder = decoders.ByteLevel()
        self.json = t.to_str()

    @classmethod
    def from_ranks_file(cls, path: str, pattern: str) -> Codec:
        """path: lines of base64 token and rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def byte_table(self) -> list[bytes]:
        """Each id's bytes: the byte-to-character mapping reversed."""
        back = {c: b for b, c in enumerate(byte_chars())}
        vocab = json.loads(self.json)["model"]["vocab"]
        out = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            out[i] = bytes(back[c] for c in token)
        return out


_WORKER: dict[str, tuple[Pieces, list[bytes]]] = {}


def _worker(text: str) -> tuple[Pieces, list[bytes]]:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _WORKER:
        codec = Codec.__new__(Codec)
        codec.json = text
        _WORKER.clear()
        _WORKER[key] = Pieces(Tokenizer.from_str(text), "<u4"), codec.byte_table()
    return _WORKER[key]


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode_stream(ids: Iterable[int], table: list[bytes]) -> Iterator[str]:
    """Text as ids come in: bytes of a character that is split over ids wait for the rest of it;
    bytes that are no UTF-8 become U+FFFD."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield decoder.decode(table[i])
    yield decoder.decode(b"", True)


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def encode(docs: DataFrame, codec: Codec, offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int); with offsets also ends: where each id's bytes end in the text's
    UTF-8, and char_ends: the code point that holds the last of them, plus one."""
    text = codec.json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = _worker(text)
        size = np.array([len(b) for b in table])
        for b in _small(batches):
            texts = _texts(b, 1)
            ids = [np.frombuffer(x, "<u4") for x in pieces.encode(texts, cut_at_spaces)]
            cols = [b.column(0), pa.array([i.astype("i4") for i in ids], pa.list_(pa.int32()))]
            if offsets:
                ends = [np.cumsum(size[i]) for i in ids]
                starts = [np.cumsum((np.frombuffer(t.encode(), "u1") & 0xC0) != 0x80) for t in texts]
                cols += [pa.array(ends, pa.list_(pa.int64())), pa.array([s[e - 1] if len(e) else e for s, e in zip(starts, ends)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "ends", "char_ends"][: len(cols)])

    more = ", ends array<long>, char_ends array<long>" if offsets else ""
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {_kind(docs)}, ids array<int>{more}")


def round_trip_digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes are made and digested in
    one pass, batch by batch, without a shuffle."""
    text = codec.json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = _worker(text)
        for b in _small(batches):
            n, ids_sha, back_sha = [], [], []
            for x in pieces.encode(_texts(b, 1), cut_at_spaces):
                n.append(len(x) // 4)
                ids_sha.append(hashlib.sha256(x).hexdigest())
                back_sha.append(hashlib.sha256(decode_bytes(np.frombuffer(x, "<u4"), table)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, ids -> doc_id, text; a null array decodes to an empty text."""
    text = codec.json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = _worker(text)
        for b in _small(batches):
            out = ["".join(decode_stream(i or (), table)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {_kind(encoded)}, text string")


def encode_stage(docs: DataFrame, codec: Codec) -> DataFrame:
    """The pipeline's last stage: docs' columns, ids and n_tokens, in one pass. Columns of docs that have these
    two names go; all others come back as they were. A null text has no ids; repeated rows stay."""
    text = codec.json
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    docs, at = numbered(docs.select(*[f"`{c}`" for c in keep])), keep.index("text")
    names = [*docs.columns, "ids", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _worker(text)
        for b in _small(batches):
            ids = [np.frombuffer(x, "<u4").astype("i4") for x in pieces.encode(_texts(b, at), cut_at_spaces)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64())], names)

    schema = ", ".join(f"{c} {_kind(docs, c)}" for c in docs.columns)
    return docs.mapInArrow(tidy(run), f"{schema}, ids array<int>, n_tokens long").toDF(*keep, "ids", "n_tokens")
