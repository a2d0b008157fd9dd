"""Token ids in binary files with a shared zstandard dictionary.

Ids of a document are little-endian integers of 2 bytes (4 where the vocabulary needs it),
compressed as a frame of its own with a dictionary trained on serialized id arrays. Frames stand
in blocks; a block's row holds its first and last doc_id, the documents' ids, their numbers of
tokens, and each frame's end in the payload (the offset index), the dictionary's hash and the
payload. A short document is read by its block's row alone: doc_id bounds prune the rest.

Layout under the path given: ``dictionary`` (hash, data) and ``blocks``, both Parquet that Spark
writes, so a lost executor or a repeated task leaves no half-written file. Blocks' payloads are
stored as they are.

The dictionary comes from a bounded sample (SAMPLE documents, SAMPLE_CHARS characters of each, which any place
in them may give); below 64 documents or 128 KiB of their ids, too little to train on, their own bytes
are the dictionary. It changes the stored bytes alone: every document is written whole.

Defined results: a null text counts as empty, so it holds the end id only; documents are in
ascending doc_id order, nulls first, equal ids by their text; repeated rows stay; other columns
are ignored; an empty table gives no blocks and a dictionary without data.
"""

from __future__ import annotations

import hashlib
import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Pieces
from .common import new_path, small_batches, tidy
from .common import small as _small

#: The dictionary is trained on this many documents (the smallest hashes), a stretch from anywhere in each,
#: and has this many bytes at most.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 512, 20_000, 65_536
BLOCK_BYTES, BLOCK_DOCS, LEVEL = 1 << 20, 4096, 3
#: ASCII marks but the apostrophe, which can go with letters.
_TAIL = string.punctuation.replace("'", "")
#: The suffix of tokens that end a word.
WORD_END = "</w>"
#: Bytes of text that are encoded together.
GROUP_BYTES = 6 << 20


@lru_cache(4096)
def _stays_letter(c: str) -> bool:
    """Whether c as the tokenizer normalizes it is letters alone: a mark would go with what follows."""
    return c.isascii() or unicodedata.normalize("NFC", c).lower().isalpha()


def _strings(a: pa.Array) -> list[str]:
    """Strings without line feeds: one string cut up is much faster than a string each."""
    if not len(a):
        return []
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a), "\n")
    return whole[0].as_py().split("\n")


def halves(pieces: pa.Array) -> tuple[pa.Array, list[str], np.ndarray]:
    """What pieces without ASCII white space fall into: a word for each; the distinct marks that are cut off
    ends of words, "" first; the number of its marks for each. The tokenizer matches letters and marks
    apart, so marks after a letter can go; after a letter that is normalized to more than letters they stay."""
    word = pc.utf8_rtrim(pieces, _TAIL)
    cut = pc.and_(pc.not_equal(word, pieces), pc.utf8_is_alpha(word))
    odd = pc.and_(cut, pc.invert(pc.string_is_ascii(word)))
    if pc.any(odd).as_py():
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = cut.to_numpy(zero_copy_only=False).copy()
        cut[at] = [_stays_letter(w[-1]) for w in _strings(word.take(pa.array(at)))]
        cut = pa.array(cut)
    marks, number = {"": 0}, np.zeros(len(pieces), np.int64)
    number[cut.to_numpy(zero_copy_only=False)] = [marks.setdefault(p[len(w) :], len(marks)) for p, w in zip(_strings(pieces.filter(cut)), _strings(word.filter(cut)))]
    return pc.if_else(cut, word, pieces), list(marks), number


def _placed(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of ids of the given sizes, those numbered at in a row; and where each of them ends."""
    start, n = np.cumsum(size) - size, size[at]
    ends = np.cumsum(n)
    return ids[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def encoded(pieces: Pieces, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text, as little-endian integers. Arrow cuts the texts at ASCII white space, which the
    tokenizer drops, and numbers the distinct words; only these become Python strings and are looked up,
    and ids are put in their places by number. ASCII texts are lower-cased before, as the tokenizer does,
    where that can't make a special token: it leaves fewer distinct words."""
    texts = texts.fill_null("")
    plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    cut = pc.ascii_split_whitespace(pc.if_else(plain, pc.ascii_lower(texts), texts))
    numbered = cut.flatten().dictionary_encode()
    word, marks, mark = halves(numbered.dictionary)
    word = word.dictionary_encode()
    known = [*_strings(word.dictionary), *marks]
    pieces.learn(set(known))
    raw = list(map(pieces.kept.__getitem__, known))
    ids = np.frombuffer(b"".join(raw), pieces.dtype)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // ids.itemsize
    # each distinct piece is its word's ids and its marks'; then each place in the texts is a piece's
    both = np.stack([word.indices.to_numpy(), mark + len(word.dictionary)], 1).ravel()
    of_piece, ends = _placed(ids, size, both)
    ids, ends = _placed(of_piece, np.diff(ends[1::2], prepend=0), numbered.indices.to_numpy())
    of_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))])]
    for i, j in zip(of_text[:-1].tolist(), of_text[1:].tolist()):
        yield ids[i:j].tobytes()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of column 1 by some GROUP_BYTES: more rows have fewer distinct words each, and memory holds some
    twenty bytes for each byte of them. A longer text goes alone, whole."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(1).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GROUP_BYTES, "right")))
            yield b.slice(at, to - at)
            at = to


_WORKER: dict[str, Pieces] = {}


def _pieces(text: str, dtype: str) -> Pieces:
    key = hashlib.sha256(text.encode()).hexdigest() + dtype
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Pieces(Tokenizer.from_str(text), dtype, WORD_END)
    return _WORKER[key]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Trained where there is enough to train on, else the samples' own bytes."""
    samples = [s for s in samples if s]
    if len(samples) >= 64 and sum(map(len, samples)) >= 16 * 8192:
        try:
            return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 16), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


_BLOCK = "part int, block int, first_id {0}, last_id {0}, width int, dict_hash string, tokens long, doc_ids array<{0}>, counts array<long>, ends array<long>, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1, path: str | None = None, dictionary_bytes: int = DICTIONARY) -> str:
    """Writes docs' ids in ascending doc_id order; returns the path. tokenizer: a file of the
    tokenizers library whose pre-tokenizer drops white space."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    t = Tokenizer.from_file(tokenizer)
    text, dtype = t.to_str(), "<u2" if t.get_vocab_size() <= 65_536 else "<u4"
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # ids alone give the hash that bounds the sample; then only rows within it reach the driver
    h = F.xxhash64("doc_id")
    bound = [r["h"] for r in d.select(h.alias("h")).orderBy("h").limit(SAMPLE).collect()]
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    few = d.where(h <= (bound[-1] if bound else 0)).select(h.alias("h"), F.substr("text", place, F.lit(SAMPLE_CHARS)).alias("t")).orderBy("h", "t").limit(SAMPLE)
    pieces = _pieces(text, dtype)
    data = train_dictionary(list(encoded(pieces, pa.array([r["t"] for r in few.collect()], pa.string()))), dictionary_bytes)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data))], "hash string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
    width, kind = int(dtype[-1]), docs.schema["doc_id"].dataType.simpleString()
    schema = _BLOCK.format(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _pieces(text, dtype), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))
        ids, counts, ends, frames, at, block = [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            vals = [part, block, ids[0], ids[-1], width, sha, sum(counts), list(ids), list(counts), list(ends), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(vals, arrow)], schema=arrow)

        arrow = None
        for b in _slices(batches):
            if arrow is None:
                k = b.schema.field(0).type
                arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", k), ("last_id", k), ("width", pa.int32()), ("dict_hash", pa.string()), ("tokens", pa.int64()), ("doc_ids", pa.list_(k)), ("counts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
            for i, raw in zip(b.column(0).to_pylist(), encoded(own, b.column(1))):
                raw += end
                frame = press.compress(raw)
                if ids and (at + len(frame) > BLOCK_BYTES or len(ids) >= BLOCK_DOCS):
                    yield row()
                    ids, counts, ends, frames, at, block = [], [], [], [], 0, block + 1
                at += len(frame)
                ids.append(i)
                counts.append(len(raw) // width)
                ends.append(at)
                frames.append(frame)
        if ids:
            yield row()

    # the ids are made after the only shuffle: range partitioning samples its input, which is a scan here
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with small_batches(spark, 2048):
        ordered.mapInArrow(tidy(run), schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with base: the number of ids in all blocks before. Running sums go by parts (one row
    for each partition written), then by the blocks of a part."""
    b = spark.read.parquet(f"{path}/blocks")
    parts = b.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = b.select("part", "block", inner.alias("own")).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    bases = bases.select("part", "block", (F.col("before") + F.col("own")).alias("base"))
    return b.join(bases, ["part", "block"])


def _frames(b: pa.RecordBatch, data: dict[str, bytes], wanted: set | None = None) -> Iterator[tuple]:
    """(doc_id, tokens before it in its block, width, raw ids) of each document."""
    for r in b.to_pylist():
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(data[r["dict_hash"]]))
        at, seen = 0, 0
        for i, n, end in zip(r["doc_ids"], r["counts"], r["ends"]):
            if wanted is None or i in wanted:
                yield i, seen + r.get("base", 0), r["width"], press.decompress(r["payload"][at:end])
            at, seen = end, seen + n


def _dictionaries(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r["hash"]: bytes(r["data"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


_COLUMNS = ["width", "dict_hash", "doc_ids", "counts", "ends", "payload"]


def token_digests(path: str) -> DataFrame:
    """Read from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = SparkSession.active()
    data = _dictionaries(spark, path)
    blocks = read_blocks(spark, path).select("base", *_COLUMNS)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 1):
            k = b.schema.field("doc_ids").type.value_type
            ids, start, n, crc = [], [], [], []
            for i, before, width, raw in _frames(b, data):
                ids.append(i)
                start.append(before)
                n.append(len(raw) // width)
                crc.append(zlib.crc32(raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, k), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(tidy(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of a few documents: doc_id bounds prune the blocks, the offset index the frames."""
    data, want = _dictionaries(spark, path), set(doc_ids)
    b = spark.read.parquet(f"{path}/blocks")
    near = F.lit(False)
    for i in want:
        near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    out = {}
    for r in b.where(near).select(*_COLUMNS).toLocalIterator():
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(data[r["dict_hash"]]))
        at = 0
        for i, end in zip(r["doc_ids"], r["ends"]):
            if i in want:
                out[i] = np.frombuffer(press.decompress(bytes(r["payload"][at:end])), f"<u{r['width']}").tolist()
            at = end
    return out
