"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank among the corpus' ids (0: most frequent), each rank
takes 1 to 4 bytes, and the lengths stand apart in control bytes, two bits for each
of four ids. Reading looks four lengths up by each control byte in a table and
gathers the data bytes by numpy; no id is decoded on its own.

A file holds documents of ascending id: a header, their ids and lengths, control
bytes, data bytes. Files follow each other in the order (part, number). A task
names its files by its own attempt, and the table of files that Spark commits says
which of them hold, so retries and lost executors need no rename and leave no half
result. The folder is one that all executors share.

Texts are encoded by the tokenizers library's model; equal words are encoded once
for each worker's cache.

Edge cases: a null text is an empty one and holds only the end id; null document
ids come first and any 64-bit id is kept; documents of equal id keep an order by
content, equal rows are documents each; a very long text is encoded whole; extra
columns are ignored; an empty table writes no file and reads back as no rows.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BEYOND_LATIN, byte_chars, split_chunk, word_pattern
from .common import claim, materialize, new_path, owns

MAGIC = b"FVB2"
#: Magic, part, number, attempt, documents, those of them without an id (they come first), ids, control bytes, data bytes.
HEAD = struct.Struct("<4sIIQQQQQQ")
#: Ids of one file, about.
FILE_IDS = 16_000_000
#: Entries of the caches of chunks between blanks and of words.
CHUNKS, WORDS = 600_000, 800_000
CACHE_CHARS = 48
#: Text that is split at once.
GROUP_BYTES = 8_000_000
_ODD_BLANKS = regex.compile("[\x1c-\x1f\x85]")
#: Beyond Latin, or what blanks and letter case make ambiguous.
_ODD = regex.compile("[^\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u024f]")

# Lengths of the four ids of each control byte.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)


# -- coding -----------------------------------------------------------------
def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks."""
    ranks = np.asarray(ranks, np.uint32)
    n = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    padded[: len(n)] = n
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    four = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), four[np.arange(4) <= n[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """Ranks again."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    begin = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(lengths > k)
        if not len(at):
            break
        out[at] |= raw[begin[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# -- encoding by the library --------------------------------------------------
class Encoder:
    """Texts of a batch are split at blanks together, each distinct chunk is looked up
    once, the library's model gets new words only, and Arrow gathers the ids."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype("<u2" if max(self.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = self._bytes([end_id])
        spec = json.loads(self.tok.to_str())
        self.model, self.chars = self.tok.model, byte_chars()
        try:
            self.pattern, self.plain = regex.compile(word_pattern(spec)), True
        except ValueError:
            self.plain = False
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):  # others stand for themselves
            chars = self.chars
            word = "".join([chars[b] for b in word.encode()])
        return self._bytes([t.id for t in self.model.tokenize(word)])

    def _known(self, word: str) -> bytes:
        known = self.words
        found = known.get(word)
        if found is None:
            found = self._word(word)
            if len(word) <= CACHE_CHARS:
                if len(known) >= WORDS:
                    known.clear()
                known[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """What stands between blanks. Within Latin letters, Unicode versions agree
        and the library's model gets the words; else the library does all."""
        if not chunk.isascii():
            if BEYOND_LATIN.search(chunk):
                return self._library([chunk])[0]
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._known(chunk)
        return b"".join([self._known(w) for w in split_chunk(chunk, self.pattern)])

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, from the cache where they are known."""
        known = self.chunks
        found = list(map(known.get, chunks))
        at = [i for i, x in enumerate(found) if x is None]
        if at:
            if len(known) + len(at) > CHUNKS:
                known.clear()
            new = [chunks[i] for i in at]
            for i, c, x in zip(at, new, map(self._chunk, new), strict=True):
                found[i] = x
                if len(c) <= CACHE_CHARS:
                    known[c] = x
        return found

    def _simple(self, text: str) -> bool:
        """Whether blanks part the text into chunks that are encoded alone."""
        if text.isascii():
            odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        else:
            odd = _ODD.search(text)
        return not odd and not (self.special and self.special.search(text))

    def _odd_text(self, text: str) -> bytes:
        """Other texts; chunks of letters beyond Latin go to the library each."""
        if _ODD_BLANKS.search(text) or self.special and self.special.search(text):
            return self._library([text])[0]
        own = text.split()
        return b"".join(map(dict(zip(d := list(dict.fromkeys(own)), self._ids_of(d), strict=True)).__getitem__, own))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id, as bytes of ``kind``."""
        end = self.end
        if not self.plain:  # a vocabulary whose steps aren't known here
            return [self._library([t])[0] + end if t else end for t in texts]
        out = [end] * len(texts)
        at, group = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self._simple(t):
                at.append(i)
                group.append(t.lower() if t.isascii() else t.lower().replace("\xa0", " "))
            else:
                out[i] = self._odd_text(t) + end
        if group:
            lists = pc.ascii_split_whitespace(pa.array(group, pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            pool = pa.array(self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary())
            taken = pool.take(coded.indices)
            _, ends, raw = taken.buffers()
            ends = np.frombuffer(ends, np.int64, len(taken) + 1)[lists.offsets.to_numpy()].tolist()
            raw = memoryview(raw) if raw else b""
            for i, x, y in zip(at, ends, ends[1:], strict=False):
                out[i] = bytes(raw[x:y]) + end
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


owns("tokenfiles", encoder.cache_clear)


def encode(df: DataFrame, path: str, end_id: int, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: ids as little-endian bytes of the vocabulary's width, end id last."""

    @F.arrow_udf("binary")
    def to_ids(col: pa.Array) -> pa.Array:
        claim("tokenfiles")
        enc, found, at = encoder(path, end_id), [], 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(col):  # groups of texts of a bounded size, or one text
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + GROUP_BYTES, side="right")))
            found += enc.encode(col.slice(at, to - at).to_pylist())
            at = to
        return pa.array(found, pa.binary())

    return df.withColumn(out, to_ids(F.col(text)))


# -- files --------------------------------------------------------------------
def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def rank_table(encoded: DataFrame, kind: str, size: int) -> np.ndarray:
    """Rank of each id by its count in the corpus; ties go to the smaller id."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # At most one row for each id of the vocabulary.
    found = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found.column("id").to_numpy()] = found.column("n").to_numpy()
    ranks = np.empty(size, np.uint32)
    ranks[np.argsort(-total, kind="stable")] = np.arange(size, dtype=np.uint32)
    return ranks


_FILES = "part int, number int, attempt long, n_docs long, n_ids long"


def save(folder: str, ranks: np.ndarray, kind: str, part: int, number: int, docs: list, lengths: list, ids: list) -> dict:
    """Writes one file under a name of this attempt; ``docs`` without an id come first."""
    control, data = pack(ranks[np.frombuffer(b"".join(ids), kind)])
    n, nulls, attempt = sum(lengths), docs.count(None), TaskContext.get().taskAttemptId()
    place, path = _place(folder)
    with place.open_output_stream(f"{path}/{part:08d}-{number:06d}-{attempt}.fvb") as f:
        f.write(HEAD.pack(MAGIC, part, number, attempt, len(docs), nulls, n, len(control), len(data)))
        f.write(np.array([d or 0 for d in docs], "<i8").tobytes() + np.array(lengths, "<u4").tobytes())
        f.write(control)
        f.write(data)
    return {"part": part, "number": number, "attempt": attempt, "n_docs": len(docs), "n_ids": n}


def write(spark: SparkSession, encoded: DataFrame, folder: str, kind: str, size: int) -> DataFrame:
    """Writes ``doc_id, ids`` in ascending order; returns a row for each file that counts.

    A retried task leaves files of its earlier attempt; only those in these rows hold.
    """
    ranks = spark.sparkContext.broadcast(rank_table(encoded, kind, size))
    place, path = _place(folder)
    place.create_dir(path)
    with place.open_output_stream(f"{path}/ranks.u4") as f:
        f.write(ranks.value.astype("<u4").tobytes())

    def run(batches):
        part, number, docs, lengths, ids, held, done = TaskContext.get().partitionId(), 0, [], [], [], 0, []
        width = np.dtype(kind).itemsize
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                docs.append(d)
                lengths.append(len(x) // width)
                ids.append(x)
                held += lengths[-1]
                if held >= FILE_IDS:
                    done.append(save(folder, ranks.value, kind, part, number, docs, lengths, ids))
                    number, docs, lengths, ids, held = number + 1, [], [], [], 0
        if docs:
            done.append(save(folder, ranks.value, kind, part, number, docs, lengths, ids))
        schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("attempt", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    ordered = encoded.select("doc_id", "ids", F.xxhash64("ids").alias("turn")).repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    return materialize(ordered.select("doc_id", "ids").mapInArrow(run, _FILES), "token-files")


def read_file(raw: bytes, ids_by_rank: np.ndarray) -> tuple[tuple[int, int, int], np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """Part, number and attempt, document ids (masked: null), lengths and all ids of one file."""
    magic, part, number, attempt, n_docs, n_null, n_ids, n_control, n_data = HEAD.unpack_from(raw)
    if magic != MAGIC or len(raw) != HEAD.size + 12 * n_docs + n_control + n_data:
        raise ValueError("not a whole token file")
    at = HEAD.size
    docs = np.ma.array(np.frombuffer(raw, "<i8", n_docs, at), mask=np.arange(n_docs) < n_null)
    lengths = np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    ranks = unpack(raw[at : at + n_control], raw[at + n_control :], n_ids)
    return (part, number, attempt), docs, lengths, ids_by_rank[ranks]


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that count."""
    place, path = _place(folder)
    with place.open_input_stream(f"{path}/ranks.u4") as f:
        ranks = np.frombuffer(f.read(), "<u4")
    by_rank = np.empty(len(ranks), "<u4")
    by_rank[ranks] = np.arange(len(ranks), dtype="<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    kind = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("attempt", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for raw in b.column("content"):
                own, docs, lengths, ids = read_file(raw.as_py(), shared.value)
                ends = np.cumsum(lengths.astype(np.int64))
                begins, n, view = ends - lengths, len(docs), memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                same = [pa.array(np.full(n, x, t)) for x, t in zip(own, (np.int32, np.int32, np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(docs.data, mask=docs.mask), pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=kind)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.fvb").schema("path string, modificationTime timestamp, length long, content binary")
    rows = content.load(folder).select("content").mapInArrow(run, "part int, number int, attempt long, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = files.select("part", "number", "attempt", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["part", "number", "attempt"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(df: DataFrame, path: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every text, writes token files, and returns what reading them gives."""
    spark = df.sparkSession
    enc = encoder(path, end_id)
    encoded = materialize(encode(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), path, end_id).select("doc_id", "ids"), "token-ids")
    folder = new_path(spark, "token-folder")
    files = write(spark, encoded, folder, enc.kind.str, max(enc.tok.get_vocab_size(), end_id + 1))
    return read(spark, folder, files)
