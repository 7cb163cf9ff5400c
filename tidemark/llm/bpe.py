"""BPE encoding and decoding of whole texts.

Encoding: a backtracking encoder. An Aho-Corasick automaton gives the longest
vocabulary entry at every position of a word; the encoder walks forward taking
the longest one that is *compatible* with its left neighbour (the pair could not
have been merged into something of earlier rank across the border) and backs up
to the next shorter prefix where none is. This yields exactly the merges that
repeated lowest-rank merging yields, in time linear in the word.

Decoding: one table of bytes with offsets; the bytes of a whole batch of ids
are gathered by numpy.

Edge cases: a null text counts as empty and gives no ids; strings of special
tokens inside a text become their ids, as the tokenizers library has it; words
of any length are encoded whole; rows are independent, so ties, repeated rows,
extra columns and empty tables need nothing.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Cache, claim, owns

#: Entries of the caches of chunks between blanks and of words; a full one starts anew.
CHUNKS, WORDS = 250_000, 600_000
#: Longer ones are not kept.
CACHE_CHARS = 48
#: What Python splits at but the vocabulary's pattern does not.
BEYOND_LATIN = regex.compile("[^\x00-\u024f]")
_ODD_BLANKS = regex.compile("[\x1c-\x1f\x85᠎]")


def byte_chars() -> list[str]:
    """The usual printable stand-in for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


def word_pattern(spec: dict) -> str:
    """The pre-tokenizer's pattern; only what these vocabularies use is known."""
    pre = spec.get("pre_tokenizer") or {"type": None}
    split = next((p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"), None)
    if split is None or not (split["behavior"] == "Removed" and split["invert"]):
        raise ValueError("only vocabularies whose pattern drops white space are supported")
    norm = spec.get("normalizer") or {}
    kinds = [n.get("type") for n in norm.get("normalizers", [norm])]
    if kinds != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"unsupported normalizer {kinds}")
    return split["pattern"]["Regex"]


def split_chunk(chunk: str, pattern: regex.Pattern) -> list[str]:
    """Words of a chunk without blanks; most are letters with at most a mark behind."""
    if chunk.isalpha():
        return [chunk]
    if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
        return [chunk[:-1], chunk[-1]]
    return pattern.findall(chunk)


class BacktrackingBpe:
    """Encoder and decoder over a ``tokenizer.json`` with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = byte_chars()

        # Own numbers by rank: base symbols first, then merge results in merge order.
        base = list(names) + ([c + suffix for c in names] if suffix else [])
        base = [s for s in base if s in vocab]
        number = {s: i for i, s in enumerate(base)}
        split: list[tuple[int, int]] = [(i, i) for i in range(len(base))]
        expand = [chr(0x3400 + i) for i in range(len(base))]
        pair: dict[tuple[int, int], int] = {}
        strings = list(base)
        for a, b in merges:
            joined = (a[: -len(suffix)] if suffix and a.endswith(suffix) and len(a) > len(suffix) else a) + b
            i, j = number[a], number[b]
            if joined not in number:
                number[joined] = len(strings)
                strings.append(joined)
                split.append((i, j))
                expand.append(expand[i] + expand[j])
            pair.setdefault((i, j), number[joined])
        self._ids = [vocab[s] for s in strings]
        self._split, self._pair = split, pair
        self._len = [len(e) for e in expand]
        by_text = {e: i for i, e in enumerate(expand)}
        self._prefix = [next((by_text[e[:n]] for n in range(len(e) - 1, 0, -1) if e[:n] in by_text), -1) for e in expand]
        self._trie = ahocorasick.Automaton()
        for e, i in by_text.items():
            self._trie.add_word(e, i)
        self._trie.make_automaton()
        self._inner = [chr(0x3400 + number[c]) for c in names]
        self._last = [chr(0x3400 + number[c + suffix]) for c in names] if suffix else self._inner
        self._fits: dict[int, bool] = {}

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._word = regex.compile(word_pattern(spec))
        self._library = Tokenizer.from_file(path)  # its normalizer and pattern, for rare scripts
        self._cache = Cache(self._encode_chunk, CHUNKS, CACHE_CHARS)
        self._words = Cache(self._encode_word, WORDS, CACHE_CHARS)

        by_id = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        size = max(by_id) + 1
        raw = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        back = self._back = {c: b for b, c in enumerate(names)}
        self.separator = b"" if raw else b" "  # without a decoder the library joins tokens by a blank
        pieces = []
        for i in range(size):
            s = by_id.get(i, "")
            own = bytes(back[c] for c in s) if raw and i not in self.special.values() else s.encode()
            pieces.append(own + self.separator if i in by_id else b"")
        self._offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self._bytes = np.frombuffer(b"".join(pieces), np.uint8)

    # -- encoding ---------------------------------------------------------
    def _compatible(self, a: int, b: int) -> bool:
        """Whether a, b side by side is what merging in rank order leaves."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        pair, split, limit, x, y, ok = self._pair, self._split, 1 << 40, a, b, True
        while True:
            made = pair.get((x, y))
            if made is not None and made < limit:
                ok = False
                break
            if x > y:
                limit = x
                x = split[x][1]
                if x == limit:
                    limit = y + 1
                    y = split[y][0]
                    if y + 1 == limit:
                        break
            else:
                limit = y + 1
                y = split[y][0]
                if y + 1 == limit:
                    limit = x
                    x = split[x][1]
                    if x == limit:
                        break
        self._fits[key] = ok
        return ok

    def _encode_word(self, word: str) -> tuple[int, ...]:
        return self._encode_bytes(word.encode())

    def _encode_bytes(self, raw: bytes) -> tuple[int, ...]:
        inner = self._inner
        s = "".join([inner[b] for b in raw[:-1]]) + self._last[raw[-1]]
        n, length, prefix, fits = len(s), self._len, self._prefix, self._compatible
        longest = [0] * n
        for end, t in self._trie.iter(s):  # ends ascend, so the longest of each start stays
            longest[end - length[t] + 1] = t
        if length[longest[0]] == n:  # the whole word is one entry
            return (self._ids[longest[0]],)
        out: list[int] = []
        open_at = bytearray(b"\1") * (n + 1)
        at, t = 0, longest[0]
        while True:
            end = at + length[t]
            if open_at[end] and (not out or fits(out[-1], t)):
                out.append(t)
                at = end
                if at == n:
                    break
                t = longest[at]
            elif prefix[t] >= 0:
                t = prefix[t]
            else:
                open_at[at] = 0
                t = out.pop()
                at -= length[t]
        ids = self._ids
        return tuple([ids[t] for t in out])

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if BEYOND_LATIN.search(chunk):  # Unicode versions may differ here: the library's own tables decide
            text = self._library.normalizer.normalize_str(chunk)
            pieces = [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]
            return tuple(chain.from_iterable(self._encode_bytes(bytes([self._back[c] for c in p])) for p in pieces))
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._words[chunk]
        return tuple(chain.from_iterable([self._words[w] for w in split_chunk(chunk, self._word)]))

    def _encode_plain(self, text: str) -> list[int]:
        if _ODD_BLANKS.search(text):
            return list(self._encode_chunk(text))
        if text.isascii() or not BEYOND_LATIN.search(text):
            text = text.lower()
        cache = self._cache
        return list(chain.from_iterable([cache[c] for c in text.split()]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self._special is None or not self._special.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._encode_plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._encode_plain(text[at:])

    # -- decoding ---------------------------------------------------------
    def decode(self, ids) -> str:
        """Special tokens are kept."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        begin, lengths = self._offsets[ids], self._offsets[ids + 1] - self._offsets[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - lengths), lengths)
        data = self._bytes[at].tobytes()
        return data[: len(data) - len(self.separator)].decode(errors="replace")


@lru_cache(maxsize=4)
def load(path: str) -> BacktrackingBpe:
    """One per worker process and vocabulary."""
    claim("bpe")
    return BacktrackingBpe(path)


owns("bpe", load.cache_clear)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the ids of the whole text (array<int>; empty for null)."""

    @F.arrow_udf("array<int>")
    def to_ids(col: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.encode(t) for t in col.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(out, to_ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the decoded text of an array of ids (empty for null)."""

    @F.arrow_udf("string")
    def to_text(col: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.decode(x or []) for x in col.to_pylist()], pa.string())

    return df.withColumn(out, to_text(F.col(ids)))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, decode and digest
    in one pass, so that the ids of a document never leave its worker."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(col: pa.Array) -> pa.Array:
        bpe = load(path)
        sha = hashlib.sha256
        rows = []
        for t in col.to_pylist():
            ids = bpe.encode(t)
            rows.append({"n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids)).encode()).hexdigest(), "decoded_sha256": sha(bpe.decode(ids).encode()).hexdigest()})
        return pa.array(rows, kind)

    return df.select(F.col("doc_id"), digest(F.col(text)).alias("d")).select("doc_id", "d.*")
