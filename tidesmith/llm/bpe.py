"""Byte-pair encoding and decoding with a published vocabulary.

A word's symbols form a doubly linked list; a priority queue holds the merge
rank of every adjacent pair. The lowest rank is popped, skipped if the pair it
names has changed meanwhile, else merged, and the new neighbours' ranks are
pushed. Decoding joins the vocabulary strings of the ids.

Words between white space are independent of each other, so equal words of a
batch are encoded once, and a worker remembers the ids of the words of up to 64
characters that it has seen, in a bounded memory.

Null and empty texts encode to no ids and decode to the empty text. Long texts
are encoded whole; batches are cut so that a worker holds few of them. Repeated
rows get equal ids. There are no ties: of equal ranks the leftmost pair merges
first. An empty table gives an empty one. Extra columns, of any name, are
untouched, but for result names, which are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import by_arrow, named, rows_by_batch, table
from .wordscan import LOWER, Scan

#: Fixed values of this tokenizer's file: the pieces that its pre-tokenizer splits a word into.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters need no Unicode normalisation, and lower-case one by one.
PLAIN = re.compile("[!-~\xa1-\xac\xae-\xff]*")
WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: White space beyond ASCII, and what str.split() takes for it, in UTF-8.
SPACED = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80"
MARKS, ALNUM = (np.array([chr(b) in kind for b in range(256)]) for kind in (".,;:!?", "0123456789abcdefghijklmnopqrstuvwxyz"))
CONTROL = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte value: itself where it is visible, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Remembered(dict):
    """What `make` gives for a key, for the keys of up to LONGEST characters met lately: of two generations the older goes when the younger is full."""

    LONGEST = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > self.LONGEST:
            return self.make(key)
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class BpeCodec:
    """Encodes texts to ids (as little-endian unsigned 32-bit bytes) and decodes ids.

    remembered: words and pieces kept in a worker's memory (about 200 bytes each).
    library_merges: leave the merging of a piece to the tokenizers library, for
    callers that only need its ids.
    """

    def __init__(self, path: str | None = None, remembered: tuple[int, int] = (40_000, 100_000), library_merges: bool = False):
        self.path = path or default_tokenizer()
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        #: By rank: the pair's two ids in one integer, and the id that it merges to.
        self.pair_of = [self.vocab[a] << 20 | self.vocab[b] for a, b in pairs]
        self.new_of = [self.vocab[a + b] for a, b in pairs]
        self.rank_of = {p: r for r, p in enumerate(self.pair_of)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.odd = re.compile(b"|".join([SPACED, *(re.escape(c.encode()) for c in self.special)]))
        self.odd_first = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, *(c.encode()[0] for c in self.special)])
        self.visible = dict(enumerate(byte_characters()))
        by_id = {i: s for s, i in (self.vocab | self.special).items()}
        self.strings = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.bytes_as = byte_characters()
        self.library = None
        self.library_merges = self._library().model if library_merges else None
        self.words, self.pieces = Remembered(self._word, remembered[0]), Remembered(self._piece, remembered[1])

    def _word(self, word: str) -> bytes:
        if LETTERS.fullmatch(word):  # one piece
            return self.pieces[word.lower().encode().decode("latin-1").translate(self.visible)]
        body, tail = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        if body.isascii() and body.isalpha():  # a word and its punctuation: two pieces
            return self.pieces[body.lower()] + self.pieces[tail] if tail else self.pieces[body.lower()]
        return b"".join([self.pieces[p] for p in self.split(word)])

    def _piece(self, piece: str) -> bytes:
        if self.library_merges is not None:
            return array("I", [t.id for t in self.library_merges.tokenize(piece)]).tobytes()
        return array("I", self.merge(piece)).tobytes()

    def _library(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def split(self, word: str) -> list[str]:
        """Normalised pieces of a word without white space, in the characters that stand for bytes."""
        if PLAIN.fullmatch(word):
            found = PIECES.findall(word.lower())
            return found if word.isascii() else ["".join([self.bytes_as[b] for b in p.encode()]) for p in found]
        library = self._library()
        return [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(word))]

    def merge(self, piece: str) -> list[int]:
        vocab, rank_of, pair_of, new_of = self.vocab, self.rank_of, self.pair_of, self.new_of
        ids = [vocab[c] for c in piece[:-1] if c in vocab]
        if (last := piece[-1:] + self.end) in vocab:
            ids.append(vocab[last])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            x = heapq.heappop(queue)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if j >= n or ids[i] < 0 or ids[i] << 20 | ids[j] != pair_of[r]:
                continue  # stale: one of the two was merged since
            ids[i], ids[j] = new, _ = new_of[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of.get(new << 20 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of.get(ids[h] << 20 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special_at and self.special_at.search(text):
            out, start = [], 0
            for m in self.special_at.finditer(text):
                out += [self._encode(text[start : m.start()]), self.special[m[0]].to_bytes(4, "little")]
                start = m.end()
            return b"".join([*out, self._encode(text[start:])])
        return self._encode(text)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin. Words that are equal are looked up once; texts with white space beyond ASCII or special tokens go one by one."""
        scan = Scan(texts)
        starts, ends = scan.words
        data = LOWER[scan.data]
        # a mark behind a letter or digit is a piece of its own: most words differ by it alone
        if len(ends):
            before, second = data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
            marked = MARKS[data[ends - 1]] & (ends - starts > 1) & (ALNUM[before] | (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ends - starts > 2))
            tails, where = ends[marked] - 1, np.flatnonzero(marked)
            starts, ends = np.insert(starts, where + 1, tails), np.insert(ends, where, tails)
        of, at = scan._text_of(starts), np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
        own = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[~scan.space])])
        # only bytes that may begin such white space or a special token are looked at
        may = np.flatnonzero(self.odd_first[scan.data])
        found = [m.start() for m in self.odd.finditer(scan.data)] if len(may) > len(data) // 20 else [k for k in may.tolist() if self.odd.match(scan.data, k)]
        odd = np.unique(scan._text_of(np.array(found, np.int64)))
        if len(odd):
            plain = ~np.isin(of, odd)
            own, of = own.filter(pa.array(plain)), of[plain]
        own = own.dictionary_encode()
        known = [self.pieces[w] if w.isascii() and w.isalpha() else self.words[w] for w in own.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size, word = np.array([len(x) // 4 for x in known], np.int64), own.indices.to_numpy()
        flat, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        each = size[word]
        ids = flat[np.repeat(first[word] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        begin = np.concatenate(([0], np.cumsum(np.bincount(of, each, scan.n).astype(np.int64))))
        if not len(odd):
            return ids, begin
        parts = [ids[begin[i] : begin[i + 1]] for i in range(scan.n)]
        for i in odd.tolist():
            parts[i] = np.frombuffer(self.encode_bytes(texts[i].as_py()), "<u4")
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _encode(self, text: str) -> bytes:
        words = text.split() if not CONTROL.search(text) else [w for w in WHITE.split(text) if w]
        return b"".join(map(self.words.__getitem__, words))

    @cached_property
    def spaced(self) -> pa.Array:
        return pa.array([x + " " for x in self.strings], pa.large_string())

    def decode_batch(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The texts of ids[begin[i] : begin[i + 1]]: bytes in UTF-8, and where in them each text starts and ends."""
        own = self.spaced.take(pa.array(ids))
        _, at, data = own.buffers()
        at = np.frombuffer(at, np.int64)[: len(ids) + 1][begin] if len(ids) else np.zeros(len(begin), np.int64)
        first, last = at[:-1], np.maximum(at[1:] - 1, at[:-1])  # no space behind a text's last string
        return np.frombuffer(data if data is not None else b"", np.uint8), list(zip(first.tolist(), last.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


_CODECS: dict[tuple, BpeCodec] = {}


def codec(path: str | None = None, library_merges: bool = False) -> BpeCodec:
    """One codec per worker and vocabulary."""
    if (path, library_merges) not in _CODECS:
        _CODECS[path, library_merges] = BpeCodec(path, library_merges=library_merges)
    return _CODECS[path, library_merges]


def bpe_encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """df with the token ids of `text` as array<bigint> column `ids` (replaced if it is there)."""
    stay = [c for c in df.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in rows_by_batch(batches, column=text):
            found, begin = own.encode_batch(b.column(text))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.ListArray.from_arrays(begin.astype(np.int32), found.astype(np.int64))], names=[*stay, ids])

    return by_arrow(df.select(*map(named, dict.fromkeys([*stay, text]))), run, [*(df.schema[c] for c in stay), T.StructField(ids, T.ArrayType(T.LongType()))])


def bpe_decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of the token ids as column `text` (replaced if it is there); null ids give the empty text."""
    stay = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            found = [own.decode(np.asarray(x or [], np.int64)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.array(found, pa.string())], names=[*stay, text])

    return by_arrow(df.select(*map(named, dict.fromkeys([*stay, ids]))), run, [*(df.schema[c] for c in stay), T.StructField(text, T.StringType())])


def bpe_digests(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass, so no ids cross between workers."""
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in rows_by_batch(batches, column=text):
            ids, begin = own.encode_batch(b.column(text))
            held, ends = own.decode_batch(ids, begin)
            encoded = [sha256(ids[i:j]).hexdigest() for i, j in zip(begin[:-1], begin[1:])]
            decoded = [sha256(held[i:j]).hexdigest() for i, j in ends]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(begin), pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    digests = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return by_arrow(df.select(named(key), named(text)), run, [df.schema[key], *digests])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), "doc_id")
