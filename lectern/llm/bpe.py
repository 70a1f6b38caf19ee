"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up every
neighbouring pair in the sorted pair keys by binary search, finds each word's
lowest rank and merges that pair wherever it stands in the word, left to right.
Words without a mergeable pair leave the array, so it shrinks from round to
round. A merge's result only takes part in later merges, so merging all places of
a word's lowest pair at once gives what merging them one by one gives.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty

#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Units of text, and tokens before merging, that a worker keeps encoded. Once full,
#: what else a batch needs is encoded for that batch alone.
CACHE_UNITS = 400_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Encoded strings: the first ``CACHE_UNITS`` stay, the rest serve one batch."""

    def __init__(self):
        self.rest: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        return self.rest[key]

    def room(self) -> dict[str, bytes]:
        """Where new strings go."""
        return self if len(self) < CACHE_UNITS else self.rest


class ByteBpe:
    """Encoder and decoder of one tokenizer file (JSON of the ``tokenizers`` library, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["model"]["type"], spec["pre_tokenizer"]["type"], spec["normalizer"]
        if kind != ("BPE", "ByteLevel", None) or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.size_of = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)])
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.flat = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), dtype=np.uint8)
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in symbols.items():
            self.of_byte[b] = vocab[c]
        self.base = np.int64(max(self.bytes_of) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.split = regex.compile(PATTERN)
        # a lone space between two other characters always begins a token: exact places to cut
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.first, self.later = Known(), Known(), Known()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        none = len(self.merged)
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            best = np.repeat(lowest, sizes)
            stuck = best == none
            if stuck.any():
                done_symbols.append(symbols[stuck])
                done_words.append(word[stuck])
                symbols, word, rank, best = (x[~stuck] for x in (symbols, word, rank, best))
                if not len(symbols):
                    break
            hit = rank == best
            # in a run of overlapping places every second one counts, from the left
            place = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            within = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[within % 2 == 0]
            symbols[place] = self.merged[rank[place]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        symbols = symbols[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [symbols[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def learn(self, missing: set[str], known: Known, lead: str) -> None:
        """Encode units not seen before and add them to ``known``."""
        units = list(missing)
        split = [self.split.findall(lead + u) for u in units]
        words = [w for w in set().union(*split) if w not in self.words]
        self.words.room().update(zip(words, self.merge([w.encode() for w in words])))
        get, room = self.words.__getitem__, known.room()
        for u, ws in zip(units, split):
            room[u] = get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for known in (self.words, self.first, self.later):
            known.rest = {}
        # a text is a list of special ids and of lists of units: its parts cut at spaces
        split = [[self.special[x] if x in self.special else x.split(" ") for x in (self.parts.split(t) if self.parts else [t]) if x] for t in texts]
        parts = [(own, k) for own in split for k, x in enumerate(own) if not isinstance(x, int)]
        laters = set().union(*(own[k][1:] for own, k in parts))
        missing = {u for u in laters if u not in self.later}
        # a space next to other white space begins no token: such parts are cut with more care
        odd = {u for u in missing if not u or u[0].isspace() or u[-1].isspace()}
        missing -= odd
        for own, k in parts:
            cut = own[k]
            if len(cut) > 1 and (not cut[0] or cut[0][-1].isspace() or odd and not odd.isdisjoint(cut[1:])):
                own[k] = self.cut.split(" ".join(cut))
                missing.update(u for u in own[k][1:] if u not in self.later)
        self.learn({own[k][0] for own, k in parts if own[k][0] not in self.first}, self.first, "")
        self.learn(missing, self.later, " ")
        first, later, out = self.first, self.later.__getitem__, []
        for own in split:
            got = [x.to_bytes(4, "little") if isinstance(x, int) else first[x[0]] + b"".join(map(later, x[1:])) for x in own]
            out.append(got[0] if len(got) == 1 else b"".join(got))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        ids = np.frombuffer(ids, dtype="<u4")
        sizes = self.size_of[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start_of[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_held: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    if path not in _held:
        _held[path] = ByteBpe(path)
    return _held[path]


def _slices(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for x in texts:
        if part and size + len(x) > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row ``(id, ids, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs``.

    ``ids`` is the encoding as an array of integers, null unless ``with_ids``. A null
    text counts as empty; an empty text has no ids. Repeated rows each get a row, a
    null id stays null, other columns are ignored, whatever their names. There is no
    shuffle; a task holds one batch of texts and a bounded cache of encoded units.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def columns(b: pa.RecordBatch) -> list:
        coder = tokenizer(path)
        coded = [ids for part in _slices(b.column(1).to_pylist()) for ids in coder.encode_batch(part)]
        return [
            b.column(0),
            [np.frombuffer(ids, dtype="<i4") if with_ids else None for ids in coded],
            [len(ids) // 4 for ids in coded],
            [hashlib.sha256(ids).hexdigest() for ids in coded],
            [hashlib.sha256(coder.decode(ids).encode()).hexdigest() for ids in coded],
        ]

    return map_arrow(docs.select(F.col(id_col), text_or_empty(text_col)), columns, schema).withColumnRenamed("id", id_col)
