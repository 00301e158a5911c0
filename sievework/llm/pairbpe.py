"""Byte-level BPE by a pair occurrence index: the ids of the tokenizers library, and decoding.

The words of a block of a partition (the distinct pattern matches of its texts that are not remembered) lie one after
another in one array of symbols. An index maps each mergeable pair to all its positions. Ranks that have positions are
applied in ascending order: a rank's merge is made at all its positions from left to right, and only the lists of the
pairs that the merge makes with its neighbours are added to. A merge can only use symbols that merges of lower ranks made
(checked when the file is read), so a pair that appears is always of a higher rank than the one being applied, and one
pass over ascending ranks gives each word what merging its lowest-ranked pair again and again gives.

The file's added tokens are cut out of a text first and are one id each, as the library does. Decoding looks up each id's
bytes and joins them; special tokens are not skipped; bytes that are not UTF-8 become replacement characters.

Defined cases: a null or empty text has no ids and decodes to nothing; repeated rows are encoded each; an empty table
gives an empty result; other columns are ignored, whatever their names; a very long word is one word.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.bpe import LONE, MEMO, MEMO_LONGEST, word_pattern
from sievework.llm.common import map_batches

#: The tokenizer file; a parameter of every function that needs one.
TOKENIZER = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where it is printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizer file says: bytes' ids, ranked merges of two ids, the bytes of each id, and added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        ids, letters = file["model"]["vocab"], byte_letters()
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        #: Merges in ascending rank: what the two symbols are and what they become; and a pair's rank.
        self.left, self.right, self.made = [], [], []
        known = set(self.first.tolist())
        for a, b in file["model"]["merges"]:
            x, y, z = ids[a], ids[b], ids[a + b]
            if x not in known or y not in known:
                raise ValueError(f"{path}: a merge uses what no merge before it makes")
            known.add(z)
            self.left.append(x)
            self.right.append(y)
            self.made.append(z)
        self.rank = {x << 32 | y: r for r, (x, y) in enumerate(zip(self.left, self.right))}
        #: The rank of each pair of bytes, or -1.
        self.first_rank = np.array([[self.rank.get(x << 32 | y, -1) for y in self.first.tolist()] for x in self.first.tolist()], np.int32)
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(longest) + ")") if longest else None


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_block(words: list[bytes], vocab: Vocabulary) -> list[list[int]]:
    """The ids of each word, by the pair occurrence index over all of them."""
    left, right, made, rank_of = vocab.left, vocab.right, vocab.made, vocab.rank.get
    # One array for all words; -1 ends a word, and stands where a symbol was merged into the one before it.
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    raw = np.frombuffer(b"".join(words), np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(len(words)), size)
    n = int(starts[-1])
    flat = np.full(n, -1, np.int32)
    flat[at] = vocab.first[raw]
    symbols, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (flat, np.arange(1, n + 1), np.arange(-1, n - 1)))
    ranks = np.where(np.diff(at) == 1, vocab.first_rank[raw[:-1], raw[1:]], -1)
    held = np.flatnonzero(ranks >= 0)
    held = held[np.argsort(ranks[held], kind="stable")]
    found, cut = np.unique(ranks[held], return_index=True)
    places = {r: x.tolist() for r, x in zip(found.tolist(), np.split(at[held], cut[1:]))}
    active = list(places)
    heapify(active)
    while active:
        r = heappop(active)
        x, y, z = left[r], right[r], made[r]
        at = places.pop(r)
        at.sort()
        for i in at:
            j = after[i]
            if symbols[i] != x or symbols[j] != y:
                continue
            symbols[i], symbols[j] = z, -1
            k = after[i] = after[j]
            before[k] = i
            if (s := symbols[k]) >= 0 and (q := rank_of(z << 32 | s)) is not None:
                if q in places:
                    places[q].append(i)
                else:
                    places[q] = [i]
                    heappush(active, q)
            p = before[i]
            if p >= 0 and (s := symbols[p]) >= 0 and (q := rank_of(s << 32 | z)) is not None:
                if q in places:
                    places[q].append(p)
                else:
                    places[q] = [p]
                    heappush(active, q)
    ids = np.frombuffer(symbols, np.int32) if n else flat
    live = ids >= 0
    ends = np.concatenate([[0], np.cumsum(live)])[starts].tolist()
    ids = ids[live].tolist()
    return [ids[a:b] for a, b in zip(ends, ends[1:])]


class Halves:
    """What is known for a key. When the younger half is full it becomes the older one, of which only what is asked for
    again comes back, so that its bytes are bounded and frequent keys stay."""

    def __init__(self, entries: int = MEMO, longest: int = MEMO_LONGEST):
        self.young, self.old, self.long, self.entries, self.longest = {}, {}, [], entries, longest

    def of(self, keys: set[str], make: Callable[[list[str]], Iterable[bytes]]) -> dict[str, bytes]:
        """A table that has all of the keys until settle(); `make` gives what is not remembered."""
        young = self.young
        new = []
        for key in keys.difference(young):
            if key in self.old:
                young[key] = self.old[key]
            else:
                new.append(key)
        if new:
            young.update(zip(new, make(new)))
            self.long += [k for k in new if len(k) > self.longest]
        return young

    def settle(self) -> None:
        """Forgets what is too long or too much."""
        for key in self.long:
            del self.young[key]
        self.long = []
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young


class BlockEncoder:
    """Encodes blocks of texts: only words that are not remembered are merged, all of a block at once."""

    def __init__(self, path: str, entries: int = MEMO):
        self.vocab, self.words = vocabulary(path), word_pattern()
        # Stretches between lone spaces (where a match always begins) are remembered beside words, as most are one word:
        # a text's first one, and those that follow a space, without it.
        self.of_head, self.of_rest, self.of_word = Halves(entries), Halves(entries), Halves(entries)

    def _merged(self, words: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in merge_block([w.encode() for w in words], self.vocab)]

    def _stretches(self, stretches: list[str]) -> list[bytes]:
        """Each stretch's ids as little-endian 32-bit numbers."""
        split = list(map(self.words.findall, stretches))
        ids = self.of_word.of({w for own in split for w in own}, self._merged)
        found = [ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own]) for own in split]
        self.of_word.settle()
        return found

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        cuts = list(map(LONE.split, texts))
        heads = self.of_head.of({c[0] for c in cuts}, self._stretches)
        rests = self.of_rest.of(set().union(*(c[1:] for c in cuts)), lambda keys: self._stretches([" " + k for k in keys]))
        out = [heads[c[0]] + b"".join(map(rests.__getitem__, c[1:])) for c in cuts]
        self.of_head.settle()
        self.of_rest.settle()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if self.vocab.cut is None:
            return self._plain(texts)
        # Odd parts are added tokens.
        parts = list(map(self.vocab.cut.split, texts))
        plain = iter(self._plain([x for own in parts for x in own[::2]]))
        added = self.vocab.added
        return [b"".join([added[x].to_bytes(4, "little") if i % 2 else next(plain) for i, x in enumerate(own)]) for own in parts]


def decode(ids: bytes, vocab: Vocabulary) -> str:
    """The text of ids that are little-endian 32-bit numbers."""
    return b"".join(map(vocab.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def encoder(path: str) -> BlockEncoder:
    """A worker's own encoder, with what it remembers."""
    return BlockEncoder(path)


def coded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian 32-bit numbers, and their text, of every row."""
    return _coded(docs, path, "ids binary, decoded string", lambda ids, vocab: (ids, decode(ids, vocab)), (pa.binary(), pa.string()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def digest(ids: bytes, vocab: Vocabulary) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode(ids, vocab).encode()).hexdigest()

    return _coded(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, (pa.int64(), pa.string(), pa.string()))


def _coded(docs: DataFrame, path: str, schema: str, made: object, kinds: tuple) -> DataFrame:
    names = ["doc_id", *(x.split(" ")[0] for x in schema.split(", "))]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path)
        rows = [made(ids, own.vocab) for ids in own([t or "" for t in batch.column(1).to_pylist()])]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, f"doc_id long, {schema}")


def op12_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's ids by the tokenizer file, and their decoding."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
