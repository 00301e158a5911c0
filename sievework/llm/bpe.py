"""Byte-level BPE: encoding by folding ranked merges, decoding by concatenating binary pieces.

A text is cut by the tokenizer's pattern; each match is a word whose UTF-8 bytes start as single-byte pieces, and the
adjacent pair whose joined bytes have the lowest rank is merged until no pair has one. The rank table is a constant of the
tokenizer (its size does not depend on the corpus).

Two ways are here. `encode_native` is the fold written with Spark's higher-order functions over a literal rank table, for
distinct words. The contract query uses the Arrow way (`Encoder`): the same fold over the distinct words of each batch,
remembered between batches in a bounded table, because joining encoded distinct words back to every place of every text
writes several times the input to shuffle (README has the figures).

Texts are first cut at single spaces that have no blank on either side. The pattern always begins a match at such a
space, so the pieces can be encoded, and remembered, on their own.

Defined cases: a null or empty text has no ids, and decodes to no bytes; special tokens' strings are ordinary text;
repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import map_batches

#: The rank file; a parameter of every function that needs one.
RANKS = "byte_bpe_50k.tiktoken"
#: Entries of each half of what a worker remembers, and the code points of the longest.
MEMO, MEMO_LONGEST = 400_000, 48
#: A space without a blank on either side.
LONE = re.compile(r" (?<=\S )(?=\S)")


# Code points that Unicode made letters or numbers after version 16, where the libraries' tables end.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


@cache
def word_pattern() -> regex.Pattern:
    """public_tokenizers.PATTERN with the libraries' letters and numbers; the regex module's tables are of a later Unicode."""
    text = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]")
    for kind in ("L", "N"):
        text = text.replace(rf"?\p{{{kind}}}", rf"?[\p{{{kind}}}--[{LATER}]]")
    return regex.compile(text, regex.V1)


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of one word: its bytes, with the lowest-ranked adjacent pair merged until none is left."""
    if word in ranks:
        return [word]
    pieces = [word[i : i + 1] for i in range(len(word))]
    find, none = ranks.get, len(ranks) + 256
    at = [find(word[i : i + 2], none) for i in range(len(word) - 1)]
    while at:
        low = min(at)
        if low == none:
            break
        i = at.index(low)
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        del at[i]
        if i < len(at):
            at[i] = find(pieces[i] + pieces[i + 1], none)
        if i:
            at[i - 1] = find(pieces[i - 1] + pieces[i], none)
    return pieces


def fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """fold() for very long words: a heap instead of a scan for each merge."""
    import heapq

    n = len(word)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or not alive[j] or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [word[i : end[i]] for i in range(n) if alive[i]]


def merged_pieces(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    return fold(word, ranks) if len(word) < 200 else fold_long(word, ranks)


class Memo(dict):
    """What `make` gives for a key, remembered for short keys. When it is full it becomes the older half, of which only what
    is asked for again comes back, so that its bytes are bounded and frequent keys stay."""

    def __init__(self, make: Callable[[str], object], entries: int = MEMO, longest: int = MEMO_LONGEST):
        super().__init__()
        self.make, self.entries, self.longest, self.older = make, entries, longest, {}

    def __missing__(self, key: str) -> object:
        found = self.older.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Applies `make` to the stretches of texts between lone spaces, remembering what it gave."""

    def __init__(self, make: Callable[[str], object]):
        self.head, self.rest = Memo(make), Memo(lambda x: make(" " + x))

    def __call__(self, text: str) -> list:
        """What `make` gives for each stretch of the text, in order."""
        if not text:
            return []
        cut = LONE.split(text)
        out = list(map(self.rest.__getitem__, cut))
        out[0] = self.head[cut[0]]
        return out


def stretches(text: str) -> list[str]:
    """The text cut before each space that has no blank on either side."""
    cut = LONE.split(text)
    return [x for x in (cut[0], *(" " + x for x in cut[1:])) if x]


_ENCODERS: dict[str, Encoder] = {}


def digests(path: str) -> Encoder:
    """An encoder whose pieces are (decimal ids joined by spaces, the ids' bytes)."""
    if path not in _ENCODERS:
        ranks, words = load_ranks(path), word_pattern()
        piece_of = {i: p for p, i in ranks.items()}

        def fresh(word: str) -> tuple[str, bytes]:
            ids = [ranks[p] for p in merged_pieces(word.encode(), ranks)]
            return " ".join(map(str, ids)), b"".join([piece_of[i] for i in ids])

        of = Memo(fresh)

        def make(stretch: str) -> tuple[str, bytes]:
            pairs = [of[w] for w in words.findall(stretch)]
            return pairs[0] if len(pairs) == 1 else (" ".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs]))

        _ENCODERS[path] = Encoder(make)
    return _ENCODERS[path]


def encode(text: str, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[p] for w in word_pattern().findall(text) for p in merged_pieces(w.encode(), ranks)]


def decode(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    piece_of = {i: p for p, i in ranks.items()}
    return b"".join(piece_of[i] for i in ids)


def coded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = digests(path)
        n, ids, back = [], [], []
        for text in batch.column(1):
            pairs = encoder(text.as_py() or "")
            joined = " ".join([p[0] for p in pairs])
            n.append(joined.count(" ") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(b"".join([p[1] for p in pairs])).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def rank_table(ranks: dict[bytes, int], slots: int = 1 << 16) -> Column:
    """A literal hash table: slot -> array of (piece, rank). An array is read at a place at once; a map is searched."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(bytearray(p), r) for p, r in ranks.items()], "piece binary, rank int")
    table = rows.groupBy(F.pmod(F.xxhash64("piece"), F.lit(slots)).alias("slot")).agg(F.collect_list(F.struct("piece", "rank")).alias("held")).collect()
    held = {r.slot: r.held for r in table}
    inner = lambda found: "array(" + ",".join(f"named_struct('piece',X'{bytes(x.piece).hex()}','rank',{x.rank})" for x in found) + ")"
    empty = "cast(array() as array<struct<piece:binary,rank:int>>)"
    return F.expr("array(" + ",".join(inner(held[i]) if i in held else empty for i in range(slots)) + ")")


def encode_native(word: Column, table: Column, slots: int) -> Column:
    """array<binary>: the pieces of one word (binary), by higher-order functions alone."""
    rank_of = lambda piece: F.coalesce(F.try_element_at(F.transform(F.filter(F.get(table, F.pmod(F.xxhash64(piece), F.lit(slots)).cast("int")), lambda x: x["piece"] == piece), lambda x: x["rank"]), F.lit(1)), F.lit(1 << 30))
    start = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)))

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.slice(pieces, 2, F.size(pieces) - 1), lambda a, b: rank_of(F.concat(a, b)))
        low = F.array_min(pairs)
        at = F.array_position(pairs, low).cast("int")
        joined = F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(F.concat(F.get(pieces, at - 1), F.get(pieces, at))), F.slice(pieces, at + 2, F.greatest(F.size(pieces) - at - 1, F.lit(0))))
        return F.when((F.size(pieces) < 2) | (low == (1 << 30)), pieces).otherwise(joined)

    rounds = F.when(F.length(word) > 1, F.sequence(F.lit(2), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.when(F.length(word) > 0, F.aggregate(rounds, start, step)).otherwise(F.array().cast("array<binary>"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's ids by the ranks of the rank file, and their decoding."""
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(RANKS))
