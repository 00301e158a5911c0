import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sievework.llm import bpe, packing

PATH = public_tokenizers.path(bpe.RANKS)
RANKS = bpe.load_ranks(PATH)
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = [" ", "  ", "\n", " \n", "a", "B'", "'s", "é", "1", "漢", "!!", "\t", "x", "😀", "\x1c", "\u200b", "the", " of", "ing"]


def texts(n=600):
    rng = random.Random(6)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "   ", "a" * 4000, "<|endoftext|> x", "ab " * 3000]


def test_ids_and_bytes_as_the_library():
    encoder = bpe.digests(PATH)
    for text in texts():
        pairs = encoder(text)
        assert " ".join(p[0] for p in pairs) == " ".join(map(str, OWN.encode_ordinary(text)))
        assert b"".join(p[1] for p in pairs) == text.encode()
        assert bpe.decode(bpe.encode(text, RANKS), RANKS) == text.encode()


def test_both_folds_agree():
    for word in ["abracadabra", "é" * 30, "mississippi" * 5, "x", ""]:
        assert bpe.fold(word.encode(), RANKS) == bpe.fold_long(word.encode(), RANKS) or word == ""


def test_query_edges(spark):
    rows = [(1, None), (2, ""), (3, "hello  world"), (3, "hello  world"), (None, "é")]
    got = bpe.coded(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_tokens"), PATH).collect()
    assert sorted((r.n_tokens for r in got)) == sorted(len(OWN.encode_ordinary(t or "")) for _, t in rows)
    assert bpe.coded(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_native_fold_by_higher_order_functions(spark):
    small = {p: r for p, r in RANKS.items() if r < 600}
    table = bpe.rank_table(small, 1024)
    words = ["hello", "the", "x", "there and then", "ininin"]
    rows = spark.createDataFrame([(bytearray(w.encode()),) for w in words], "word binary")
    got = [[bytes(p) for p in r[0]] for r in rows.select(bpe.encode_native(rows.word, table, 1024)).collect()]
    assert got == [bpe.merged_pieces(w.encode(), small) for w in words]


def test_one_vocabulary_in_both_files():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for text in texts(300):
        assert library.encode(text, add_special_tokens=False).ids == OWN.encode_ordinary(text)


def spread(seed, size):
    rng = random.Random(seed)
    return [
        Counter(min(size, max(1, int(rng.expovariate(4 / size)))) for _ in range(rng.randint(1, 900))),
        Counter(rng.randint(size // 7, size * 6 // 10) for _ in range(2000)),
        Counter({1: 5 * size + 3, size: 4, size - 1: 2, size // 2 + 1: 9}),
    ]


@pytest.mark.parametrize("size,case", [(64, 0), (64, 2), (1024, 1)])
def test_sweeps_place_each_piece_once_and_as_tightly_as_best_fit(spark, size, case):
    for counts in spread(size, size)[case : case + 1]:
        held, seen = {}, set()
        for length, rank, many, first, offset in packing.plan_of(spark, counts, size).collect():
            for k in range(many):
                assert (length, rank + k) not in seen
                seen.add((length, rank + k))
                held.setdefault(first + k, []).append((offset, length))
        assert seen == {(n, r) for n, many in counts.items() for r in range(many)}
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= size
        gaps = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [g for g in gaps if g >= length]
                if fit:
                    gaps.remove(min(fit))
                    gaps.append(min(fit) - length)
                else:
                    gaps.append(size - length)
        assert len(held) <= 1.005 * len(gaps) + 1


def test_no_pieces_no_plan(spark):
    assert packing.plan_of(spark, {}).collect() == []


def test_packed_documents(spark):
    rows = [(1, None), (2, ""), (3, "word " * 2000), (4, "one two"), (4, "one two"), (None, "three"), (5, "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "3 as length", "4 as deal")
    got = packing.pack_documents(docs, size=128).collect()
    for doc, text in {(d, t) for d, t in rows if d != 4}:
        ids = np.array(OWN.encode_ordinary(text or "") + [2], "<u4")
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.start for r in own] == [a for a, _ in packing.cut(len(ids), 128)] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert packing.pack_documents(docs.limit(0), size=128).collect() == []


def test_packed_ids_as_the_library_by_default(spark):
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    special = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|>y", "é<|endoftext", "word <|endoftext|> " * 90]
    assert library.encode(special[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = list(enumerate(texts(40) + special))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, size=64).collect()
    for doc, text in rows:
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids), 64)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
