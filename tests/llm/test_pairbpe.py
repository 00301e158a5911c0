import hashlib
import json
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from sievework.llm import pairbpe

PATH = public_tokenizers.path(pairbpe.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)


def brute(text):
    """(n_tokens, ids_sha256, decoded_sha256) by the library."""
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def texts():
    rng = random.Random(8)
    pool = [chr(c) for lo, hi in ((0, 0x250), (0x370, 0x500), (0x600, 0x700), (0x2000, 0x2100), (0x3000, 0x30FF), (0x4E00, 0x4E80), (0x1F600, 0x1F640), (0xAC00, 0xAC40)) for c in range(lo, hi)]
    kinds = [pool, list("abc  aaaeth'sllreve\n\t 12 ."), ["<|endoftext|>", " ", "x", "<|", "endoftext"], [" the", " of", "ing", " a"]]
    out = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(4000)]
    return out + ["a" * n for n in range(1, 70)] + ["x" * 50_000, "ab " * 20_000, "\x1c \x1d x", "<|endoftext|><|endoftext|>", " <|endoftext|> "]


def test_ids_and_text_as_the_library():
    own = pairbpe.BlockEncoder(PATH, entries=50)  # so that halves are swapped again and again
    rows = texts()
    for at in range(0, len(rows), 300):
        part = rows[at : at + 300]
        for text, ids, want in zip(part, own(part), LIBRARY.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
            assert pairbpe.decode(ids, own.vocab) == text


def test_letters_and_numbers_of_later_unicode_are_the_librarys():
    odd = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}]", chr(c))] + list("aé漢1²٣Ⅷ़\u0300_")
    rows = [f"{x}'s 1{x}a{x}" for x in odd]
    for text, ids, want in zip(rows, pairbpe.BlockEncoder(PATH)(rows), LIBRARY.encode_batch(rows, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_memory_is_bounded():
    halves = pairbpe.Halves(entries=10, longest=3)
    for i in range(0, 500, 5):
        keys = {str(j) for j in range(i, i + 5)} | {"long" * 3}
        known = halves.of(keys, lambda new: [k.encode() for k in new])
        assert all(known[k] == k.encode() for k in keys)
        halves.settle()
        assert len(halves.young) < 15 and len(halves.old) < 15 and "long" * 3 not in halves.young


def test_bytes_that_are_no_text_and_odd_files(tmp_path):
    vocab = pairbpe.vocabulary(PATH)
    half = int(vocab.first[0xC3]).to_bytes(4, "little")
    assert pairbpe.decode(half, vocab) == LIBRARY.decode([int(vocab.first[0xC3])], skip_special_tokens=False) == "�"
    file = json.load(open(PATH, encoding="utf-8"))
    file["model"]["merges"] = file["model"]["merges"][::-1]
    odd = tmp_path / "odd.json"
    odd.write_text(json.dumps(file))
    with pytest.raises(ValueError):
        pairbpe.Vocabulary(str(odd))


def test_rows_with_nulls_repeats_and_other_columns(spark):
    rows = [(None, None), (1, ""), (2, "Same"), (2, "Same"), (3, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pairbpe.digests(docs, PATH).where("doc_id is not null").collect())
    assert got == sorted((i, *brute(t)) for i, t in rows if i is not None)
    assert {(r.doc_id, r.decoded) for r in pairbpe.coded(docs, PATH).collect()} == {(i, t or "") for i, t in rows}
