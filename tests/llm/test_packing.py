"""op10: tokens as the library gives them, valid sequences, bounds."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from skylode.llm import packing

WORDS = P.path("word_bpe_49k.json")


def pieces_of(df, size):
    lib = Tokenizer.from_file(WORDS)
    out = Counter()
    for i, text in df.select("doc_id", "text").collect():
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            out[i, n, at, len(own), zlib.crc32(own.tobytes())] += 1
    return out


def check(packed, df, size):
    rows = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces_of(df, size)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        at = 0
        for offset, length in own:
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_messy_rows(messy, empty):
    for size in (2048, 100):
        check(packing.pack(packing.tokenize(messy, WORDS, size), size), messy, size)
    assert packing.pack(packing.tokenize(empty, WORDS)).count() == 0


def test_documents_reach_the_bound(documents):
    n = check(packing.pack(packing.tokenize(documents, WORDS)), documents, 2048)
    tokens = sum(k[3] * c for k, c in pieces_of(documents, 2048).items())
    assert n <= -(-tokens // 2048) + 1


def test_exchange_between_groups(documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_SEQUENCES", 5)
    monkeypatch.setattr(packing, "GROUPS_PER_TASK", 2)
    pieces = packing.tokenize(documents, WORDS).cache()
    n = check(packing.pack(pieces), documents, 2048)
    alone = packing.pack(pieces, max_rounds=0)
    assert n <= alone.select("sequence_id").distinct().count()


def test_odd_texts_tokenize_as_the_library():
    lib = Tokenizer.from_file(WORDS)
    codec = packing.WordTokenizer(open(WORDS, "rb").read())
    texts = ["", "  ", "a\x1cb \x1d c", "x y  z", "é ‍ ́ a", "ΑΣ ΟΔΟΣ Σ.", "A<|EndOfText|>b", "foo<|endoftext|>Bar <|startoftext|>", "'S 's I'LL", "ﬁ Å Å"]
    texts += ["".join(chr(c) for c in range(s, s + 300) if not 0xD800 <= c < 0xE000) for s in range(0, 0x3000, 700)]
    ids, lengths = codec.encode_batch([t.encode() for t in texts])
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_long_texts_in_parts(monkeypatch):
    from skylode.llm import common

    lib, codec = Tokenizer.from_file(WORDS), packing.WordTokenizer(open(WORDS, "rb").read())
    monkeypatch.setattr(packing, "SLICE_BYTES", 0)
    monkeypatch.setattr(packing, "split_long", lambda t: common.split_long(t, 7))
    for text in ("don't, stop. it's\n\né.\tend", " ", "word" * 30, "A.B<|endoftext|> c,d "):
        ids, lengths = codec.encode_batch([text.encode()])
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and lengths.tolist() == [len(ids)]


def test_marks_and_letters_tokenize_as_the_library():
    lib, codec = Tokenizer.from_file(WORDS), packing.WordTokenizer(open(WORDS, "rb").read())
    r = random.Random(1)
    chars = "ab'sS é.,!\"()tT09İŉ\u0338\u0301<>=;  \t\n\x0b\x1cßÿñll've-_#`{}~^|ＡσΣ"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 50))) for _ in range(4000)]
    ids, lengths = codec.encode_batch([t.encode() for t in texts])
    for text, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bounds_hold():
    r = random.Random(0)
    for _ in range(400):
        lengths = np.array([r.randint(1, 30) for _ in range(r.randint(1, 14))])
        bin_of, offset, n = packing.best_fit_decreasing(lengths, 30)
        assert np.bincount(bin_of, weights=lengths).max() <= 30
        assert packing.lower_bound(lengths, 30) <= n <= len(lengths)
    assert packing.lower_bound(np.array([16] * 5), 30) == 5
    assert packing.lower_bound(np.array([], np.int64), 30) == 0


def test_wrong_lengths_raise(spark):
    for value in ("0", "2049", "NULL"):
        with pytest.raises(ValueError):
            packing.pack(spark.sql(f"SELECT 1L AS doc_id, CAST({value} AS BIGINT) AS length"))
