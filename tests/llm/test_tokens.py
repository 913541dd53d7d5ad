"""op1 and op2 against the libraries."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import sentencepiece
import tiktoken
from conftest import by_id

from skylode.llm import byte_bpe, token_transducer
from skylode.llm.byte_bpe import ByteBpe, MinimalPerfectHash
from skylode.llm.token_transducer import Transducer

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
CODE = ["".join(chr(c) for c in range(s, s + 300) if not 0xD800 <= c < 0xE000) for s in range(0, 0x3000, 900)]


def odd_texts():
    r = random.Random(3)
    made = ["".join(r.choice("abcdeinorst .,É1=-_") for _ in range(r.randint(1, 500))) for _ in range(60)]
    return ["", " ", "a" * 700, "ab" * 900, "=-" * 500, " " * 900, "0123456789" * 40, "\n\n  if x:\n\t\treturn", "<0x0A> <s> <unk> ▁▁a", *CODE, *made]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_transducer_counts_as_the_library():
    machine, sp = Transducer(open(MODEL, "rb").read()), library()
    texts = odd_texts()
    assert machine.count(texts).tolist() == [len(sp.encode(t)) for t in texts]
    assert machine.count([]).tolist() == [] and machine.count(["", ""]).tolist() == [0, 0]


def test_small_chunks_and_scans_change_nothing(monkeypatch):
    """Short chunks compose, long texts carry their state; with no rounds all is walked."""
    machine, sp = Transducer(open(MODEL, "rb").read()), library()
    r = random.Random(9)
    texts = [*odd_texts(), *("".join(r.choice(a) for _ in range(900)) for a in ("ab", "abcdefghijklmnopqrstuvwxyz", "=-_", "Qqxz7"))]
    expected = [len(sp.encode(t)) for t in texts]
    for chunk, scan, rounds in ((4, 1 << 20, 12), (8, 100, 12), (8, 1 << 20, 0), (16, 33, 1)):
        monkeypatch.setattr(token_transducer, "CHUNK", chunk)
        monkeypatch.setattr(token_transducer, "SCAN", scan)
        monkeypatch.setattr(token_transducer, "ROUNDS", rounds)
        assert machine.count(texts).tolist() == expected
        assert [int(machine.count([t])[0]) for t in texts] == expected


def test_composition_is_a_scan(monkeypatch):
    """Without a cut, chunks are not walked one after another."""
    machine, sp = Transducer(open(MODEL, "rb").read()), library()
    monkeypatch.setattr(Transducer, "_one_by_one", None)
    walked = []
    whole = Transducer._walked
    monkeypatch.setattr(Transducer, "_walked", lambda self, chunk, *rest: walked.append(len(chunk)) or whole(self, chunk, *rest))
    r = random.Random(2)
    for text in ("a" * 2_000_000, "ab=" * 700_000, "".join(r.choice("abcdefghij") for _ in range(30_000))):
        walked.clear()
        began = time.time()
        assert machine.count([text])[0] == len(sp.encode(text))
        assert time.time() - began < 30
        assert len(walked) <= 3 * token_transducer.ROUNDS


def test_pairs_are_checked_as_by_merging():
    machine, r = Transducer(open(MODEL, "rb").read()), random.Random(1)
    tokens = library().encode("".join(odd_texts()) + open(__file__).read(), out_type=str)
    pieces = [x for x in {*r.sample(sorted(machine.score), 2000), *tokens} if x in machine.score and machine.encode(x) == [x]]
    for _ in range(6000):
        a, b = r.choice(pieces), r.choice(pieces)
        assert machine._check(a, b) == (machine.encode(a + b) == [a, b])


def test_transducer_starts_anew_beyond_its_bound(monkeypatch):
    monkeypatch.setattr(token_transducer, "MAX_STATES", 10)
    machine, sp = Transducer(open(MODEL, "rb").read()), library()
    monkeypatch.setattr(token_transducer, "SCAN", 50)
    for text in odd_texts()[:20]:
        assert machine.count([text])[0] == len(sp.encode(text))


def test_token_counts_of_messy_rows(messy, empty):
    sp = library()
    found = by_id(token_transducer.count_tokens(messy, MODEL))
    for r in messy.collect():
        text = r["text"] or ""
        n = len(sp.encode(text))
        assert found[r["doc_id"]][1:] == (len(text.encode()), n, n > 4096)
    assert token_transducer.count_tokens(messy, MODEL).count() == messy.count()
    assert token_transducer.count_tokens(empty, MODEL).count() == 0


def test_minimal_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    table = MinimalPerfectHash(keys)
    assert sorted(table.slot_of_key.tolist()) == list(range(5000))
    assert table.probe(keys).tolist() == table.slot_of_key.tolist()
    assert all(0 <= s < 5000 for s in table.probe([b"unknown", b""]).tolist())


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_as_the_library():
    codec, lib = ByteBpe(open(RANKS, "rb").read(), P.PATTERN), reference()
    texts = odd_texts()
    for text, ids in zip(texts, codec.encode_batch(texts)):
        assert ids.tolist() == lib.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_of_long_texts(monkeypatch):
    codec = ByteBpe(open(RANKS, "rb").read(), P.PATTERN)
    whole = [x.tolist() for x in codec.encode_batch(odd_texts())]
    monkeypatch.setattr(byte_bpe, "LONG", 0)
    monkeypatch.setattr(byte_bpe, "PIECES", 7)
    assert [codec.encode_batch([t])[0].tolist() for t in odd_texts()] == whole


def test_byte_bpe_of_messy_rows(messy, empty):
    lib = reference()
    encoded = byte_bpe.encode(messy, RANKS, P.PATTERN)
    for r in byte_bpe.decode(encoded, RANKS, P.PATTERN).collect():
        ids = np.frombuffer(r["token_ids"], "<u4")
        assert len(ids) == r["n_tokens"] and lib.decode_bytes(ids.tolist()) == r["decoded"]
    found = by_id(encoded)
    for r in messy.collect():
        expected = np.array(lib.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        assert hashlib.sha256(found[r["doc_id"]]["token_ids"]).digest() == hashlib.sha256(expected).digest()
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
