"""op9 counts every triple: scores against plain counts, with the weights that were fitted."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skylode.llm import interp_lm, queries


def plain(rows, top, low):
    """({id: score}, held-out tokens whose triple occurs, though one of its pairs only once)."""
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t, _ in rows}
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i, _, held in rows:
        w = tokens[i]
        if not held:
            c1.update(w)
            c2.update(zip([b"", *w[:-1]], w))
            c3.update(zip([b"", *w[:-2]], w[:-1], w[1:]))
    n, v = sum(c1.values()), len(c1)
    bucket = lambda x: 0 if x <= 0 else int(math.log2(x)) + 1
    scores, rare = {}, 0
    for i, _, held in rows:
        own, total = 0 if held else 1, 0.0
        for j, w in enumerate(tokens[i]):
            u = tokens[i][j - 1] if j else b""
            t = tokens[i][j - 2] if j > 1 else b""
            wide = c2[t, u] - own if j else 0
            three = (c3[t, u, w] - own) / wide if j and wide > 0 else 0.0
            rare += bool(held and three and min(c2[t, u], c2[u, w]) < 2)
            a, b = top[bucket(wide)], low[bucket(c1[u] - own)]
            two, one = (c2[u, w] - own) / max(c1[u] - own, 1), (c1[w] - own) / (n - own)
            total += math.log10(a * three + (1 - a) * (b[0] * two + b[1] * one + b[2] * (c1[w] - own + 0.1) / (n - own + 0.1 * (v + 1))))
        scores[i] = total
    return scores, rare


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_BYTES": 50_000, "OWNED": 5_000}, {"BLOCK_BYTES": 50_000, "OWNED": 5_000, "FAN": 4}])
def test_rare_triples_of_held_out_texts_count(spark, sf_dir, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(interp_lm, name, value)
    fit, weights = interp_lm.fit_weights, []
    monkeypatch.setattr(interp_lm, "fit_weights", lambda *x: weights.append(fit(*x)) or weights[-1])
    found = {r["doc_id"]: r["score"] for r in queries.op9_interpolated_lm(spark, sf_dir).collect()}
    rows = [(i, t, zlib.crc32(str(i).encode()) % 10 == 0) for i, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected, rare = plain(rows, *weights[0])
    assert rare > 10 and found.keys() == expected.keys()
    assert all(abs(found[i] - s) <= 1e-9 * max(1, abs(s)) for i, s in expected.items())


def test_few_triples_are_sent_for_held_out_texts(spark):
    """Training texts send a triple with a rare pair only if held-out texts hold its pairs."""
    df = spark.createDataFrame([(0, True, "a b c d"), (1, True, "e f g h"), (2, False, "x b c d y")], "doc_id long, train boolean, text string").coalesce(1)
    row = interp_lm._blocks(df.select("doc_id", "train", "text"), "bigint").first().asDict()
    block = interp_lm.Block(row)
    text = [block.words[i] for i in block.tokens.tolist()]
    held = {p for p, x in zip(zip([text[i] for i in range(len(text))], text[1:]), block.learned[1:]) if not x}
    pair = interp_lm.np.array([1 if p in {(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"e", b"f"), (b"f", b"g"), (b"g", b"h")} else 0 for p in zip([b"", *text], text)])
    asked = interp_lm.np.array([p in held for p in zip([b"", *text], text)])
    assert [(text[i - 2], text[i - 1], text[i]) for i in block.places(pair, asked, 1)] == [(b"b", b"c", b"d")] * 2
    assert len(block.places(pair, asked, 2)) == 0


def test_a_held_out_copy_is_as_likely_as_its_triples(spark):
    """Each word follows its two words before it in training without fail."""
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(0, text), (1, text), (2, " ".join(f"v{i}" for i in range(50)))] + [(3, " ".join(f"v{i}" for i in range(50)))], "doc_id long, text string")
    held = F.col("doc_id") == 3
    cut, whole = ({r["doc_id"]: r["score"] for r in interp_lm.score(df, held, least=x).collect()} for x in (2, 1))
    assert whole[3] > cut[3] + 1
    assert all(abs(whole[i] - cut[i]) < 1e-9 for i in (0, 1, 2))
