"""op8 against brute force, and the components."""

import itertools
import random

import numpy as np
import xxhash
from conftest import by_id

from skylode.llm import simhash
from skylode.llm.components import connected_components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=3):
    """The least value that links reach, for each value."""
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(parent), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def check(df, found):
    rows = df.select("doc_id", "text").collect()
    own = {t: fingerprint(t) for _, t in rows}
    roots = classes(set(own.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            root = roots[own[t]]
            least[root] = min(i, least.get(root, i))
    got = by_id(found)
    for i, t in rows:
        assert got[i]["fingerprint"] == f"{own[t]:016x}"
        assert got[i]["component_id"] == least.get(roots[own[t]])


def test_documents_and_messy_rows(documents, messy, empty):
    check(documents, simhash.near_duplicates(documents))
    check(messy, simhash.near_duplicates(messy))
    assert simhash.near_duplicates(messy).count() == messy.count()
    assert simhash.near_duplicates(empty).count() == 0


def test_every_pair_within_the_radius_meets():
    r = random.Random(0)
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for _ in range(3000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_full_buckets_lose_no_link(spark):
    r = random.Random(2)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 300:
        x = centre
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        values.add(x)
    values |= {r.getrandbits(64) for _ in range(200)}
    signed = {v: int(np.uint64(v).view(np.int64)) for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    expected = classes(values)
    sizes = sorted(map(list(expected.values()).count, set(expected.values())))
    for bucket in (simhash.BUCKET, 16):
        links = connected_components(simhash.fingerprint_links(df, 3, bucket)).collect()
        group = {v: [] for v in expected}
        root = {r["node"]: r["root"] for r in links}
        for v, s in signed.items():
            group.setdefault(("r", root.get(s, s)), []).append(v)
        found = [sorted(m) for k, m in group.items() if isinstance(k, tuple)]
        assert sorted(map(len, found)) == sizes
        assert all(len({expected[v] for v in m}) == 1 for m in found)


def test_second_covering_meets_within_the_rest():
    r = random.Random(1)
    first, second = simhash.covering_masks(3), simhash.second_masks(3)
    for _ in range(2000):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        for m, own in zip(first, second):
            if x & m == y & m:
                assert any(x & k == y & k for k in own)
    # What agrees in both masks has few values left.
    assert max((64 - (m | k).bit_count()) for m, own in zip(first, second) for k in own) <= 16


def test_hubs_are_not_gathered(spark, monkeypatch):
    from skylode.llm import common, components

    links = [(1, i) for i in range(2, 200)] + [(500 + i, 199) for i in range(50)] + [(900, 901)]
    df = spark.createDataFrame(links, "a long, b long")
    plain = sorted(map(tuple, connected_components(df).collect()))
    for many in (100_000, 0):
        monkeypatch.setattr(common, "HUB", 20)
        monkeypatch.setattr(components, "HUB", 20)
        monkeypatch.setattr(common, "MANY_HUBS", many)
        assert sorted(map(tuple, connected_components(df).collect())) == plain
        docs = spark.createDataFrame([(i, "same words in all of them") for i in range(60)] + [(100 + i, f"other {i} words {i * i} here {i}") for i in range(30)], "doc_id long, text string")
        check(docs, simhash.near_duplicates(docs))


def test_long_texts_in_parts(monkeypatch):
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "bb", "ccc", "d\n"]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 5, 40, 300)]
    whole = [simhash.fingerprint_batch([t])[0] for t in texts]
    from skylode.llm import common

    monkeypatch.setattr(simhash, "SLICE_BYTES", 0)
    monkeypatch.setattr(simhash, "split_long", lambda t: common.split_long(t, 5))
    assert [simhash.fingerprint_batch([t])[0] for t in texts] == whole == [fingerprint(t.decode()) for t in texts]


def test_many_dropped_rows_are_joined(documents, monkeypatch):
    few = sorted(r["doc_id"] for r in simhash.keep_one(documents).collect())
    monkeypatch.setattr(simhash, "MANY_ROWS", 0)
    assert sorted(r["doc_id"] for r in simhash.keep_one(documents).collect()) == few


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(90)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    found = {x["node"]: x["root"] for x in connected_components(df).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked if find(x) != x}
    assert connected_components(df.filter("false")).count() == 0


def test_keep_one(messy, documents, empty):
    for df in (messy, documents):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
        ids = [r["doc_id"] for r in kept.collect()]
        known = [i for i in ids if i is not None]
        assert sorted(known) == sorted({c for c in component.values() if c is not None})
        assert len(ids) - len(known) == len({i for i, c in component.items() if c is None})
    assert simhash.keep_one(empty).count() == 0
