"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of r + 1 bits. For each non-zero
vector v of that length a table keys fingerprints by the bits whose vector has
an odd overlap with v. The vectors of r differing bits span at most r
dimensions, so some v is orthogonal to them all: in its table the two
fingerprints share a key. Every pair within radius r thus meets in one of the
2^(r+1) - 1 tables, for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import SLICE_BYTES, bytes_of, column, dropped, hub_join, split_long, text_slices, written
from skylode.llm.components import connected_components

#: Distinct fingerprints of a bucket that are compared as they are; those of a fuller
#: bucket are keyed anew by a second covering of the bits they may differ in.
BUCKET = 4096
#: Numbers of rows that are broadcast, at most (16 MB).
MANY_ROWS = 1_000_000


def covering_masks(radius: int, within: int = (1 << 64) - 1) -> list[int]:
    """Masks of the bits ``within``: of numbers that differ in ``radius`` of these bits or
    fewer, any two agree in all bits of one of the masks."""
    size = (1 << (radius + 1)) - 1
    places = [i for i in range(64) if within >> i & 1]
    vectors = [1 + i * 7 % size for i in range(len(places))]
    return [sum(1 << p for p, m in zip(places, vectors) if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def second_masks(radius: int) -> list[list[int]]:
    """For each mask the masks of the other bits. Fingerprints that agree in both are told
    apart by the rest, some 15 of 64 bits: such a bucket holds a few ten thousand at most."""
    return [covering_masks(radius, ~m & ((1 << 64) - 1)) for m in covering_masks(radius)]


def _bit_counts(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text, how many of these have each bit in their XXH64)."""
    words, counts = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split()
        counts[i] = len(own)
        words += own
    ones = np.zeros((len(texts), 64), np.int64)
    some = np.flatnonzero(counts)
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    if not len(some):
        return shingles, ones
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first_word = (np.cumsum(counts) - counts)[some]
    own = shingles[some]
    before = np.cumsum(own) - own
    at = np.repeat(first_word - before, own) + np.arange(int(own.sum()))
    last = at + np.repeat(np.minimum(counts[some], width) - 1, own)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at].tolist(), ends[last].tolist())), np.uint64, len(at))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones[some] = np.add.reduceat(bits, before, axis=0, dtype=np.int64)
    return shingles, ones


def _long_counts(text: bytes, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """``_bit_counts`` of one long text, part by part; each part begins with the last
    words of those before it, and its first shingle is the first that ends in it."""
    total, ones, tail = np.zeros(1, np.int64), np.zeros((1, 64), np.int64), []
    for part in split_long(text):
        words = part.split()
        if not words:
            continue
        if len(tail) + len(words) < width:
            tail += words
            continue
        n, own = _bit_counts([b" ".join([*tail, *words])], width, seed)
        total, ones, tail = total + n, ones + own, (tail + words)[-(width - 1) :] if width > 1 else []
    if not total[0] and tail:
        return _bit_counts([b" ".join(tail)], width, seed)
    return total, ones


def fingerprint_batch(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: a bit is set if over half of the shingles' XXH64 have it."""
    long = len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES
    shingles, ones = _long_counts(texts[0], width, seed) if long else _bit_counts(texts, width, seed)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    """Replaces the column ``text`` by ``fp``, a signed 64-bit fingerprint."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            fp = pa.array(fingerprint_batch(bytes_of(part)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in kept), fp], names=[*kept, "fp"])

    schema = rows.select(kept).schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


def _forest(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what links within the radius connect, one less than nodes at most."""
    a, b, rest = [], [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += [int(x)] * len(found)
                b += found.tolist()
                queue += list(found)
    return a, b


def _bucket_links(radius: int):
    """Reads rows sorted by bucket (all columns but the last), yields links a, b."""

    def links(keys: list[np.ndarray], fps: np.ndarray) -> pa.RecordBatch:
        change = np.zeros(len(fps), bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
        a, b = fps[near].tolist(), fps[near + 1].tolist()
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own_a, own_b = _forest(fps[s : s + n], radius)
            a += own_a
            b += own_b
        to_signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(to_signed(a)), pa.array(to_signed(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            # The last bucket may go on in the next batch.
            open_ = np.ones(len(now[0]), bool)
            for k in now[:-1]:
                open_ &= k == k[-1]
            cut = len(open_) - int(open_[::-1].argmin()) if not open_.all() else 0
            if cut:
                yield links([k[:cut] for k in now[:-1]], now[-1][:cut].view(np.uint64))
            held = [k[cut:] for k in now]
        if held is not None:
            yield links(held[:-1], held[-1].view(np.uint64))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fp`` at ``radius`` bits or
    fewer: enough to connect whatever such pairs connect, never all pairs of a bucket."""
    mask = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    struct = lambda t, m: F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(m).alias("key"))
    keyed = distinct.select("fp", F.explode(F.array(*(struct(t, mask(m)) for t, m in enumerate(covering_masks(radius))))).alias("k")).select("k.t", "k.key", "fp")
    full = written(keyed.groupBy("t", "key").count().filter(F.col("count") > bucket).drop("count"), "full")
    n_full = full.count()
    plain = keyed
    if n_full:
        # Their number is a share of the fingerprints'; only a short list is broadcast.
        hint = F.broadcast(full) if n_full <= 10_000 else full
        plain = keyed.join(hint, ["t", "key"], "left_anti")
        again = F.get(F.array(*(F.array(*map(mask, own)) for own in second_masks(radius))), F.col("t").cast("int"))
        second = F.transform(again, lambda m, i: F.struct(i.cast("byte").alias("t2"), F.col("fp").bitwiseAND(m).alias("key2")))
        split = keyed.join(hint, ["t", "key"]).select("t", "key", "fp", F.explode(second).alias("x")).select("t", "key", "x.t2", "x.key2", "fp")
        keys = ["t", "key", "t2", "key2"]
        heavy = split.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bucket_links(radius), "a long, b long")
    light = plain.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_bucket_links(radius), "a long, b long")
    return light.unionByName(heavy) if n_full else light


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """``fp, root`` for a table with columns fp and row-wise repeats: every distinct
    fingerprint with its class."""
    distinct = written(fps.select("fp").distinct(), "distinct")
    roots = connected_components(fingerprint_links(distinct, radius))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` of every row.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the
    smallest id that links reach, so ties cannot arise. A null, empty or blank text
    has fingerprint zero and is linked like any other. Texts are read whole, long
    ones in parts. Repeated rows share fingerprint and component; null ids keep
    their row and are passed over for component_id, which is null where a component
    has no other. No rows give no rows. Other columns are not read.
    """
    rows = written(_with_fingerprint(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints")
    classes = written(_classes(rows, radius), "classes")
    # One line a fingerprint, with its rows, and one a component, with its fingerprints.
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).join(classes, "fp"), "least")
    by_root = written(least.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "roots")
    by_fp = written(hub_join(least.select("fp", "root", F.col("n").alias("rows")), by_root, "root").select("fp", "component_id", F.col("rows").alias("n")), "components")
    dropped(classes, least, by_root)
    return hub_join(rows, by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, with one row of each component:
    the smallest id, null ids last; of repeated ids any one.

    Only row numbers are shuffled. Where up to ``MANY_ROWS`` rows go, their numbers are
    broadcast; where more go, rows and numbers are joined.
    """
    rows = df.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # Written with its row numbers, as a second run might number rows otherwise.
    rows = written(_with_fingerprint(rows), "fingerprints")
    classes = _classes(rows, radius)
    choice = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row"))
    least = rows.groupBy("fp").agg(choice.alias("best"), F.count("*").alias("rows"))
    best = least.join(classes, "fp").groupBy("root").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    best = written(best.select(F.col("best.row").alias("row"), "rows"), "best")
    kept, every = best.agg(F.count("*"), F.sum("rows")).first()
    if not kept or kept == every:
        return rows.select("doc.*")
    if every - kept <= MANY_ROWS:
        gone = written(rows.select("row").join(best.select("row"), "row", "left_anti"), "gone")
        return rows.join(F.broadcast(gone), "row", "left_anti").select("doc.*")
    return rows.join(best.select("row"), "row", "left_semi").select("doc.*")
