"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself a token resolves with one probe and one comparison. Tier two merges the
bytes of any other pre-token with a heap of candidate pairs over a linked list.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import SequenceCache, column, sums_of, text_slices, texts_of

#: Characters beyond which a text's pieces are not listed as a whole, and pieces of one step.
LONG, PIECES = 4 << 20, 200_000

_STEP, _MULTIPLY, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


class MinimalPerfectHash:
    """Maps n distinct keys to the slots 0..n-1, one each (hash and displace).

    Keys fall into buckets; each bucket of two or more gets the smallest seed
    that sends its keys to free slots, the largest buckets first. A bucket of
    one names its slot outright. A probe reads one bucket entry and one slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.size = n = len(keys)
        self.buckets = n // per_bucket + 1
        hashes = self._hash(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.seeds = np.zeros(self.buckets, np.int64)
        slots = np.empty(n, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        free_slot = bytearray(b"\1") * n
        for b in by_size[: int((sizes > 1).sum())].tolist():
            members = order[starts[b] : starts[b] + sizes[b]]
            own = hashes[members].tolist()
            seed = 0
            while True:
                step = seed * _STEP & _ALL
                tried = {((h ^ step) * _MULTIPLY & _ALL) >> 29 for h in own}
                tried = [t % n for t in tried]
                if all(free_slot[t] for t in tried) and len(set(tried)) == len(own):
                    break
                seed += 1
            self.seeds[b] = seed
            slots[members] = self._slot(hashes[members], np.uint64(seed))
            for t in tried:
                free_slot[t] = 0
        alone = by_size[int((sizes > 1).sum()) : int((sizes > 0).sum())]
        free = np.flatnonzero(np.frombuffer(free_slot, np.uint8))
        self.seeds[alone] = -1 - free
        slots[order[starts[alone]]] = free
        self.slot_of_key = slots

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slot(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (seeds * np.uint64(_STEP))) * np.uint64(_MULTIPLY)
        return ((mixed >> np.uint64(29)) % np.uint64(self.size)).astype(np.int64)

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The only slot where each key can be. The caller compares the key there."""
        hashes = self._hash(keys)
        seeds = self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(seeds < 0, -1 - seeds, self._slot(hashes, np.maximum(seeds, 0).astype(np.uint64)))


class ByteBpe:
    """Encoder and decoder for a rank file (a base64 token and its rank a line)."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        tokens = list(self.ranks)
        self.hash = MinimalPerfectHash(tokens)
        self.slots: list[tuple[bytes, int]] = [(b"", 0)] * len(tokens)
        for token, slot in zip(tokens, self.hash.slot_of_key.tolist()):
            self.slots[slot] = (token, self.ranks[token])
        self.bytes_of_id = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        # What two adjacent tokens merge into: every split of a token in two tokens.
        self.shift = max(self.ranks.values()).bit_length()
        self.pairs = {
            (left << self.shift) | right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        }
        self.cache = SequenceCache(self._resolve)

    def _resolve(self, pieces: list[str]) -> list[list[int]]:
        raw = [p.encode() for p in pieces]
        out = []
        for key, slot in zip(raw, self.hash.probe(raw).tolist()):
            token, rank = self.slots[slot]
            out.append([rank] if token == key else self.merge(key))
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Merges pairs by rank, leftmost first, until none is left.

        A heap entry is (rank, position) in one integer. ``best`` holds the rank
        of the pair that now begins at a position (0: none, as the first ranks
        are single bytes); an entry that differs from it is stale.
        """
        byte_ids, pairs, shift = self.byte_ids, self.pairs.get, self.shift
        push, pop = heapq.heappush, heapq.heappop
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        best = [pairs((a << shift) | b, 0) for a, b in zip(ids, ids[1:])]
        heap = [(rank << bits) | i for i, rank in enumerate(best) if rank]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best.append(0)
        while heap:
            x = pop(heap)
            i = x & mask
            rank = x >> bits
            if best[i] != rank:
                continue
            j = after[i]
            k = after[j]
            ids[i], ids[j], best[j], after[i] = rank, -1, 0, k
            new = 0
            if k < n:
                before[k] = i
                new = pairs((rank << shift) | ids[k], 0)
                if new:
                    push(heap, (new << bits) | i)
            best[i] = new
            h = before[i]
            if h >= 0:
                new = best[h] = pairs((ids[h] << shift) | rank, 0)
                if new:
                    push(heap, (new << bits) | h)
        return [x for x in ids if x >= 0]

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one long text, some pieces at a time."""
        found, parts = (m.group() for m in self.pattern.finditer(text)), []
        while pieces := list(itertools.islice(found, PIECES)):
            parts.append(self.cache.gather(pieces)[0])
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > LONG:
            return [self.encode_long(texts[0])]
        pieces, counts = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.split(text)
            counts[i] = len(found)
            pieces += found
        ids, lengths = self.cache.gather(pieces)
        ends = np.cumsum(sums_of(lengths, counts))
        return np.split(ids, ends[:-1]) if len(ends) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of_id.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def _codec(ranks_file: bytes, pattern: str) -> ByteBpe:
    """One per Python worker: building takes a second."""
    return ByteBpe(ranks_file, pattern)


def _vocabulary(df: DataFrame, ranks_path: str):
    """The rank file as a broadcast (under 1 MB): executors need no such file."""
    with open(ranks_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: ``doc_id``, ``n_tokens``, ``token_ids``.

    ``token_ids`` is binary: little-endian unsigned 32-bit ids. A null or empty
    text has no ids. Long texts are encoded whole, some pieces at a time. Rows are
    independent: repeated rows give repeated results, null ids are passed on, no rows
    give none, other columns of ``df`` (whatever their names) are not read. No special
    token is recognised.
    """
    vocabulary = _vocabulary(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for part in text_slices(batches):
            ids = codec.encode_batch(texts_of(part))
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "token_ids"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids binary")


def decode(df: DataFrame, ranks_path: str, pattern: str = "") -> DataFrame:
    """Adds ``decoded`` (binary) to the output of ``encode``; null ids decode to null."""
    vocabulary = _vocabulary(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for part in text_slices(batches, "token_ids"):
            decoded = [None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in column(part, "token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, "decoded"])

    rows = df.select("doc_id", "n_tokens", "token_ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids binary, decoded binary")
