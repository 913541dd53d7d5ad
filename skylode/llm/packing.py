"""Best-fit packing of tokenized documents, certified by lower bounds.

Pieces are dealt evenly into packing groups of bounded size. Each group runs
best-fit decreasing and bounds its number of sequences from below with dual
feasible functions. Groups above their bound give the documents of their
emptiest sequences to an exchange, certified ones only their emptiest sequence
(it may be filled from elsewhere). What is exchanged is dealt anew and packed
again, round after round, as long as that saves sequences.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skylode.llm.common import SLICE_BYTES, SequenceCache, column, runs, split_long, sums_of, text_slices, word_codes, written

#: Sequences' worth of tokens in one packing group; bounds a group's memory.
GROUP_SEQUENCES = 1024
#: Packing groups that one task works through.
GROUPS_PER_TASK = 8
#: Sequences that a group above its bound gives away for each one it is above.
SHARE = 8
#: Bytes of text that are tokenized in one step.
SLICE = 6 << 20

#: A pre-tokenizer's pattern that keeps runs of letters and of marks apart.
_LETTERS_APART = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks between plain letters or digits (or the end of a word).
_MARKS = r"([a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~]+)([a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}\s]|$)"

_PIECE = "piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Token ids of texts, for tokenizers whose tokens never span ASCII white space.

    Such a text is encoded word by word, each different word once.
    """

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(source.decode())
        spec = json.loads(source)
        self.special = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        # Where the tokenizer lower-cases, ASCII capitals may go first: fewer different words.
        self.lower = '"Lowercase"' in json.dumps(spec["normalizer"])
        # Where it parts letters from marks, so may we, again for fewer different words. Marks
        # next to an apostrophe stay (it begins contractions), as do those next to other
        # characters than plain letters and digits (they may combine).
        self.parts = any(json.dumps(_LETTERS_APART)[1:-1] in json.dumps(p, ensure_ascii=True) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []))
        self.cache = SequenceCache(self._resolve, limit=1_000_000)

    def _resolve(self, words: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), 2000):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 2000], add_special_tokens=False)]
        return out

    def _prepared(self, texts: pa.Array) -> pa.Array:
        own = pc.ascii_lower(texts) if self.lower else texts
        if self.lower and self.parts:
            own = pc.replace_substring_regex(own, _MARKS, r"\1 \2 \3")
        if not self.special:
            return own
        # Texts that may hold a special token stay as they are.
        return pc.if_else(pc.match_substring(texts, self.special), texts, own)

    def encode_batch(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if len(texts) == 1 and pc.binary_length(texts)[0].as_py() > 2 * SLICE_BYTES:
            parts = [self._encode(pa.array([p], pa.string()))[0] for p in split_long(texts[0].as_py().encode())]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, counts, words = word_codes(self._prepared(texts))
        places = self.cache.codes_of(words.to_pylist())
        starts, lengths = self.cache.starts[places][codes], self.cache.lengths[places][codes]
        return self.cache.flat[runs(starts, lengths)], sums_of(lengths, counts)


@functools.lru_cache(maxsize=2)
def _tokenizer(source: bytes) -> WordTokenizer:
    return WordTokenizer(source)


def tokenize(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text.

    Columns: ``doc_id, piece`` (from 0), ``start`` (ids of the document before
    it), ``length, ids_crc32`` and, with ``keep_ids``, ``token_ids`` (binary,
    little-endian unsigned 32-bit). A document is its ids and ``end_id``; only
    longer ones are cut, and only the last piece is shorter. A null or empty
    text is the single ``end_id``. Every row of ``df`` is a document of its own,
    repeated ids and null ids too. Other columns of ``df`` are not read.
    """
    with open(tokenizer_path, "rb") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _tokenizer(source.value)
        for part in text_slices(batches, limit=SLICE):
            ids, lengths = codec.encode_batch(column(part, "text"))
            # Each document's ids and then its end.
            full = np.full(len(ids) + len(lengths), end_id, "<u4")
            ends = np.cumsum(lengths + 1)
            body = np.ones(len(full), bool)
            body[ends - 1] = False
            full[body] = ids
            pieces = -(-(lengths + 1) // capacity)
            number = runs(np.zeros(len(pieces), np.int64), pieces)
            start = number * capacity
            length = np.minimum(np.repeat(lengths + 1, pieces) - start, capacity)
            at = np.repeat(ends - lengths - 1, pieces) + start
            raw = memoryview(full.tobytes())
            own = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())]
            columns = [
                pc.take(column(part, "doc_id"), pa.array(np.repeat(np.arange(len(pieces)), pieces))),
                pa.array(number.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(x) for x in own], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([bytes(x) for x in own], pa.binary()))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {_PIECE}" + ", token_ids binary" * keep_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, its offset there, number of bins).

    Bins are kept by residual capacity; a bit set of the residuals in use finds
    the tightest bin that still fits in one step.
    """
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = used >> n
        if fits:
            residual = n + (fits & -fits).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                used ^= 1 << residual
        else:
            residual, b, bins = capacity, bins, bins + 1
        bin_of[i], offset[i] = b, capacity - residual
        rest = residual - n
        if not by_residual[rest]:
            used |= 1 << rest
        by_residual[rest].append(b)
    return bin_of, offset, bins


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 20) -> int:
    """Least number of bins by dual feasible functions, all of them in integers.

    * the identity: the sum of the lengths;
    * for each threshold t up to half the capacity: items over capacity - t
      count as full, items under t as nothing (Martello and Toth);
    * for k up to ``steps``: x stays where (k + 1) x / capacity is whole, else it
      is rounded down to a multiple of capacity / k (Fekete and Schepers).
    """
    if not len(lengths):
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    bound = -(-int((count * x).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(1, capacity // 2 + 1)
    kept = total[capacity - t] - total[t - 1]
    full = (number[-1] - number[capacity - t]) * capacity
    bound = max(bound, int((-(-(kept + full) // capacity)).max()))
    for k in range(1, steps + 1):
        # Scaled by k, so that capacity / k stays whole.
        scaled = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        bound = max(bound, -(-int((count * scaled).sum()) // (capacity * k)))
    return bound


def _pack_group(rows: pa.Table, capacity: int, first: int) -> pa.Table:
    lengths = rows.column("length").to_numpy()
    bin_of, offset, bins = best_fit_decreasing(lengths, capacity)
    gap = bins - lower_bound(lengths, capacity)
    fill = np.bincount(bin_of, weights=lengths, minlength=bins)
    given = np.zeros(bins, bool)
    given[np.argsort(fill, kind="stable")[: 1 + SHARE * gap]] = True
    given &= fill < capacity
    return rows.append_column("sequence_id", pa.array(first + bin_of)).append_column("offset", pa.array(offset)).append_column("given", pa.array(given[bin_of]))


def _pack_round(pieces: DataFrame, tokens: int, capacity: int, turn: int) -> DataFrame:
    """One round: packed rows with ``given``, true where the row goes to the exchange."""
    group_tokens = GROUP_SEQUENCES * capacity
    tasks = max(1, -(-tokens // (group_tokens * GROUPS_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers are unique by round, task and place within the task.
        first = (turn << 56) | (TaskContext.get().partitionId() << 32)
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, size
            if held:
                out = _pack_group(pa.Table.from_batches(held), capacity, first)
                first += out.num_rows
                held, size = [], 0
                yield from out.to_batches()

        for batch in batches:
            ends = np.cumsum(column(batch, "length").to_numpy())
            at = 0
            while at < batch.num_rows:
                room = group_tokens - size + (ends[at - 1] if at else 0)
                to = int(np.searchsorted(ends, room, side="right"))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                    at = to
                if at < batch.num_rows:
                    yield from packed()
        yield from packed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(tasks).mapInArrow(run, f"{schema}, sequence_id long, offset long, given boolean")


def pack(pieces: DataFrame, capacity: int = 2048, max_rounds: int = 6) -> DataFrame:
    """Places pieces in sequences of at most ``capacity`` tokens, as few as it can.

    ``pieces``: the output of ``tokenize`` (any columns besides ``length`` are
    carried along; the names sequence_id, offset and given are reserved). Adds
    ``sequence_id`` (any numbers) and ``offset`` (gapless from 0). Rows are dealt
    evenly whatever their ids, so no key is hot; equal lengths, repeated rows and
    null ids make no difference. No pieces give no rows. A length that is null,
    under 1 or over the capacity raises an error.

    ``pieces`` should be cheap to read again (a written table).
    """
    sums = pieces.agg(F.sum("length"), F.min("length"), F.max("length"), F.count(F.when(F.col("length").isNull(), 1))).first()
    if sums[0] is None and not sums[3]:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if sums[3] or sums[1] < 1 or sums[2] > capacity:
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    first = F.col("offset") == 0  # once in each sequence

    def measure(df: DataFrame) -> tuple[int, int]:
        given = df.filter("given").agg(F.count(F.when(first, 1)), F.sum("length")).first()
        return given[0], given[1] or 0

    current = written(_pack_round(pieces, int(sums[0]), capacity, 0), "packed")
    done: list[DataFrame] = []
    bins, tokens = measure(current)
    for turn in range(1, max_rounds + 1):
        # Nothing to gain where the tokens given away fill those sequences.
        if bins <= -(-tokens // capacity):
            break
        again = written(_pack_round(current.filter("given").drop("sequence_id", "offset", "given"), tokens, capacity, turn), "packed")
        if again.filter(first).count() >= bins:
            break
        done.append(current.filter(~F.col("given")))
        current = again
        bins, tokens = measure(current)
    for rest in done:
        current = current.unionByName(rest)
    return current.drop("given")
