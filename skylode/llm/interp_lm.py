"""Language-model scores by deleted interpolation of n-gram estimates.

P(w | t u) = l3 c(t u w) / c(t u) + (1 - l3) (l2 c(u w) / c(u) + l1 c(w) / N + l0 base(w)),
with l3 of the bucket of the frequency c(t u) and l2, l1, l0 of that of c(u), learned
by expectation-maximisation on deleted counts: every training token is held out in
turn, its own occurrence taken off all counts. Training texts are scored with such
counts too: a text that the corpus holds once does not vouch for itself, one that
it holds twice does. Pairs and triples are counted within texts; a text's first token
has no triple, as its pair with the end before it says the same.

All triples count, but few are sent. One with a pair that training holds once occurs once
itself, so a training text that holds it learns nothing of it: its deleted count is 0.
It matters to held-out texts alone, and training texts send it only if both its pairs
occur in these too. ``least`` = 2 leaves such triples uncounted, as toolkits' cutoffs do.

Counting and looking up both run on blocks of documents. A block sends each of
its different n-grams (a hash and its count) once to the n-gram's owner, a hash
range; the owner adds up and answers with the totals alone, in the order asked.
So the corpus' counts are never in one place, and a frequent n-gram costs no
more than one entry a block. Where there are many owners, blocks send to as many
coarse ranges as the root of that, where the requests of many blocks are merged
and dealt on to owners: a block makes some hundred records, not one an owner.

Words are told apart by 96 bits of hash, pairs and triples by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import column, crc32_mod, dropped, sums_of, text_slices, word_codes, written

#: Text of one block, and n-grams that one owner group holds, about.
BLOCK_BYTES, OWNED = 4 << 20, 2_000_000
#: Ranges that a block sends to; with more owners the exchange has two steps.
FAN = 256
#: Context-frequency buckets: none, then by powers of two.
BUCKETS = 48
#: Steps of a factor of two to which deleted estimates are rounded for the fit.
FINENESS = 4
_NONE = -1024

_BLOCK = "block long, ids array<{kind}>, train array<boolean>, lengths array<int>, tokens binary"
_ASKED = "asker long, owner int, keys binary, checks binary, counts binary"


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        left = left * np.uint64(0x9E3779B97F4A7C15)
        x = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Block:
    """Token numbers of some documents, and the n-gram keys they need."""

    def __init__(self, row: dict):
        self.tokens = unsqueeze(row["tokens"]).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.train = np.array(row["train"], bool)
        if "words" in row:
            self.words = zstandard.decompress(row["words"]).split(b"\n")
            # The low and high parts of 128-bit digests.
            raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), ">u8").reshape(-1, 2)
            self.hashes, self.checks = raw[:, 1].astype("<u8"), (raw[:, 0] & np.uint64(0xFFFFFFFF)).astype("<u4")
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        # The token before; the end stands before the first.
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = self.tokens[self.ends - 1]
        self.learned = np.repeat(self.train, self.lengths)
        if "words" in row and "single" in row:
            # Only the words of triples that are sent are kept.
            used = np.frombuffer(zstandard.decompress(row["used"]), bool)
            held, self.hashes = self.hashes, np.zeros(len(used), np.uint64)
            self.hashes[used] = held[: int(used.sum())]

    def used(self, at: np.ndarray) -> np.ndarray:
        """Whether a word is in the triples of the tokens ``at``."""
        out = np.zeros(int(self.tokens.max(initial=-1)) + 1, bool)
        for words in (self.before[at - 1], self.before[at], self.tokens[at]):
            out[words] = True
        return out

    def pair_keys(self) -> np.ndarray:
        return _mixed(self.hashes[self.before], self.hashes[self.tokens])

    def places(self, pair: np.ndarray, asked: np.ndarray, least: int) -> np.ndarray:
        """The tokens whose triple is sent, by their pairs' training counts and whether
        held-out texts hold these."""
        some = np.zeros(len(self.tokens), bool)
        low = np.minimum(pair[1:], pair[:-1])
        some[1:] = (low >= max(least, 1)) & ((low >= 2) | ~self.learned[1:] | (asked[1:] & asked[:-1]))
        some[self.starts] = False
        return np.flatnonzero(some)

    def triples(self, pair: np.ndarray, asked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of tokens whose triple is sent, the triples' keys)."""
        at = self.places(pair, asked, least)
        keys = _mixed(_mixed(self.hashes[self.before[at - 1]], self.hashes[self.before[at]]) ^ np.uint64(0x5851F42D4C957F2D), self.hashes[self.tokens[at]])
        return at, keys


def _blocks(rows: DataFrame, kind: str) -> DataFrame:
    """Blocks of the table ``doc_id, train, text``."""

    def pack(ids: list[pa.Array], train: list[np.ndarray], texts: list[pa.Array], number: int) -> pa.RecordBatch:
        parts = pa.chunked_array([pc.ascii_lower(x.cast(pa.string())) for x in texts]).combine_chunks()
        codes, counts, words = word_codes(parts)
        # Each text's tokens and its end, the word of no letters.
        lengths = counts + 1
        tokens = np.full(int(lengths.sum()), len(words), np.int64)
        body = np.ones(len(tokens), bool)
        body[np.cumsum(lengths) - 1] = False
        tokens[body] = codes
        # Frequent tokens get small numbers, which pack better.
        order = np.argsort(-np.bincount(tokens, minlength=len(words) + 1), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        every = [*words.cast(pa.binary()).to_pylist(), b""]
        kept = b"\n".join(map(every.__getitem__, order.tolist()))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
        columns = [pa.array([number]), one(pa.concat_arrays(ids), None), one(np.concatenate(train), pa.bool_()), one(lengths, pa.int32()), pa.array([squeeze(rank[tokens])])]
        columns.append(pa.array([zstandard.compress(kept, 3)]))
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "train", "lengths", "tokens", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, train, texts, size = [], [], [], 0
        for part in text_slices(batches):
            ids.append(column(part, "doc_id"))
            train.append(column(part, "train").to_numpy(zero_copy_only=False))
            texts.append(column(part, "text"))
            size += pc.sum(pc.binary_length(texts[-1])).as_py() or 0
            if size >= BLOCK_BYTES:
                yield pack(ids, train, texts, number)
                ids, train, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield pack(ids, train, texts, number)

    return rows.mapInArrow(run, _BLOCK.format(kind=kind) + ", words binary")


# The exchange. A request holds sorted keys, their checks (or none) and counts in training,
# doubled, with one added if a held-out text holds the key; answers add up in the same
# form. "owner" numbers the ranges of singles, then those of pairs.


def _dealt(asker: int, owner0: int, ranges: int, skip: int, keys: np.ndarray, checks: np.ndarray | None, counts: np.ndarray) -> list[tuple]:
    """Requests by the bits of the key after the first ``skip``."""
    bits = ranges.bit_length() - 1
    own = (keys << np.uint64(skip) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(own, np.arange(ranges + 1))
    out = []
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[g], cuts[g + 1])
        out.append((asker, owner0 + g, squeeze(np.diff(keys[at], prepend=np.uint64(0))), b"" if checks is None else checks[at].astype("<u4").tobytes(), squeeze(counts[at])))
    return out


def _requests_batch(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*out)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["asker", "owner", "keys", "checks", "counts"])


def _ask_words_and_pairs(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.drop_columns(["ids"]).to_pylist():
                block = Block(row)
                order = np.lexsort((block.checks, block.hashes))
                single = 2 * np.bincount(block.tokens[block.learned], minlength=len(order))[order]
                pairs, inverse = np.unique(block.pair_keys(), return_inverse=True)
                counts = 2 * np.bincount(inverse[block.learned], minlength=len(pairs))
                counts[inverse[~block.learned]] |= 1
                yield _requests_batch(_dealt(row["block"], 0, ranges, 0, block.hashes[order], block.checks[order], single) + _dealt(row["block"], ranges, ranges, 0, pairs, None, counts))

    return run


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(training counts of the tokens' pairs, whether held-out texts hold them)."""
    pair = unsqueeze(row["pair"]).astype(np.int64)
    return pair >> 1, (pair & 1).astype(bool)


def _ask_triples(ranges: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.drop_columns(["ids"]).to_pylist():
                block = Block(row)
                at, keys = block.triples(*_pairs(row), least)
                distinct, inverse = np.unique(keys, return_inverse=True)
                counts = 2 * np.bincount(inverse[block.learned[at]], minlength=len(distinct))
                yield _requests_batch(_dealt(row["block"], 0, ranges, 0, distinct, None, counts))

    return run


def _merged(asked: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, list[int]]:
    """(different keys, their checks, total counts, place of each key asked, keys of each request)."""
    parts = [np.cumsum(unsqueeze(x.as_py()), dtype=np.uint64) for x in asked["keys"]]
    counts = np.concatenate([unsqueeze(x.as_py()) for x in asked["counts"]]).astype(np.int64)
    keys = np.concatenate(parts)
    checks = np.frombuffer(b"".join(x.as_py() for x in asked["checks"]), "<u4")
    if len(checks):
        order = np.lexsort((checks, keys))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(fresh) - 1
        distinct, checks = keys[order][fresh], checks[order][fresh]
    else:
        distinct, place = np.unique(keys, return_inverse=True)
        checks = None
    # Whole numbers of doubles are exact up to 2^53.
    totals = 2 * np.bincount(place, weights=counts >> 1, minlength=len(distinct)).astype(np.int64)
    totals[place[(counts & 1).astype(bool)]] |= 1
    return distinct, checks, totals, place, [len(p) for p in parts]


def _answered(asked: pa.Table, totals: np.ndarray, place: np.ndarray, sizes: list[int], types: int) -> pa.Table:
    parts = np.split(totals[place], np.cumsum(sizes)[:-1])
    return pa.table({"asker": asked["asker"], "owner": asked["owner"], "totals": pa.array([squeeze(p) for p in parts], pa.binary()), "types": pa.array([types] + [0] * (len(parts) - 1), pa.int64())})


def _answer(asked: pa.Table) -> pa.Table:
    """One owner's totals for each request; ``types``: kinds of words learned here."""
    _, checks, totals, place, sizes = _merged(asked)
    return _answered(asked, totals, place, sizes, int((totals > 1).sum()) if checks is not None else 0)


_ANSWERS = "asker long, owner int, totals binary, types long"


def _ranges(groups: int) -> tuple[int, int]:
    """(ranges that a block sends to, owners of each of these), powers of two."""
    if groups <= FAN:
        return groups, 1
    bits = groups.bit_length() - 1
    coarse = max(FAN, 1 << -(-bits // 2))
    return coarse, groups // coarse


def exchange(asked: DataFrame, ranges: int, fine: int, blocks: int) -> DataFrame:
    """The answers to requests: ``asker, owner, totals, types``. With several owners to a
    range, requests of blocks meet by range first, some blocks at a time."""
    if fine == 1:
        return written(asked.groupBy("owner").applyInArrow(_answer, _ANSWERS), "lm-answers")
    skip = ranges.bit_length() - 1
    some = F.pmod(F.xxhash64("asker"), F.lit(max(1, blocks // fine))).cast("long")
    first = written(asked.withColumn("some", some), "lm-requests")

    def pass_on(own: pa.Table) -> pa.Table:
        keys, checks, totals, _, _ = _merged(own)
        owner = own["owner"][0].as_py()
        return pa.Table.from_batches([_requests_batch(_dealt(own["some"][0].as_py(), owner * fine, fine, skip, keys, checks, totals))])

    second = first.groupBy("some", "owner").applyInArrow(pass_on, _ASKED)
    totals = written(second.groupBy("owner").applyInArrow(_answer, _ANSWERS), "lm-answers")

    def pass_back(own: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, _, place, sizes = _merged(own)
        found = np.concatenate([unsqueeze(x.as_py()) for x in answers.sort_by("owner")["totals"]])
        return _answered(own, found.astype(np.int64), place, sizes, sum(answers["types"].to_pylist()))

    back = totals.select(F.col("asker").alias("some"), F.floor(F.col("owner") / fine).cast("int").alias("range"), "owner", "totals", "types")
    out = written(first.groupBy("some", "owner").cogroup(back.groupBy("some", "range")).applyInArrow(pass_back, _ANSWERS), "lm-answers")
    dropped(first, totals)
    return out


def _totals(answers: pa.Table) -> np.ndarray:
    found = [unsqueeze(x.as_py()) for x in answers.sort_by("owner")["totals"]]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _join(least: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """A block with the totals of its words (single) and of each token's pair."""
        own = Block(block.drop_columns(["ids"]).to_pylist()[0])
        totals = _totals(answers)
        order = np.lexsort((own.checks, own.hashes))
        single = np.empty(len(order), np.uint64)
        single[order] = totals[: len(order)] >> np.uint64(1)
        _, inverse = np.unique(own.pair_keys(), return_inverse=True)
        row = {"pair": squeeze(totals[len(order) :][inverse])}
        used = own.used(own.places(*_pairs(row), least))
        words = b"\n".join(map(own.words.__getitem__, np.flatnonzero(used).tolist()))
        kept = block.drop_columns(["words"])
        for name, value in {"words": zstandard.compress(words, 3), "single": squeeze(single), **row, "used": zstandard.compress(used.tobytes(), 1)}.items():
            kept = kept.append_column(name, pa.array([value], pa.binary()))
        return kept

    return run


def _join_triples(least: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """A block with the training counts of its pairs and triples. A triple that isn't
        sent is 0: it isn't in training, or once, in this very text, which deletes it."""
        row = block.drop_columns(["ids"]).to_pylist()[0]
        own = Block(row)
        pair, asked = _pairs(row)
        at, keys = own.triples(pair, asked, least)
        triple = np.zeros(len(own.tokens), np.uint64)
        if len(at):
            _, inverse = np.unique(keys, return_inverse=True)
            triple[at] = _totals(answers)[inverse] >> np.uint64(1)
        kept = block.drop_columns(["words", "used", "pair"])
        return kept.append_column("pair", pa.array([squeeze(pair)])).append_column("triple", pa.array([squeeze(triple)]))

    return run


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _base(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return (c + 0.1) / (n + 0.1 * (v + 1))


class Estimates:
    """Each token's estimates of orders 3 to 0 and the buckets of their contexts, the
    token's own occurrence taken off where it was learned from."""

    def __init__(self, row: dict, n: int, v: int):
        self.block = block = Block(row)
        single, pair, triple = (unsqueeze(row[k]).astype(np.int64) for k in ("single", "pair", "triple"))
        self.word = single[block.tokens]
        own = block.learned.astype(np.int64)
        # The pair before is the triple's context; texts begin without one.
        wide = np.zeros_like(pair)
        wide[1:] = pair[:-1]
        wide[block.starts] = 0
        wide = np.maximum(wide - own, 0)
        narrow = single[block.before] - own
        rest = n - own
        self.base = _base(self.word - own, rest, v)
        self.three = np.maximum(triple - own, 0) / np.maximum(wide, 1)
        self.two = (pair - own) / np.maximum(narrow, 1)
        self.one = (self.word - own) / np.maximum(rest, 1)
        self.wide, self.narrow = bucket_of(wide), bucket_of(narrow)


def _deleted(n: int, v: int):
    """Rounded deleted estimates of the training tokens, counted: cells for the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.drop_columns(["ids"]).to_pylist():
                e = Estimates(row, n, v)
                at = e.block.learned
                ratio = lambda p: np.where(p > 0, np.rint(FINENESS * np.log2(np.maximum(p, 1e-300) / e.base[at])), _NONE).astype(np.int64) - _NONE  # noqa: B023, E731
                cell = e.wide[at] << 6 | e.narrow[at]
                for p in (e.three, e.two, e.one):
                    cell = cell << 12 | np.minimum(ratio(p[at]), 4095)
                cells, number = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(number.astype(np.int64))], names=["cell", "n"])

    return run


def fit_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weight of the triple by bucket, BUCKETS x 3 weights of pair, single, base) by
    expectation-maximisation."""
    ratios = np.stack([(cells >> 12 * i) & 4095 for i in (2, 1, 0)], axis=1) + _NONE
    wide, narrow = cells >> 42, (cells >> 36) & 63
    p = np.concatenate((np.where(ratios == _NONE, 0.0, 2.0 ** (ratios / FINENESS)), np.ones((len(cells), 1))), axis=1)
    top, weights = np.full(BUCKETS, 0.5), np.full((BUCKETS, 3), 1 / 3)
    top[0] = 0
    seen = np.bincount(wide, weights=counts, minlength=BUCKETS)
    for _ in range(rounds):
        share = np.concatenate((top[wide, None] * p[:, :1], (1 - top[wide])[:, None] * weights[narrow] * p[:, 1:]), axis=1)
        share *= (counts / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(narrow, weights=share[:, i], minlength=BUCKETS) for i in (1, 2, 3)], axis=1)
        # A pinch of each keeps every weight positive and settles empty buckets.
        weights = (total + 0.01) / (total.sum(axis=1, keepdims=True) + 0.03)
        top = (np.bincount(wide, weights=share[:, 0], minlength=BUCKETS) + 0.01) / (seen + 0.02)
        top[0] = 0
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return top, weights


def score(df: DataFrame, is_held_out: Column, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the ASCII-lower-cased words of the whole text and one end; a null or
    empty text is just the end. Rows with ``is_held_out`` are not learned from. n_known
    counts tokens seen in training; base_score is the additively smoothed unigram
    log10 probability, score the interpolated model's (see above for training texts). A
    triple is counted where training holds both its pairs ``least`` times; with 1, every
    triple is.
    Every row is a document: repeated rows and ids count each, null ids are passed on.
    A long text is a block of its own. No rows give no rows; without training rows all
    rests on the base. Other columns are not read.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), (~F.coalesce(is_held_out, F.lit(False))).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = written(_blocks(rows, kind), "lm-blocks")
    sums = blocks.select(F.explode(F.arrays_zip("train", "lengths")).alias("x")).agg(F.sum(F.when(F.col("x.train"), F.col("x.lengths"))), F.sum("x.lengths")).first()
    n, every = sums[0] or 0, sums[1] or 0
    count = blocks.count()
    ranges, fine = _ranges(1 << max(0, math.ceil(math.log2(max(1, every / OWNED)))))
    answers = exchange(blocks.mapInArrow(_ask_words_and_pairs(ranges), _ASKED), ranges, fine, count)
    v = answers.agg(F.sum("types")).first()[0] or 0
    schema = _BLOCK.format(kind=kind) + ", words binary, single binary, pair binary, used binary"
    pairs = written(blocks.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_join(least), schema), "lm-pairs")
    dropped(blocks, answers)
    answers = exchange(pairs.mapInArrow(_ask_triples(ranges, least), _ASKED), ranges, fine, count)
    joined = pairs.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_join_triples(least), _BLOCK.format(kind=kind) + ", single binary, pair binary, triple binary")
    joined = written(joined, "lm-joined")
    dropped(pairs, answers)
    cells = joined.mapInArrow(_deleted(n, v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell")
    # Rounding bounds their number, whatever the corpus.
    fitted = cells.toArrow()
    found = (fitted["cell"].to_numpy(), fitted["n"].to_numpy()) if fitted.num_rows else (np.zeros(1, np.int64), np.ones(1, np.int64))
    shared = df.sparkSession.sparkContext.broadcast(fit_weights(*found))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        top, weights = shared.value
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                e = Estimates(row, n, v)
                block, w, three = e.block, weights[e.narrow], top[e.wide]
                mixed = three * e.three + (1 - three) * (w[:, 0] * e.two + w[:, 1] * e.one + w[:, 2] * e.base)
                ids = column(batch, "ids")[i].values
                totals = [np.add.reduceat(np.log10(x), block.starts) for x in (_base(e.word, n, v), mixed)]
                columns = [ids, pa.array(~block.train), pa.array(block.lengths), pa.array(sums_of(e.word > 0, block.lengths)), pa.array(np.full(len(ids), n, np.int64)), *map(pa.array, totals)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def is_held_out(id_col: str = "doc_id") -> Column:
    return crc32_mod(F.col(id_col), 10) == 0
