"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window,
each filter keeps its maximum and a softmax layer reads these maxima. A text's
prediction is the mean over all of its windows, weighted by their letters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.llm.common import bytes_of, column, crc32_mod, text_slices, written

#: Bytes in a window; the last one of a text is padded with zeros.
WINDOW = 128
#: The training sample: documents of a language, at most, and windows of a document. Of
#: many languages each gets its share of SAMPLE documents, but LEAST at least: every
#: language is learned, however many there are.
PER_LANGUAGE, SAMPLE, LEAST, SPREAD = 600, 12_000, 8, 4
#: Up to so many languages, their shares are broadcast.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"

# Letters fold to lower case, digits to one; other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
#: Bytes that are part of a letter: a-z, and all of a character beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class ByteCnn:
    """Embedding, filters of each width, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray  # 256 x e
    filters: dict[int, np.ndarray]  # width -> (width * e) x f
    bias: dict[int, np.ndarray]
    dense: np.ndarray  # all filters x languages
    offset: np.ndarray
    widths: list[int] = field(init=False)

    def __post_init__(self):
        self.widths = sorted(self.filters)

    @staticmethod
    def start(languages: list[str], seed: int = 7, e: int = 8, f: int = 16, widths: tuple[int, ...] = (2, 3, 4)) -> ByteCnn:
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return ByteCnn(
            languages,
            normal(256, e, scale=0.5),
            {w: normal(w * e, f, scale=(w * e) ** -0.5) for w in widths},
            {w: np.zeros(f, np.float32) for w in widths},
            normal(f * len(widths), len(languages), scale=0.2),
            np.zeros(len(languages), np.float32),
        )

    def _columns(self, windows: np.ndarray, width: int) -> np.ndarray:
        """(windows, positions, width * e): the embedded bytes under each filter position."""
        embedded = self.embedding[windows]
        places = WINDOW - width + 1
        return np.concatenate([embedded[:, i : i + places] for i in range(width)], axis=2)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Maxima of all filters, and where each was reached."""
        out, where = [], {}
        for w in self.widths:
            cols = self._columns(windows, w)
            values = cols.reshape(-1, cols.shape[2]) @ self.filters[w]
            values = values.reshape(len(windows), -1, values.shape[1])
            where[w] = values.argmax(axis=1)
            best = np.take_along_axis(values, where[w][:, None], axis=1)[:, 0]
            out.append(np.maximum(best + self.bias[w], 0))
        return np.concatenate(out, axis=1), where

    @functools.cached_property
    def lookups(self) -> dict[int, list[np.ndarray]]:
        """What each byte adds to the filters of a width at each of its places."""
        e = self.embedding.shape[1]
        return {w: [self.embedding @ self.filters[w][i * e : (i + 1) * e] for i in range(w)] for w in self.widths}

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        """The maxima alone, by table lookups in place of products."""
        out = []
        for w in self.widths:
            places = WINDOW - w + 1
            values = self.lookups[w][0].take(windows[:, :places], axis=0)
            for i in range(1, w):
                values += self.lookups[w][i].take(windows[:, i : i + places], axis=0)
            out.append(np.maximum(values.max(axis=1) + self.bias[w], 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.dense + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)

    def loss(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
        """Weighted mean cross-entropy."""
        odds = self.probabilities(self.pooled(windows)[0])[np.arange(len(target)), target]
        return float(-(weight * np.log(odds)).sum() / weight.sum())

    def params(self) -> list[np.ndarray]:
        return [self.embedding, self.dense, self.offset, *(self.filters[w] for w in self.widths), *(self.bias[w] for w in self.widths)]

    def slopes(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """The loss' slope by each of ``params``; it flows through the maxima alone."""
        pooled, where = self.pooled(windows)
        error = self.probabilities(pooled)
        error[np.arange(len(target)), target] -= 1
        error *= (weight / weight.sum())[:, None].astype(error.dtype)
        back = (error @ self.dense.T) * (pooled > 0)
        embedding, filters, bias = np.zeros_like(self.embedding), [], []
        at, e = 0, self.embedding.shape[1]
        for w in self.widths:
            f = self.filters[w].shape[1]
            own, at = back[:, at : at + f], at + f
            # The bytes under each filter's best position: windows x filters x width.
            bytes_ = np.take_along_axis(windows[:, None, :], where[w][:, :, None] + np.arange(w), axis=2)
            filters.append(np.einsum("nf,nfk->kf", own, self.embedding[bytes_].reshape(len(windows), f, w * e)))
            bias.append(own.sum(axis=0))
            np.add.at(embedding, bytes_.ravel(), (own[:, :, None] * self.filters[w].T[None]).reshape(-1, e))
        return [embedding, pooled.T @ error, error.sum(axis=0), *filters, *bias]

    def fit(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.01, batch: int = 64, seed: int = 11) -> None:
        """Adam on the weighted cross-entropy."""
        r = np.random.default_rng(seed)
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(windows)), max(1, len(windows) // batch)):
                step += 1
                for p, m, v, g in zip(params, first, second, self.slopes(windows[rows], target[rows], weight[rows])):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, its probability) of each text over all its windows."""
        sizes = np.array([len(t) for t in texts])
        counts = np.maximum(-(-sizes // WINDOW), 1)
        flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
        at = (np.cumsum(counts) - counts) * WINDOW
        for t, a in zip(texts, at.tolist()):
            flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
        windows = _FOLD[flat].reshape(-1, WINDOW)
        weight = _LETTER[windows].sum(axis=1) + 1e-3
        # Blocks that stay in the processor's cache.
        odds = np.concatenate([self.probabilities(self.maxima(windows[i : i + 64])) for i in range(0, len(windows), 64)])
        starts = np.cumsum(counts) - counts
        shares = np.add.reduceat(odds * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        # Rounded, as products of matrices depend a little on what shares their block.
        shares = shares.round(6)
        best = shares.argmax(axis=1)
        return best, np.clip(shares[np.arange(len(texts)), best], 0, 1)


def _windows_of(text: Column) -> Column:
    """Windows spread over the whole text, for training."""
    raw = F.encode(text, "UTF-8")
    room = F.greatest(F.octet_length(text) - WINDOW, F.lit(0))
    return F.array(*(F.substring(raw, (F.floor(room * (i + 0.5) / SPREAD) + 1).cast("int"), F.lit(WINDOW)) for i in range(SPREAD)))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """Learns from a bounded sample of labelled texts; None if there are none.

    Up to ``PER_LANGUAGE`` documents of each language (fewer where there are many
    languages, never under ``LEAST``), the first by a hash of id and text, and
    ``SPREAD`` windows of each. Every language with a text is learned; each has the
    same weight. Rows without text or language are passed over.
    """
    order = F.xxhash64(F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 63) - 1))
    rows = df.filter((F.octet_length(text_col) > 0) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), order.alias("h"), F.col(text_col).alias("text"))
    counted = written(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.min("h").alias("first")), "languages")
    n = counted.count()
    if not n:
        return None
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // n))
    # A share of each language by its count, thrice what is wanted, and its first row: a
    # frequent language sends no more rows to its ranking than a rare one.
    shares = counted.select("lang", "first", (F.lit(3.0 * each) / F.col("rows")).alias("share"))
    rows = rows.join(F.broadcast(shares) if n <= BROADCAST_LANGUAGES else shares, "lang")
    rows = rows.filter((F.col("h") / float(1 << 63) < F.col("share")) | (F.col("h") == F.col("first")))
    rows = rows.select("lang", "h", F.xxhash64("text").alias("h2"), _windows_of(F.col("text")).alias("windows"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "h2"))).filter(F.col("n") <= each)
    sample = ranked.select("lang", "windows").collect()
    languages = sorted({r["lang"] for r in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    pairs = [(w, number[r["lang"]]) for r in sample for w in {bytes(w) for w in r["windows"]}]
    pairs.sort()
    windows = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (w, _) in enumerate(pairs):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    target = np.array([y for _, y in pairs])
    model = ByteCnn.start(languages)
    model.fit(_FOLD[windows], target, 1.0 / np.bincount(target, minlength=len(languages))[target])
    return model


def predict(df: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text.

    A text that is null, empty or has no letter is ``und`` with score 0, as is every
    text if there is no model. Long texts are read whole, window by window. Of
    equally probable languages the first by name is given. Only the text is read;
    repeated rows give repeated results, null ids are passed on, no rows give none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for part in text_slices(batches):
            lettered = column(part, "lettered").to_numpy(zero_copy_only=False)
            lang = np.full(part.num_rows, UNKNOWN, object)
            score = np.zeros(part.num_rows)
            some = np.flatnonzero(lettered) if net else []
            if len(some):
                texts = bytes_of(part)
                best, odds = net.predict([texts[i] for i in some])
                lang[some] = np.array(net.languages, object)[best]
                score[some] = odds
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)).alias("lettered"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def is_held_out(id_col: str = "doc_id") -> Column:
    return crc32_mod(F.col(id_col), 3) == 1
