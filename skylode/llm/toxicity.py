"""Toxicity as graded severity: cumulative-link ordinal regression on sparse words.

Labels say toxic or not, so grades of severity are derived from evidence that the
regression does not get to see: the labelled sample is halved, each half's words
are chosen and weighed by the labels of the other half alone, and the thirds of
the toxic documents by that cross-fitted weight are grades 1 to 3. P(grade > k) is the logistic function of w.x - threshold_k with one weight
vector for all thresholds; the sum over k is the expected severity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import column, text_slices, texts_of, written

#: Labelled documents in the training sample, at most: toxic ones up to half of it, then others.
SAMPLE = 20_000
#: Chance that any tested word enters the vocabulary by accident.
ACCIDENT = 0.1
#: Grades of toxic documents, at most.
GRADES = 3
#: Documents that a word's rate of toxic ones in a half is drawn towards the mean by.
PRIOR = 2.0
#: Documents of this expected severity or more are rejected.
REJECT = 0.5

_words = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> set[str]:
    return set(_words(text.lower()))


@dataclass
class OrdinalModel:
    """``weights`` of words, and increasing ``thresholds`` between the grades."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def severity(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, most probable grade) of each text.

        A text without any word of the vocabulary has no evidence: 0 and 0.
        """
        known = self.weights
        found = [[known[w] for w in words_of(t) if w in known] for t in texts]
        x = np.array([sum(f) for f in found])
        over = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -50, 50)))
        over[[not f for f in found]] = 0
        steps = np.concatenate((np.ones((len(x), 1)), over, np.zeros((len(x), 1))), axis=1)
        return over.sum(axis=1), (steps[:, :-1] - steps[:, 1:]).argmax(axis=1)


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Increasing thresholds: a first value and exponentials of the gaps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def likelihood(w: np.ndarray, free: np.ndarray, doc: np.ndarray, word: np.ndarray, grades: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(penalised log likelihood, its slope by the weights, by the free parameters).

    ``doc`` and ``word``: the documents' words as pairs of numbers.
    """
    levels = len(free)
    theta = _thresholds(free)
    x = np.bincount(doc, weights=w[word], minlength=len(grades))
    over = 1 / (1 + np.exp(np.clip(theta[None, :] - x[:, None], -50, 50)))
    full = np.concatenate((np.ones((len(x), 1)), over, np.zeros((len(x), 1))), axis=1)
    at = np.arange(len(x))
    p = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
    # d log p / d over_k is +1/p at k = grade - 1 and -1/p at k = grade.
    up = np.arange(levels)[None, :]
    slope = over * (1 - over) * ((up == grades[:, None] - 1).astype(float) - (up == grades[:, None])) / p[:, None]
    by_w = np.bincount(word, weights=slope.sum(axis=1)[doc], minlength=len(w)) - penalty * w
    tail = np.cumsum(-slope.sum(axis=0)[::-1])[::-1]
    by_free = np.concatenate((tail[:1], tail[1:] * np.exp(free[1:])))
    return float(np.log(p).sum() - penalty / 2 * (w**2).sum()), by_w, by_free


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, words: int, penalty: float = 0.02, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood.

    ``penalty`` is a Gaussian prior's, for the whole sample.
    """
    lengths = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), lengths)
    word = np.array([i for r in rows for i in r], np.int64)
    levels = int(grades.max(initial=1))
    w, free = np.zeros(words), np.zeros(levels)
    share = np.array([np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(levels)])
    start = np.log((1 - share) / share)
    free[0], free[1:] = start[0], np.log(np.maximum(np.diff(start), 0.1))
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, free)]
    for step in range(1, steps + 1):
        _, *slopes = likelihood(w, free, doc, word, grades, penalty)
        for (p, m, v), g in zip(state, slopes):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, _thresholds(free)


def grades_of(toxic: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """0 for documents that aren't toxic; the others by thirds of their evidence,
    numbered without gaps (ties share the lower grade)."""
    out = np.zeros(len(toxic), np.int64)
    own = evidence[toxic]
    if len(own):
        cuts = np.sort(own)[[len(own) * i // GRADES for i in range(1, GRADES)]]
        third = (own[:, None] > cuts[None, :]).sum(axis=1)
        out[toxic] = np.unique(third, return_inverse=True)[1] + 1
    return out


def _least_documents(sizes: dict[int, int], rate: float) -> tuple[int, float]:
    """(documents of a word below which no count could pass, evidence that passes).

    Words too rare to pass whatever their labels need no correction (Tarone): the
    least m is taken for which all words of m documents or more can be tested.
    ``sizes``: number of words by their number of documents.
    """
    left = sum(sizes.values())
    for m in range(1, max(sizes, default=0) + 1):
        bar = float(np.log(max(1, left) / ACCIDENT))
        if m * -np.log(rate) >= bar:
            return m, bar
        left -= sizes.get(m, 0)
    return max(sizes, default=0) + 1, float("inf")


def _evidence(n: Column, bad: Column, rate: float) -> Column:
    """Chernoff's exponent of ``bad`` toxic ones in ``n`` documents, 0 if no more than expected."""
    share = bad / n
    clean = F.when(bad < n, (n - bad) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when((n > 0) & (bad > 0) & (share > rate), bad * F.log(share / rate) + clean).otherwise(0.0)


def _sample(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the training sample: the first labels by a hash of the id,
    toxic ones first up to half of it, so that rare toxic words are in it."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = written(known, "labels")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    bad, good = (known.filter(F.col("toxic") == x) for x in (1, 0))
    n_bad = min(bad.count(), SAMPLE // 2)
    return bad.orderBy(*order).limit(n_bad).unionByName(good.orderBy(*order).limit(SAMPLE - n_bad))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Learns from a bounded sample of labelled documents.

    Up to ``SAMPLE`` labels, up to half of them toxic, the first by a hash of the id;
    equal texts count once, toxic if any of them is. Every word enters the vocabulary
    whose share of toxic documents is too high for chance (Chernoff's bound,
    Bonferroni over the words that could pass). Labels without id or value are passed
    over. Without toxic labels, without others or without such words nothing is toxic.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(_sample(labels)), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = pa.array([sorted(words_of(t)) for t in texts_of(part)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([column(part, "toxic"), column(part, "h"), words], names=["toxic", "h", "words"])

    rows = rows.select("toxic", F.xxhash64("text").alias("h"), "text")
    # Rows of equal texts are known by their hash.
    seen = rows.mapInArrow(split, "toxic int, h long, words array<string>").groupBy("h").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
    seen = written(seen, "words")
    if seen.count() > SAMPLE:  # ids that repeat may bring more texts
        first = seen.select("toxic", "h").orderBy(F.desc("toxic"), "h").limit(SAMPLE)
        seen = seen.join(F.broadcast(first.select("h")), "h", "left_semi")
    nothing = OrdinalModel({}, np.array([50.0]))
    half = lambda i: F.pmod(F.col("h"), F.lit(2)) == i
    total, toxic, *halves = seen.agg(F.count("*"), F.sum("toxic"), *(x for i in (0, 1) for x in (F.count(F.when(half(i), 1)), F.sum(F.when(half(i), F.col("toxic")))))).first()
    if not toxic or toxic == total:
        return nothing
    rate = toxic / total
    each = seen.select("toxic", "h", F.explode("words").alias("word"))
    sums = [x for i in (0, 1) for x in (F.count(F.when(half(i), 1)).alias(f"n{i}"), F.sum(F.when(half(i), F.col("toxic")).otherwise(0)).alias(f"bad{i}"))]
    counts = written(each.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"), *sums), "word-counts")
    least, bar = _least_documents({r["n"]: r["count"] for r in counts.groupBy("n").count().collect()}, rate)
    strong = counts.filter(F.col("n") >= least).filter(_evidence(F.col("n"), F.col("bad"), rate) >= bar)
    # The words of a bounded sample, and of these the few that pass.
    vocabulary = sorted(r["word"] for r in strong.select("word").collect())
    if not vocabulary:
        return nothing
    # Each document by the other half's rates of words that stand out there, with half
    # of the evidence that the whole sample asks for.
    logit = lambda p: F.log(p / (1 - p))
    weight = F.lit(0.0)
    for i in (0, 1):
        n, bad = halves[2 * i], halves[2 * i + 1] or 0
        mean = min(max(bad / n, 0.5 / n), 1 - 0.5 / n) if n else rate
        drawn = (F.col(f"bad{i}") + PRIOR * mean) / (F.col(f"n{i}") + PRIOR)
        stands_out = _evidence(F.col(f"n{i}"), F.col(f"bad{i}"), mean) >= bar / 2
        weight = F.when(half(1 - i), F.when(stands_out, logit(drawn) - F.lit(float(np.log(mean / (1 - mean))))).otherwise(0.0)).otherwise(weight)
    numbers = df.sparkSession.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "word string, number int")
    found = each.join(counts.select("word", "n0", "bad0", "n1", "bad1"), "word").join(F.broadcast(numbers), "word", "left")
    found = found.groupBy("h").agg(F.sum(F.round(weight, 9)).alias("evidence"), F.sort_array(F.collect_list("number")).alias("ids"))
    found = seen.select("h", "toxic").join(found, "h", "left")
    # Short rows, SAMPLE of them.
    sample = sorted((r["h"], r["toxic"], round(r["evidence"] or 0.0, 6), r["ids"] or []) for r in found.collect())
    grades = grades_of(np.array([r[1] > 0 for r in sample]), np.array([r[2] for r in sample]))
    weights, thresholds = fit_ordinal([r[3] for r in sample], grades, len(vocabulary))
    return OrdinalModel({w: float(x) for w, x in zip(vocabulary, weights)}, thresholds)


def score(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """``doc_id, severity`` (expected), ``grade`` (most probable), ``toxic`` (rejected).

    Whole texts are read, whatever their length; a null or empty one has no words and
    severity 0, as has any without a word of the vocabulary. Of equally probable
    grades the lowest is given. Repeated rows give repeated results, null ids are
    passed on, no rows give no rows, other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            severity, grade = shared.value.severity(texts_of(part))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(severity), pa.array(grade.astype(np.int32)), pa.array(severity >= reject)], names=["doc_id", "severity", "grade", "toxic"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def keep_clean(df: DataFrame, model: OrdinalModel, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``df`` below the rejecting severity, all columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            severity, _ = shared.value.severity(texts_of(part))
            kept = column(part, "doc").filter(pa.array(severity < reject))
            yield pa.RecordBatch.from_arrays([kept], names=["doc"])

    rows = df.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select("doc").schema).select("doc.*")
