"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects a document whose score is over a cutoff. Labelled documents of
good quality are the holdout: for each stratum (language), rule and candidate
cutoff, the exact binomial tail tells whether the share of good documents over
the cutoff is below a limit. With n good documents, k of them over the cutoff,
the cutoff is certified if P(Binomial(n, limit) <= k) <= delta / tests. The
limit is ``risk`` shared out among the rules, ``tests`` is strata times rules
(Bonferroni; within one rule cutoffs are nested and tested from the loosest on,
which needs no correction). So with probability 1 - delta, no stratum loses more
than the share ``risk`` of its good documents to the rules. The tail needs
independent trials, so a document id counts once, whatever its rows, and so does
a text of a stratum, whatever its copies.
Of the certified cutoffs the one with the best balance of rejected bad and good
labelled documents is used, of equal ones the loosest. A stratum with too few
labels has no certified cutoff and no rule applies there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import WORD_BREAK, written

#: Rule scores, each with its candidate cutoffs from the loosest to the strictest.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),  # symbols a word
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),  # share of words in repeated windows
    "lines": (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3),  # share of repeated lines
    "capitals": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),  # share of capitals in word characters
}
RISK, DELTA = 0.04, 0.05
MIN_WORDS, MAX_REPEATS = 50, 50
#: Up to so many strata, their cutoffs are broadcast; more are joined by salted keys.
BROADCAST_STRATA, SALTS = 10_000, 32


def add_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct column ``f`` of per-text counts; other columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    step = df.select(
        F.struct("*").alias("r"),
        words.alias("w"),
        lines.alias("l"),
        without(" \t\n\x0b\f\r").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_capitals"),
    )
    # Windows of three words, sorted so that equal ones are neighbours: by hash,
    # then by the words, so that a collision of hashes can't join two windows.
    n = F.greatest(F.size("w") - 2, F.lit(0))
    zipped = F.arrays_zip(F.slice("w", F.lit(1), n).alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))
    window = lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), i.alias("i"))
    step = step.withColumn("s", F.sort_array(F.transform(zipped, window)))
    m = F.greatest(F.size("s") - 1, F.lit(0))
    same = lambda x, y: (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    pairs = F.zip_with(F.slice("s", F.lit(1), m), F.slice("s", F.lit(2), m), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
    step = step.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    # Words covered: each window adds what the one before has not covered.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("at", start, lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": covered,
        "n_lines": F.size("l"),
        "n_capitals": F.col("n_capitals"),
    }
    return step.select("r.*", F.struct(*(c.cast("long").alias(k) for k, c in counts.items())).alias("f"))


def _score(rule: str) -> Column:
    top, bottom = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_lines"), "capitals": ("n_capitals", "word_chars")}[rule]
    return F.col(f"f.{top}") / F.greatest(F.col(f"f.{bottom}"), F.lit(1))


def base_failed() -> Column:
    """The fixed rules: under 50 words, or over half of them in repeated windows."""
    return (F.col("f.n_words") < MIN_WORDS) | (100 * F.col("f.n_repeat_words") > MAX_REPEATS * F.col("f.n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log(n - j + 1) - F.log(j) + odds
        high, low = F.greatest(term, acc["total"]), F.least(term, acc["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), add, lambda acc: acc["total"]))


def calibrate(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with a certified cutoff: ``stratum`` and a column for
    each rule (null: not certified).

    ``rows``: ``doc_id, stratum, h`` (a digest of the text), ``f``; ``labels``:
    ``doc_id, quality`` (1 good, 0 bad). Labels without id or quality are passed
    over; of several labels of a document, or of a text, the lowest counts. Of rows
    of one id the first by digest and stratum is the trial. Documents that fail the
    base rules take no part.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trial = F.struct("h", "stratum", *(_score(r).alias(r) for r in RULES))
    labelled = rows.filter(~base_failed()).select("doc_id", trial.alias("x")).join(known, "doc_id")
    held = labelled.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality"))
    held = held.groupBy("x").agg(F.min("quality").alias("quality")).select("x.*", "quality")
    good = F.col("quality") >= 1
    over = lambda r, c, who: F.count(F.when(who & (F.col(r) > c), 1))
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), over(r, c, good).alias("good"), over(r, c, ~good).alias("bad")) for r, cuts in RULES.items() for c in cuts]
    counted = written(held.groupBy("stratum").agg(F.count(F.when(good, 1)).alias("n"), F.array(*cells).alias("cells")).filter("n > 0"), "counts")
    tests = max(1, counted.count()) * len(RULES)
    limit = risk / len(RULES)
    cell = counted.select("stratum", "n", F.explode("cells").alias("x")).select("stratum", "n", "x.*")
    # At or over the limit nothing can be certified; sparing the sum keeps it short.
    sure = cell.filter(F.col("good") < limit * F.col("n")).filter(binomial_tail(F.col("n"), F.col("good"), limit) <= delta / tests)
    best = sure.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad") - F.col("good")).alias("gain"), "cut")).alias("x"))
    return written(best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("x.cut"))).alias(r) for r in RULES)), "cutoffs")


def decide(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with ``stratum`` and ``f``."""
    limits = cutoffs.select("stratum", F.struct(*RULES).alias("cuts"))
    n = limits.count()
    if n <= BROADCAST_STRATA:
        joined = rows.join(F.broadcast(limits), "stratum", "left")
    else:
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("f"), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "salt"], "left").drop("salt")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_score(rule) > F.col(f"cuts.{rule}"), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~(base_failed() | rejected)}).drop("cuts")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A null or empty text has no words and fails the base rules. A null stratum is
    a stratum of its own. Repeated rows get the same verdict; null ids are passed
    on and take no part in the calibration. No labels: only the base rules apply.
    No rows give no rows. Texts are counted whole, whatever their length, each
    within its row. Of cutoffs of equal gain the loosest is taken. Other columns of
    ``df`` are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), _stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    rows = written(add_features(rows).withColumn("h", _digest()).drop("text"), "features")
    return decide(rows, calibrate(rows, labels)).select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, all columns as they are."""
    rows = df.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), _stratum(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    rows = written(add_features(rows).withColumn("h", _digest()).drop("text"), "features")
    return decide(rows, calibrate(rows.select("doc_id", "stratum", "h", "f"), labels)).filter("kept").select("doc.*")


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def _stratum(name: str) -> Column:
    # The prefix keeps a null apart from a stratum of that name.
    return F.when(F.col(name).isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))
