"""op3 against a plain version, and the binomial tail."""

import re
from collections import Counter
from math import comb

from conftest import by_id
from pyspark.sql import functions as F

from skylode.llm import quality_rules


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(df, judged):
    found = by_id(judged)
    for r in df.collect():
        n = counts(r["text"])
        got = found[r["doc_id"]]
        assert got[1:6] == n
        assert got["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got["kept"] and got["base_failed"])


def test_counts(documents, labels, messy, empty):
    check(documents, quality_rules.judge(documents, labels))
    judged = quality_rules.judge(messy, labels)
    check(messy, judged)
    assert judged.count() == messy.count()
    assert quality_rules.judge(empty, labels).count() == 0


def test_no_labels_leave_the_base_rules(messy, labels):
    judged = quality_rules.judge(messy, labels.filter("false"))
    assert judged.filter("kept = base_failed").count() == 0


def test_binomial_tail(spark):
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.04), (200, 7, 0.02), (1, 1, 0.5)]:
        exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert abs(got - exact) < 1e-9


def test_certified_cutoffs_reject(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, clean + f" {i}", "en") for i in range(1500)] + [(9000 + i, " ".join(f"w{j}#" for j in range(60)) + f" {i}", "en") for i in range(100)]
    rows += [(20000 + i, clean.replace("word", "w#") + f" {i}", "fr") for i in range(3)]  # too few labels to certify
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 9000).cast("int").alias("quality"))
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] < 9000 or r[0] >= 20000}


def test_keep_good_keeps_columns(messy, labels, empty):
    kept = quality_rules.keep_good(messy, labels)
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in quality_rules.judge(messy, labels).filter("kept").collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(ids)
    assert quality_rules.keep_good(empty, labels).count() == 0


def test_copies_are_no_trials_of_their_own(spark):
    good = " ".join(f"w{i}#" for i in range(60))
    bad = [(9000 + i, " ".join(f"v{j}#" for j in range(60)) + f" {i}", "en") for i in range(100)]
    repeated = [(1, good, "en")] * 3000  # rows of one id
    copies = [(i, good, "en") for i in range(3000)]  # ids of one text
    for rows in (repeated, copies):
        docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
        labels = docs.select("doc_id", (F.col("doc_id") < 9000).cast("int").alias("quality")).distinct()
        assert quality_rules.judge(docs, labels).filter("not kept").count() == 0


def test_no_python_on_the_main_path(documents, labels):
    for df in (quality_rules.judge(documents, labels), quality_rules.add_features(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "RDD"))
