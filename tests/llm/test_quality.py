from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from docspark.llm import quality_rules as Q


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = ["", None, " \n\t", "one", "a b c a b c", "a b c d a b c d e", "x x x x x", "é ü ß\x85z \x1f", "l1\nl1\n \n \nl2\nl1", "# * $ % & | < >", "a\x0bb\x0cc\rd", "w " * 400, "\n".join(["same line here"] * 30)]


def test_counts_are_brute_force():
    for t in TEXTS:
        assert Q.statistics(None if t is None else t.encode())[:5] == brute(t), t


def test_query_over_rows(spark, docs_of):
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (3, "one"), (50, "word " * 100_000)]
    judged = Q.judge(docs_of(rows), [Q.Rule((("symbols", ">", 0.5),))])
    got = sorted(((r.doc_id if r.doc_id is not None else -1), tuple(r.quality_stats)[:5], r.base_failed) for r in judged.collect())
    want = sorted(((i if i is not None else -1), b := brute(t) if i != 50 else (100_000, 400_000, 0, 0, 100_000), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in rows)
    assert got == want
    assert Q.judge(docs_of([]), []).collect() == []


def test_learns_rules_that_generalise():
    rng = np.random.default_rng(0)
    n = 3000
    rows = np.zeros((n, len(Q.COUNTS + Q.MORE)), np.int64)
    at = {c: i for i, c in enumerate(Q.COUNTS + Q.MORE)}
    rows[:, at["n_words"]] = rng.integers(60, 900, n)
    rows[:, at["word_chars"]] = rows[:, at["n_words"]] * 5
    rows[:, at["n_chars"]] = rows[:, at["n_words"]] * 6
    rows[:, at["n_lines"]] = 10
    bad = rng.random(n) < 0.25
    kind = rng.integers(0, 2, n)
    rows[bad & (kind == 0), at["n_symbols"]] = (rows[bad & (kind == 0), at["n_words"]] * rng.uniform(0.6, 3, (bad & (kind == 0)).sum())).astype(int)
    rows[bad & (kind == 1), at["n_upper"]] = rows[bad & (kind == 1), at["n_chars"]] // 2
    rules = Q.learn(rows[:2000], bad[:2000])
    x = Q.features(rows[2000:])
    names = [f[0] for f in Q.FEATURES]
    hit = np.zeros(1000, bool)
    for r in rules:
        hit |= Q._holds(x, [(names.index(n), op, t) for n, op, t in r.tests])
    assert 2 <= len(rules) <= 6 and (hit == bad[2000:]).mean() > 0.995


def test_rules_as_a_spark_expression_agree_with_numpy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = [Q.Rule((("upper", ">", 0.4), ("exclaims", ">", 0.1))), Q.Rule((("symbols", ">", 0.3),)), Q.Rule((("distinct", "<=", 0.2),))]
    rows = Q.judge(docs, rules).select("quality_stats.*", "quality_rule").collect()
    x = Q.features(np.array([list(r)[:-1] for r in rows]))
    names = [f[0] for f in Q.FEATURES]
    want = np.zeros(len(rows), int)
    for k in range(len(rules), 0, -1):
        want[Q._holds(x, [(names.index(n), op, t) for n, op, t in rules[k - 1].tests])] = k
    assert [r.quality_rule for r in rows] == want.tolist()


def test_held_out_labels(spark):
    """Rules learned from three quarters of the labels judge the rest."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rules = Q.fit(docs, labels.where(~held))
    judged = Q.judge(docs, rules).join(labels.where(held).select("doc_id", "quality"), "doc_id").where("not base_failed").select("kept", "quality").toPandas()
    assert (judged.kept == (judged.quality == 1)).mean() > 0.97
    assert judged[judged.quality == 1].kept.mean() > 0.98


def test_odd_labels(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, "c d")])
    label = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int")
    assert Q.fit(docs, label([])) == []
    assert Q.fit(docs, label([(1, None), (None, 0), (1, 1), (1, 0), (9, 0)])) == []
    assert Q.fit(docs_of([]), label([(1, 1), (2, 0)])) == []


def test_clashing_columns_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", 5, "r", "s")], "doc_id bigint, text string, kept string, base_failed int, quality_rule string, quality_stats string")
    row = Q.judge(docs, []).first()
    assert (row.input_kept, row.input_base_failed, row.input_quality_rule, row.input_quality_stats) == ("mine", 5, "r", "s")
    assert row.kept is False and row.base_failed is True and row.quality_rule == 0 and row.quality_stats.n_words == 3
