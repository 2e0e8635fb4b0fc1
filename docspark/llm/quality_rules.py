"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering grows one conjunction of thresholds at a time on two thirds of the labelled rows, prunes it on
the rest, and takes the rows it covers away. The list becomes one ordered Spark conditional expression.

Defined results: a null text has no words and fails the base test; labels that are null, or that contradict each
other for one document, teach nothing; without both classes the list is empty and keeps what passes the base test.
Repeated rows are judged alike, one by one. Extra columns pass through, one named like a column of the verdict as
input_<name>; the statistics stay in one struct column.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, as_bytes, bounded_batches

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_lower", "n_exclaim", "n_pipe", "n_digits", "n_distinct", "n_chars"]
SCHEMA = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS + MORE) + ">"
_ARROW = pa.struct([(c, pa.int64()) for c in COUNTS + MORE])
SYMBOLS = b"#*$%&|<>"
_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
#: Ratios the rules may test, as (name, numerator, denominator).
FEATURES = [
    ("mean_word", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"), ("upper", "n_upper", "n_chars"), ("lower", "n_lower", "n_chars"),
    ("exclaims", "n_exclaim", "n_words"), ("pipes", "n_pipe", "n_words"), ("digits", "n_digits", "n_chars"),
    ("distinct", "n_distinct", "n_words"), ("line_words", "n_words", "n_lines"),
]
#: Labelled rows a fit may take; rows are taken in the order of a hash of doc_id.
MAX_ROWS = 10_000


def count_repeats(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def statistics(text: bytes | None) -> tuple[int, ...]:
    """COUNTS and MORE of one UTF-8 text."""
    text = text or b""
    words = text.split()
    at = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(at[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words), chars - int(at[_SPACES].sum()), int(at[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), count_repeats(words),
        len(lines), int(at[65:91].sum()), int(at[97:123].sum()), int(at[33]), int(at[124]), int(at[48:58].sum()), len(set(words)), chars,
    )


def _statistics(text: pa.Array) -> pa.Array:
    rows = np.array([statistics(x) for x in as_bytes(text)], np.int64).reshape(-1, len(_ARROW))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_ARROW))], fields=list(_ARROW))


def with_statistics(df: DataFrame, text: str = "text", to: str = "quality_stats") -> DataFrame:
    bounded_batches(df.sparkSession)
    made = F.arrow_udf(_statistics, SCHEMA).asNondeterministic()  # else a filter on it computes it twice
    return apart(df, to).withColumn(to, made(F.col(text)))


@dataclass(frozen=True)
class Rule:
    """Rejects a text if every test holds: (feature, '<=' or '>', threshold)."""

    tests: tuple[tuple[str, str, float], ...]


def features(rows: np.ndarray) -> np.ndarray:
    at = {c: rows[:, i].astype(float) for i, c in enumerate(COUNTS + MORE)}
    return np.column_stack([at[a] / np.maximum(at[b], 1) for _, a, b in FEATURES]) if len(rows) else np.zeros((0, len(FEATURES)))


def _holds(x: np.ndarray, tests: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, t in tests:
        out &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return out


def _best_test(x: np.ndarray, bad: np.ndarray, cuts: int) -> tuple[float, tuple[int, str, float]] | None:
    """The test of the largest information gain, as FOIL counts it."""
    p0, n0 = bad.sum(), (~bad).sum()
    base, best = np.log2(p0 / (p0 + n0)), None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if len(edge) > cuts:
            edge = edge[np.linspace(0, len(edge) - 1, cuts).astype(int)]
        if not len(edge):
            continue
        p = np.cumsum(b)[edge]
        n = edge + 1 - p
        for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), (f, op, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
    return best


def learn(rows: np.ndarray, bad: np.ndarray, *, max_tests: int = 4, max_rules: int = 24, precision: float = 0.9, cuts: int = 512, seed: int = 7) -> list[Rule]:
    """Sequential covering over rows of COUNTS + MORE; bad marks the rows to reject."""
    x, bad = features(rows), np.asarray(bad, bool)
    names, out = [f[0] for f in FEATURES], []
    rng = np.random.default_rng(seed)
    least = max(2, int(0.01 * bad.sum()))
    while len(out) < max_rules and bad.sum() >= least and (~bad).any():
        part = rng.random(len(x)) < 2 / 3
        gx, gb, px, pb = x[part], bad[part], x[~part], bad[~part]
        tests: list[tuple[int, str, float]] = []
        here = np.ones(len(gx), bool)
        while len(tests) < max_tests and gb[here].any() and not gb[here].all():
            found = _best_test(gx[here], gb[here], cuts)
            if found is None:
                break
            tests.append(found[1])
            here = _holds(gx, tests)

        def worth(k: int, tests=tests, px=px, pb=pb) -> float:
            on = _holds(px, tests[:k])
            return (pb[on].sum() - (~pb[on]).sum()) / max(on.sum(), 1)

        if tests:
            tests = tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]
        covers = _holds(x, tests)
        if not tests or bad[covers].sum() < least or bad[covers].mean() < precision:
            break
        out.append(Rule(tuple((names[f], op, t) for f, op, t in tests)))
        x, bad = x[~covers], bad[~covers]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> list[Rule]:
    """Learn from documents (doc_id, text) and labels (doc_id, quality); max_rows bounds the labelled rows taken."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    taken = own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    taken = taken.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other").drop("_other")
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")).select("doc_id", "quality", "quality_stats.*").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(max_rows).toPandas()
    if rows.empty or rows.quality.nunique() < 2:
        return []
    return learn(rows[COUNTS + MORE].to_numpy(np.int64), rows.quality.to_numpy() == 0)


def base_failed(stats: Column) -> Column:
    return (stats.n_words < 50) | (100 * stats.n_repeat_words > 50 * stats.n_words)


def matched_rule(rules: list[Rule], stats: Column) -> Column:
    """The position of the first rule that holds, from 1; 0 if none does. One ordered conditional expression."""
    ratio = {n: stats[a].cast("double") / F.greatest(stats[b], F.lit(1)).cast("double") for n, a, b in FEATURES}
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        tests = [ratio[n] <= F.lit(t) if op == "<=" else ratio[n] > F.lit(t) for n, op, t in rule.tests]
        all_of = tests[0]
        for t in tests[1:]:
            all_of = all_of & t
        out = F.when(all_of, i) if out is None else out.when(all_of, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with quality_stats, quality_rule (the rule that rejects it, or 0), base_failed and kept."""
    stats = F.col("quality_stats")
    return with_statistics(apart(docs, "base_failed", "quality_rule", "kept"), text).withColumns({"base_failed": base_failed(stats), "quality_rule": matched_rule(rules, stats)}).withColumn("kept", ~F.col("base_failed") & (F.col("quality_rule") == 0))
