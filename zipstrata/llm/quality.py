"""Quality rules: a learned decision list, in built-in expressions only.

Statistics of a text are Spark expressions on arrays of its words and lines.  A
list of rules is learned from the statistics of labelled documents by sequential
covering: on two thirds of the rows a conjunction of thresholds is *grown* by FOIL's
gain until it covers no good document; on the other third conditions are *pruned* from its end while
that raises (bad - good) / (bad + good); rows that it covers are set aside and the next
rule is grown, until one is right less often than `least_precision`.  The list
becomes an ordered CASE expression.

Learning reads a bounded sample of labelled documents (`max_rows`, by a hash of the
id); all else is computed for all rows, with no shuffle and no Python on the executors.

Edge cases: null and empty texts have no words, so all statistics are zero and the
base rule fails them; without labels of both kinds the list is empty and keeps what the base
rule keeps; ties between thresholds go to the first statistic and the lower
threshold; repeated rows are judged alike; texts of any length are read
whole; column names that begin with "__q_" are used and dropped again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, table

_SPACE = "[ \\t-\\r]+"
#: Statistics that rules may use, as SQL over the columns of statistics().
FEATURES = {
    "chars_per_word": "__q_chars / greatest(__q_words, 1)",
    "symbols_per_char": "__q_symbols / greatest(__q_chars, 1)",
    "dup_line_share": "__q_dup_lines / greatest(__q_lines, 1)",
    "repeat_share": "__q_repeats / greatest(__q_words, 1)",
    "upper_per_char": "__q_upper / greatest(__q_chars, 1)",
    "marks_per_word": "__q_marks / greatest(__q_words, 1)",
    "digits_per_char": "__q_digits / greatest(__q_chars, 1)",
    "distinct_share": "__q_distinct / greatest(__q_words, 1)",
    "words_per_line": "__q_words / greatest(__q_lines, 1)",
    "n_words": "cast(__q_words as double)",
}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns __q_*: counts of words, characters, symbols, lines and repeats of the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("__q_w", F.array_remove(F.split(text, _SPACE), ""))
    d = d.withColumn("__q_l", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    d = d.withColumn("__q_h", F.transform("__q_w", lambda w: F.xxhash64(w)))
    d = d.withColumns({
        "__q_words": F.size("__q_w").cast("long"),
        "__q_chars": F.char_length(F.array_join("__q_w", "")).cast("long"),
        "__q_distinct": F.size(F.array_distinct("__q_h")).cast("long"),
        "__q_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "__q_upper": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
        "__q_marks": F.regexp_count(text, F.lit("[!?]")).cast("long"),
        "__q_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
        "__q_lines": F.size("__q_l").cast("long"),
        "__q_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
        "__q_t": F.expr("transform(slice(__q_h, 1, greatest(size(__q_h) - 2, 0)), (x, i) -> xxhash64(x, __q_h[i + 1], __q_h[i + 2]))"),
    }).drop("__q_w", "__q_l", "__q_h")
    # Windows found twice: sorted by hash they are neighbours.  Few texts have any, which distinct hashes tell at once.
    d = d.withColumn("__q_t", F.expr("if(size(array_distinct(__q_t)) < size(__q_t), sort_array(transform(__q_t, (x, i) -> struct(x as h, i as i))), array())"))
    d = d.withColumn("__q_t", F.expr("sort_array(transform(filter(__q_t, (x, j) -> x.h <=> get(__q_t, j - 1).h or x.h <=> get(__q_t, j + 1).h), x -> x.i))"))
    repeats = F.expr("aggregate(transform(__q_t, (x, j) -> least(3, coalesce(get(__q_t, j + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return d.withColumn("__q_repeats", repeats).drop("__q_t")


def _only(d: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed statistics.

    A row number stands between, or else the optimiser would push the condition
    below the projections and put a copy of each statistic's expression wherever it is used.
    """
    return d.withColumn("__q_row", F.monotonically_increasing_id()).filter(condition & (F.col("__q_row") >= 0))


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated three-word windows."""
    return (F.col("__q_words") < 50) | (100 * F.col("__q_repeats") > 50 * F.col("__q_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            ends = np.flatnonzero(v[1:] > v[:-1])  # last index of each run of equal values but the largest
            if not len(ends):
                continue
            low_p = np.cumsum(b)[ends]
            low_n = ends + 1 - low_p
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)), g[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.8, least_covered: int = 3) -> list[Rule]:
    """Decision list for bad rows; x: feature -> values."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2  # rows come in a hashed order
    while len(rules) < most_rules and (left & bad).any() and (left & ~bad).any():
        g, q = left & ~third, left & third
        if not (g & bad).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], most_conditions)
        xq, bq = {k: v[q] for k, v in x.items()}, bad[q]

        def worth(r: Rule, xq=xq, bq=bq) -> float:
            c = _covers(r, xq, len(bq))
            return (2 * (c & bq).sum() - c.sum()) / max(c.sum(), 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, x, len(bad)) & left
        if not rule or c.sum() < least_covered or (c & bad).sum() < least_precision * c.sum() or worth(rule) < 2 * least_precision - 1 and (q & bad).any() and _covers(rule, xq, len(bq)).any():
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for kept rows: CASE WHEN rule 1 THEN false ... ELSE true."""
    out = None
    for rule in rules:
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = F.when(every, F.lit(False)) if out is None else out.when(every, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 9000, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules from labels (id, quality 1 good, 0 bad) of at most max_rows documents that pass the base rule."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("__q_label"))
    chosen = F.broadcast(bounded_sample(marked, id_col, max_rows))
    s = _only(statistics(docs.select(id_col, text_col).join(chosen, id_col), text_col), ~base_failed())
    rows = s.orderBy(F.xxhash64(id_col, F.lit(1)), id_col).select("__q_label", *(F.expr(e).alias(n) for n, e in FEATURES.items())).limit(max_rows).collect()
    x = {n: np.array([float(r[n]) for r in rows]) for n in FEATURES}
    return learn(x, np.array([r["__q_label"] == 0 for r in rows], bool))


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with the statistics __q_*, __q_base_failed and __q_kept."""
    d = statistics(docs, text_col).withColumn("__q_base_failed", base_failed())
    return d.withColumn("__q_kept", ~F.col("__q_base_failed") & verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs, all columns, without rows that the base rule or the list rejects."""
    return _only(judged(docs, rules, text_col), F.col("__q_kept")).select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base statistics of all documents and the verdict of base rule and learned list."""
    docs = table(spark, sf_dir, "documents")
    j = judged(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return j.select("doc_id", F.col("__q_words").alias("n_words"), F.col("__q_chars").alias("word_chars"), F.col("__q_symbols").alias("n_symbols"), F.col("__q_dup_lines").alias("n_dup_lines"), F.col("__q_repeats").alias("n_repeat_words"), F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"))
