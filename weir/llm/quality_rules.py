"""Quality rules: a learned decision list over per-document statistics.

Statistics are Spark expressions. Sequential covering learns, from a bounded
sample of labelled rows, an ordered list of conjunctions of thresholds: each
rule is grown condition by condition on two thirds of the rows by FOIL gain,
pruned from its end on the other third, and accepted if it is precise there; the
rows it covers leave, and the next rule is grown. The list becomes one
``CASE WHEN`` expression that any DataFrame can carry; no Python runs on rows.

Defined results: a null or empty text has no words, all counts 0, and fails the
base rule; a null label is ignored, several labels of a document count as the
lowest; without labels the list is empty and only the base rule rejects; extra
columns pass through, and the statistics' names win over clashing ones; rows are
judged one by one, so repeated rows are judged alike and rows without an id too;
a text may have as many words as an array has room for; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import let, once, words

#: Characters that count as symbols. Fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bound of the labelled sample that the list is learned from.
MAX_LABELLED = 5000

#: What the rules may test, by name.
FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbol_ratio": "n_symbols / word_chars",
    "exclaim_ratio": "n_exclaims / word_chars",
    "upper_ratio": "n_uppers / word_chars",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
    "distinct_ratio": "n_distinct_words / n_words",
    "n_words": "CAST(n_words AS DOUBLE)",
}


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words(ws: Column) -> Column:
    """Words in windows of WINDOW words that the text holds at least twice."""
    n = F.size(ws)
    window = lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, WINDOW)])
    hashes = F.transform(F.slice(ws, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), window)

    def covered(hs: Column) -> Column:
        by_hash = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))

        def length(p: Column) -> Column:
            step = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))
            return F.aggregate(F.transform(p, step), F.lit(0).cast("bigint"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("bigint")).otherwise(let(let(by_hash, starts), length))

    return let(hashes, covered)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the counts that the rules use."""
    names = ["n_words", "word_chars", "n_symbols", "n_exclaims", "n_uppers", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words"]
    docs = docs.drop(*[c for c in names if c != text])
    t, ws, lines = F.coalesce(F.col(text), F.lit("")), F.col("__words"), F.col("__lines")
    has_word = lambda line: F.rtrim(line, F.lit(" \t\n\x0b\f\r")) != ""
    docs = once(docs, {"__words": words(F.col(text)), "__lines": F.filter(F.split(t, "\n"), has_word)})
    long = lambda c: c.cast("bigint")
    return once(
        docs,
        {
            "n_words": long(F.size(ws)),
            "word_chars": long(F.length(F.array_join(ws, ""))),
            "n_symbols": long(F.length(t) - F.length(_without(t, SYMBOLS))),
            "n_exclaims": long(F.length(t) - F.length(_without(t, "!"))),
            "n_uppers": long(F.regexp_count(t, F.lit(r"\p{Lu}"))),
            "n_lines": long(F.size(lines)),
            "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
            "n_repeat_words": _repeat_words(ws),
            "n_distinct_words": long(F.size(F.array_distinct(ws))),
        },
    ).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    """A feature's value; 0 where its denominator is 0."""
    top, _, bottom = FEATURES[name].partition(" / ")
    return F.expr(f"coalesce(try_divide({top}, {bottom}), 0D)" if bottom else top)


@dataclass(frozen=True)
class Rule:
    """Reject a row if all ``conditions`` (feature, '<=' or '>', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float = 1.0
    covered: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & (feature(name) <= F.lit(cut) if op == "<=" else feature(name) > F.lit(cut))
        return out

    def mask(self, values: dict[str, np.ndarray], size: int) -> np.ndarray:
        out = np.ones(size, bool)
        for name, op, cut in self.conditions:
            out &= values[name] <= cut if op == "<=" else values[name] > cut
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """The number of the first rule that holds, from 1; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), k) if out is None else out.when(rule.column(), k)
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "\n".join("REJECT IF " + " AND ".join(f"{n} {op} {cut:.6g}" for n, op, cut in r.conditions) for r in self.rules)


def _grow(values, bad, rows, cuts, most):
    """Add the condition of the highest FOIL gain until only bad rows are covered."""
    conditions, inside = [], rows.copy()
    while len(conditions) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        before, best = math.log2(p / (p + n)), (0.0, None)
        for name in values:
            v = values[name][inside]
            b = bad[inside]
            for cut in cuts[name]:
                low = v <= cut
                pl, nl = int((low & b).sum()), int((low & ~b).sum())
                for op, p1, n1 in (("<=", pl, nl), (">", p - pl, n - nl)):
                    gain = p1 * (math.log2(p1 / (p1 + n1)) - before) if p1 else 0.0
                    if gain > best[0] + 1e-12:
                        best = (gain, (name, op, float(cut)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).mask(values, len(rows))
    return conditions


def learn(values: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, max_cuts: int = 48) -> DecisionList:
    """Sequential covering. Every third row prunes, the others grow."""
    rules, left = [], np.ones(len(bad), bool)
    prune_row = np.arange(len(bad)) % 3 == 2
    cuts = {}
    for k, v in values.items():
        u = np.unique(v)
        mid = (u[1:] + u[:-1]) / 2
        cuts[k] = mid if len(mid) <= max_cuts else np.unique(np.quantile(mid, np.linspace(0, 1, max_cuts)))
    while len(rules) < max_rules:
        grow, prune = left & ~prune_row, left & prune_row
        conditions = _grow(values, bad, grow, cuts, max_conditions)
        if not conditions:
            break

        def worth(c):
            m = Rule(tuple(c)).mask(values, len(bad)) & prune
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        rule = Rule(tuple(conditions))
        hit = rule.mask(values, len(bad)) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p + 1 < min_precision * (p + n + 2):  # Laplace's estimate: a few rows are no proof
            break
        rules.append(Rule(rule.conditions, p / (p + n), p + n))
        left &= ~hit
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learn from at most ``max_labelled`` labelled documents, chosen by the hash of their id.

    The sample is broadcast to ``docs`` (its bound is the proof of its size), so
    only sampled texts are measured, and only their numbers reach the driver.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(max_labelled)
    )
    joined = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")
    rows = (
        with_statistics(joined)
        .select("__key", (F.col("__quality") == 0).alias("__bad"), base_failed().alias("__base"), *[feature(f).alias(f"f_{f}") for f in FEATURES])
        .where(~F.col("__base"))
        .collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r["__key"]).encode()), r["__key"]))  # the order decides which rows prune
    values = {f: np.array([r[f"f_{f}"] for r in rows], float) for f in FEATURES}
    return learn(values, np.array([r["__bad"] for r in rows], bool))


def assess(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with their statistics, base_failed, rule (the number that fired, or null) and kept."""
    docs = docs.drop("base_failed", "rule", "kept")
    out = with_statistics(docs, text).withColumns({"base_failed": base_failed(), "rule": rules.fired()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
