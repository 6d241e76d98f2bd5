"""Quality rules: a decision list learned by sequential covering, applied as Spark conditions.

Statistics of whole texts are Spark expressions. A bounded sample of labels
(``max_labelled``, chosen by a hash of the key over all labels) is broadcast
to the documents; one row for each of them goes to the driver, where rules for
the bad class are grown condition by condition on two thirds and pruned on the
rest. The list becomes an ordered CASE WHEN: the first rule that fits decides,
in the same pass that takes the statistics. Nothing is kept in between.

Defined results: a null or empty text has no words and fails the base; texts
of any length are read whole; repeated rows are judged alike, also with a null
doc_id; of labelled rows that repeat a doc_id the learner sees one, the least
by its statistics; labels that repeat count once, the lowest quality standing;
ties between conditions go to the first feature by name and then the lowest
threshold; an empty table gives an empty result; without labels of both
classes the list is empty and only the base decides; columns outside ``keep``
are ignored, and a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import WHITE, computed, packed

SPLIT = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MAX_LABELLED = 20_000


COUNTS = (*BASE, "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
RESULT = (*COUNTS, "base_failed", "rule", "kept")


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``_kept`` (the columns of ``keep`` as a struct), the base counts and the counts that only the learner uses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(packed(keep, RESULT).alias("_kept"), text.alias("_t"))
    inner = F.trim("_t", F.lit(WHITE))
    rows = computed(
        rows, ("_kept", "_t"),
        _w=F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT, -1)),
        _l=F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != ""),
    )
    n = F.size("_w")
    # equal three-word windows stand side by side once sorted
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))
    rows = computed(rows, ("_kept", "_t", "_w", "_l"), _s=F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    again = F.filter("_s", lambda x, k: (F.get("_s", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("_s", F.greatest(k - 1, F.lit(0)))["h"] == x["h"])))
    rows = computed(rows, ("_kept", "_t", "_w", "_l"), _r=F.sort_array(F.transform(again, lambda x: x["i"])))
    # each repeated window covers three words, fewer where the next begins sooner
    covered = F.aggregate(F.transform("_r", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_r", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def without(chars: str) -> Column:
        return F.length(F.translate(F.col("_t"), chars, ""))

    counts = {
        "n_words": F.size("_w"),
        "word_chars": without(WHITE),
        "n_symbols": F.length("_t") - without("#*$%&|<>"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": covered,
        "n_lines": F.size("_l"),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_upper": F.length("_t") - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": F.length("_t") - without("0123456789"),
        "n_marks": F.length("_t") - without("!?.,;:"),
    }
    return computed(rows, ("_kept",), **{k: c.cast("long") for k, c in counts.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "same_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "distinct": F.col("n_distinct") / words,
        "upper": F.col("n_upper") / chars,
        "digits": F.col("n_digits") / chars,
        "marks": F.col("n_marks") / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.threshold if self.above else f <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    """Conditions by FOIL's gain until no good row is covered or none gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for name, all_values in sorted(x.items()):
            values, y = all_values[inside], bad[inside]
            points = np.unique(np.quantile(values, np.linspace(0, 1, cuts + 2)))
            for t in (points[1:] + points[:-1]) / 2:
                high = values > t
                for above in (True, False):
                    side = high if above else ~high
                    p, n = y[side].sum(), (~y[side]).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, above, float(t)), g
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, cuts: int = 64, least_precision: float = 0.9, least_rows: int = 3) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on one third, keep precise rules, drop the rows they cover, repeat."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.arange(len(bad)) % 3
    while len(rules) < max_rules and bad[left].any():
        grow, prune = left & (part < 2), left & (part == 2)
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], max_conditions, cuts)
        if not rule:
            break
        y = bad[prune]
        held = {k: v[prune] for k, v in x.items()}

        def worth(r: Rule, held=held, y=y) -> float:
            inside = _covers(r, held, len(y))
            p, n = y[inside].sum(), (~y[inside]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        inside = _covers(rule, x, len(bad)) & left
        if inside.sum() < least_rows or bad[inside].mean() < least_precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def decision(rules: list[Rule]) -> Column:
    """CASE WHEN in order: the number (from 1) of the first rule that fits, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn from at most about ``max_labelled`` labelled documents, chosen by hash; a row for each of them reaches the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 48)) < (max_labelled << 48) // n)
    names = list(features())
    known = known.select(F.col("doc_id").alias("_id"), "quality")
    some = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = statistics(some, ("_id", "quality")).where(~base_failed())
    one = F.min(F.struct(F.col("_kept.quality").alias("quality"), *(c.alias(f"f_{k}") for k, c in features().items()))).alias("x")
    rows = rows.groupBy(F.col("_kept._id").alias("_id")).agg(one).select("_id", "x.*").toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    bad = rows["quality"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    order = np.random.default_rng(7).permutation(len(rows))
    return learn({k: rows[f"f_{k}"].to_numpy(float)[order] for k in names}, bad[order])


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``keep``, the base counts, base_failed, rule (0: none) and kept."""
    rules = fit(docs, labels, max_labelled)
    rows = computed(statistics(docs, keep), ("_kept", *BASE), base_failed=base_failed(), rule=decision(rules))
    return rows.select("_kept.*", *BASE, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
