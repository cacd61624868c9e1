"""Quality rules: text statistics in Spark expressions, and a decision list learned from labelled statistics.

Learning is sequential covering. Each rule is a conjunction of thresholds on the statistics. It is grown on two thirds
of the labelled rows by FOIL gain, pruned on the rest, kept if its precision there holds, and the rows it covers are
taken away before the next rule is sought. Labelled rows are first counted by Spark into cells of equal threshold
outcomes; only these counts reach the driver, at most `max_labelled` of them (the bound of the sample of labelled rows,
taken by hash of the id; 200,000 unless said otherwise). The list is emitted as one ordered `CASE WHEN` expression.
Its size is a parameter of the method: at most `max_rules` rules (12) of at most `max_conditions` conditions (4), each of
a precision of at least `precision` (0.97) on `min_rows` (4) bad rows or more; as many tries without such a rule end it.

Defined cases: a null text has no words and fails the base rule. Without labels, or with labels of one class only, the
list is empty and the base rule decides alone. Null or unmatched label ids and null labels are not learned from. Several
labels for one id each count. Repeated rows are judged one by one. Very long texts are counted whole. Of equal gains the
condition first in the order of features and thresholds is taken. Rows of an empty table: none. Columns of df with the
names of the statistics are replaced; the dropping form leaves all columns as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; grams: hashes in text order."""
    placed = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p")))
    twins = let(
        F.sort_array(placed),
        lambda s: F.filter(s, lambda x, i: x["g"].eqNullSafe(F.get(s, i - 1)["g"]) | x["g"].eqNullSafe(F.get(s, i + 1)["g"])),
    )
    gains = let(
        F.sort_array(F.transform(twins, lambda x: x["p"])),
        lambda q: F.transform(q, lambda p, i: F.least(F.lit(5), F.coalesce(F.get(q, i + 1) - p, F.lit(5)))),
    )
    return F.aggregate(gains, F.lit(0).cast("long"), lambda a, x: a + x)


def text_statistics(df: DataFrame, text_col: str = "text", prefix: str = "q_") -> DataFrame:
    """df with the columns of STATS, each under `prefix`, and prefix + base_failed. Existing columns of these names are replaced."""
    p = prefix
    text = F.coalesce(df[text_col], F.lit(""))
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    hashes, grams = F.col(f"{p}hashes"), F.col(f"{p}grams")
    out = df.withColumns(
        {
            f"{p}words": F.filter(F.split(text, SPACE), lambda w: w != ""),
            f"{p}lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            f"{p}n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            f"{p}n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            f"{p}n_marks": F.regexp_count(text, F.lit(r"[!?]")).cast("long"),
        }
    )
    out = out.withColumns(
        {
            f"{p}n_words": F.size(words).cast("long"),
            f"{p}word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
            f"{p}n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            f"{p}hashes": F.transform(words, lambda w: F.xxhash64(w)),
        }
    )
    out = out.withColumn(
        f"{p}grams",
        F.when(
            F.size(hashes) >= 5,
            F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(5)))),
        ),
    )
    out = out.withColumn(
        f"{p}n_repeat_words",
        F.when(F.size(F.array_distinct(grams)) < F.size(grams), _repeated_words(grams)).otherwise(F.lit(0)).cast("long"),
    )
    n, repeated = F.col(f"{p}n_words"), F.col(f"{p}n_repeat_words")
    out = out.withColumn(f"{p}base_failed", (n < 10) | (100 * repeated > 20 * n))
    return out.drop(*(f"{p}{x}" for x in ("words", "lines", "hashes", "grams")))


def features(prefix: str = "q_") -> dict[str, Column]:
    """The quantities that the thresholds of a rule are on."""
    c = {x: F.col(f"{prefix}{x}").cast("double") for x in STATS}
    chars, words = F.greatest(c["word_chars"], F.lit(1.0)), F.greatest(c["n_words"], F.lit(1.0))
    return {
        "words": c["n_words"],
        "word_length": c["word_chars"] / words,
        "symbol_share": c["n_symbols"] / chars,
        "upper_share": c["n_upper"] / chars,
        "mark_share": c["n_marks"] / chars,
        "repeat_share": c["n_repeat_words"] / words,
        "duplicate_lines": c["n_dup_lines"],
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    threshold: float
    at_least: bool

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.threshold if self.at_least else values[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def labelled_cells(stats: DataFrame, marks: DataFrame, max_labelled: int, points: tuple[float, ...]) -> tuple[list[str], dict[str, list[float]], list]:
    """Thresholds by feature, and counts of labelled rows by outcome of all thresholds, part (2 of 3 grow, 1 prunes) and label.

    stats: id and the feature columns; marks: id and bad (boolean).
    """
    names = list(features())
    picked = (
        stats.join(marks, stats["id"] == marks["mark_id"])
        .filter("bad is not null")
        .select("bad", *names, F.crc32(F.concat_ws(":", F.lit("rules"), stats["id"]).cast("binary")).alias("draw"))
        .orderBy("draw", *names, "bad")
        .limit(max_labelled)
    )
    picked = materialize(picked, "labelled")
    asked = [F.percentile_approx(F.when(F.col("bad") == side, F.col(f)), list(points), 10_000).alias(f"{f}:{side}") for f in names for side in (True, False)]
    quantiles = picked.agg(*asked).first()
    cuts = {f: sorted({float(x) for side in (True, False) for x in quantiles[f"{f}:{side}"] or []}) for f in names}
    place = [sum((F.when(F.col(f) >= t, 1).otherwise(0) for t in cuts[f]), F.lit(0)).alias(f) for f in names]
    cells = picked.select(*place, (F.col("draw") % 3 == 0).alias("prune"), "bad").groupBy(*names, "prune").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    return names, cuts, cells.collect()


def learn_decision_list(
    names: list[str], cuts: dict[str, list[float]], cells: list, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.97, min_rows: int = 4
) -> list[Rule]:
    """Ordered rules that mark bad rows, from the counted cells."""
    if not cells:
        return []
    place = np.array([[c[f] for f in names] for c in cells])
    bad, good = (np.array([c[k] for c in cells], float) for k in ("bad", "good"))
    prune = np.array([c["prune"] for c in cells])
    tests = [(Condition(f, t, up), (place[:, j] > k) == up) for j, f in enumerate(names) for k, t in enumerate(cuts[f]) for up in (True, False)]
    left, rules, tries = np.ones(len(cells), bool), [], max_rules

    def counts(rows: np.ndarray) -> tuple[float, float]:
        return bad[rows].sum(), good[rows].sum()

    while len(rules) < max_rules and counts(left & ~prune)[0]:
        inside, grown = left & ~prune, []
        while len(grown) < max_conditions and counts(inside)[1]:
            p0, n0 = counts(inside)
            best = max(tests, key=lambda t: _gain(p0, n0, *counts(inside & t[1])), default=None)
            if best is None or _gain(p0, n0, *counts(inside & best[1])) <= 0:
                break
            grown.append(best)
            inside = inside & best[1]
        while len(grown) > 1:  # prune: drop a final run of conditions while that doesn't hurt on the other part
            worth = [_worth(*counts(_all(left & prune, grown[:k]))) for k in range(1, len(grown) + 1)]
            k = int(np.argmax(worth)) + 1
            if k == len(grown):
                break
            grown = grown[:k]
        covered = _all(left, grown)
        p, n = counts(covered & prune)
        everywhere = counts(covered)
        left = left & ~covered
        if everywhere[0] >= min_rows and everywhere[0] >= precision * sum(everywhere) and p >= precision * (p + n):
            rules.append(tuple(c for c, _ in grown))
        elif not grown or tries == 0:
            break
        else:
            tries -= 1
    return rules


def _all(rows: np.ndarray, tests: list) -> np.ndarray:
    for _, hit in tests:
        rows = rows & hit
    return rows


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _worth(p: float, n: float) -> float:
    return (p - n) / (p + n) if p + n else -1.0


def list_expression(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Number of the first rule that fires, from 1; null where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        fires = rule[0].column(values)
        for condition in rule[1:]:
            fires = fires & condition.column(values)
        out = F.when(fires, k) if out is None else out.when(fires, k)
    return F.lit(None).cast("int") if out is None else out


def learn_rules(
    stats: DataFrame, marks: DataFrame, max_labelled: int = 200_000, points: tuple[float, ...] = (0.02, 0.1, 0.5, 0.9, 0.98), **limits
) -> list[Rule]:
    """Rules for rows that pass the base rule, from statistics (column id, STATS under q_) and marks (mark_id, bad)."""
    values = stats.filter("not q_base_failed").select("id", *(c.alias(f) for f, c in features().items()))
    return learn_decision_list(*labelled_cells(values, marks, max_labelled, points), **limits)


def marks_of(labels: DataFrame, id_col: str) -> DataFrame:
    return labels.select(labels[id_col].alias("mark_id"), (labels["quality"] == 0).alias("bad"))


def quality_decisions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row for each row of docs: id, q_ statistics, q_base_failed, q_rule (number of the firing rule), q_kept."""
    bare = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    stats = materialize(text_statistics(bare).drop("text"), "statistics")
    rules = learn_rules(stats, marks_of(labels, id_col), **limits)
    return stats.withColumn("q_rule", list_expression(rules, features())).withColumn(
        "q_kept", ~F.col("q_base_failed") & F.col("q_rule").isNull()
    )


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay.

    The rows are written once with their statistics beside them, so that each row carries its own verdict, whatever its id.
    """
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    held = materialize(text_statistics(docs, text_col, prefix), "judged")
    names = [*STATS, "base_failed"]
    stats = held.select(held[id_col].alias("id"), *(F.col(f"{prefix}{x}").alias(f"q_{x}") for x in names))
    rules = learn_rules(stats, marks_of(labels, id_col), **limits)
    return held.filter(~F.col(f"{prefix}base_failed") & list_expression(rules, features(prefix)).isNull()).select(*docs.columns)
