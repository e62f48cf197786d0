"""Scores of predicted states and behaviours against what happened."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import jaccard, total


def both(pred: Column, truth: Column, score: Column) -> Column:
    """``score`` when both values exist, 1 when both are missing, else 0."""
    return F.when(truth.isNull() & pred.isNull(), 1.0).when(truth.isNull() | pred.isNull(), 0.0).otherwise(score)


def numeric(pred: Column, truth: Column, tolerance: float = 0.1) -> Column:
    """1 within the relative tolerance, then linearly down to 0; a zero must be matched exactly."""
    off = F.abs(pred.cast("double") - truth.cast("double")) / F.abs(truth.cast("double"))
    decay = F.greatest(F.lit(0.0), 1 - (off - tolerance) / tolerance)
    return both(pred, truth, F.when(truth == 0, F.when(pred == 0, 1.0).otherwise(0.0)).when(off <= tolerance, 1.0).otherwise(decay))


def string(pred: Column, truth: Column) -> Column:
    def norm(c):
        return F.trim(F.lower(c.cast("string")))

    return both(pred, truth, F.when(norm(pred) == norm(truth), 1.0).otherwise(0.0))


def categorical(pred: Column, truth: Column) -> Column:
    return both(pred, truth, F.when(F.lower(pred.cast("string")) == F.lower(truth.cast("string")), 1.0).otherwise(0.0))


def flag(pred: Column, truth: Column) -> Column:
    return both(pred, truth, F.when(pred == truth, 1.0).otherwise(0.0))


def set_overlap(pred: Column, truth: Column) -> Column:
    """Jaccard of two string lists, ignoring case; a missing list is an empty one."""

    def norm(c):
        return F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))

    return jaccard(norm(pred), norm(truth))


KINDS: dict[str, Callable[[Column, Column], Column]] = {
    "numeric": numeric, "string": string, "categorical": categorical, "flag": flag, "list": set_overlap,
}


def mean_of(scores: Sequence[Column]) -> Column:
    """Mean of the non-null scores, 0 when there are none."""
    found = total([s.isNotNull().cast("int") for s in scores])
    return F.when(found > 0, total([F.coalesce(s, F.lit(0.0)) for s in scores]) / found).otherwise(0.0)


def with_field_scores(df: DataFrame, fields: Sequence[dict[str, Sequence[str]]], pred: Callable[[str], Column], truth: Callable[[str], Column], known: Sequence[str]) -> tuple[DataFrame, list[list[Column]]]:
    """Scores of every known field as columns, and per field group the columns to average.

    A field that appears in several groups is scored once.
    """
    scores = {f"__s_{f}": KINDS[kind](pred(f), truth(f)) for group in fields for kind, names in group.items() for f in names if f in known}
    groups = [[F.col(f"__s_{f}") for names in group.values() for f in names if f in known] for group in fields]
    return df.withColumns(scores), groups


def split_score(visual: Sequence[Column], context: Sequence[Column], visual_weight: float = 0.7, context_weight: float = 0.3) -> dict[str, Column]:
    v, c = mean_of(visual), mean_of(context)
    return {"visual": v, "context": c, "combined": mean_of([*visual, *context]), "weighted": visual_weight * v + context_weight * c}


def delay_match(model: Column, truth: Column) -> Column:
    gap = F.abs(model - truth)
    return F.when(gap <= 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (gap - 0.2) / 0.3))


def with_alignment(df: DataFrame, model: str, truth: str, name: str = "alignment") -> DataFrame:
    """Agreement of two behaviour structs over the fields both know; utility counts whenever the truth has it."""
    m, t = F.col(model), F.col(truth)

    def both_know(field, score):
        return F.when(m[field].isNotNull() & t[field].isNotNull(), score)

    def same(field):
        return both_know(field, F.when(m[field] == t[field], 1.0).otherwise(0.0))

    empty = F.array().cast("array<string>")
    used = jaccard(F.array_distinct(F.coalesce(m["utility_used"], empty)), F.array_distinct(t["utility_used"]))
    parts = {
        "__a_move": same("movement_direction"),
        "__a_goal": same("objective_direction"),
        "__a_used": F.when(t["utility_used"].isNotNull(), used),
        "__a_start": same("initiated_engagement"),
        "__a_delay": both_know("engagement_delay", delay_match(m["engagement_delay"], t["engagement_delay"])),
    }
    return df.withColumns(parts).withColumn(name, mean_of([F.col(c) for c in parts])).drop(*parts)


def contribution(damage: Column, max_damage: Column, survival: Column, duration: Column, objective: Column) -> Column:
    """Share of a player in the result of the round, in [0, 1]; 0.5 when nothing is known."""
    one = F.lit(1.0)
    dealt = F.least(F.coalesce(damage, F.lit(0.0)) / F.greatest(F.coalesce(max_damage, one), one), one)
    lived = F.least(F.coalesce(survival, F.lit(0.0)) / F.greatest(F.coalesce(duration, one), one), one)
    phi = 0.4 * dealt + 0.3 * lived + 0.3 * F.coalesce(objective, F.lit(False)).cast("double")
    known = F.coalesce(damage, max_damage, survival, duration).isNotNull() | objective.isNotNull()
    return F.when(known, F.least(F.greatest(phi, F.lit(0.0)), one)).otherwise(0.5)


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def modulation(won: Column, phi: Column, agreement: Column) -> Column:
    a, p = _unit(agreement), _unit(phi)
    return _unit(p * F.when(won, 0.5 + 0.5 * a).otherwise(0.5 - 0.3 * a))


def outcome(won: Column, phi: Column, agreement: Column) -> Column:
    """Agreement weighted by result and contribution; plain agreement when the result is unknown."""
    return F.when(won.isNull(), agreement).otherwise(agreement * modulation(won, phi, agreement))


def simple_outcome(won: Column, agreement: Column) -> Column:
    """Rewards agreeing with winners and disagreeing with losers."""
    return F.when(won.isNull() | won, agreement).otherwise(1 - agreement)


class RewardRegistry:
    """Named reward columns with weights; the total is gated by a format column.

    A reward is any ``Callable[[…], Column]``, a ``pandas_udf`` included.
    """

    def __init__(self):
        self._entries: dict[str, tuple[Callable[..., Column], float]] = {}

    def register(self, name: str, fn: Callable[..., Column], weight: float) -> None:
        self._entries[name] = (fn, weight)

    def total(self, gate: Column, *args, **kw) -> Column:
        parts = [w * fn(*args, **kw) for fn, w in self._entries.values()]
        return F.when(gate > 0, gate * sum(parts[1:], parts[0])).otherwise(0.0)


def judge_score(score: Column) -> Column:
    """A judge's score, neutral when missing."""
    return F.coalesce(score, F.lit(0.5))


def squash(x: Column) -> Column:
    """Values already in [0, 1] unchanged, logits through the logistic function."""
    return F.when((x >= 0) & (x <= 1), x).otherwise(1 / (1 + F.exp(-x)))
