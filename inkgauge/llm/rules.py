"""Ordered rule lists by incremental reduced-error pruning, and their export to SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    label: str
    conditions: tuple[Condition, ...]

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(columns.values()))), dtype=bool)
        for c in self.conditions:
            out &= c.holds(columns)
        return out


def _best_condition(columns: dict[str, np.ndarray], positive: np.ndarray, covered: np.ndarray) -> Condition | None:
    """The condition of the greatest FOIL gain among the covered rows, or None if none gains."""
    p0, n0 = positive[covered].sum(), (~positive[covered]).sum()
    if not n0 or not p0:
        return None
    base, best, chosen = np.log2(p0 / (p0 + n0)), 1e-9, None
    for feature, values in columns.items():
        v, y = values[covered], positive[covered]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        at = np.flatnonzero(np.diff(v) > 0)  # cuts between different values
        if not len(at):
            continue
        p_low, n_low = np.cumsum(y)[at], np.cumsum(~y)[at]
        for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, chosen = gain[k], Condition(feature, above, float((v[at[k]] + v[at[k] + 1]) / 2))
    return chosen


def _grow(columns: dict[str, np.ndarray], positive: np.ndarray) -> list[Condition]:
    covered, conditions = np.ones(len(positive), dtype=bool), []
    while (~positive[covered]).any():
        condition = _best_condition(columns, positive, covered)
        if condition is None:
            break
        conditions.append(condition)
        covered &= condition.holds(columns)
    return conditions


def _worth(conditions: list[Condition], columns: dict[str, np.ndarray], positive: np.ndarray) -> tuple[float, float]:
    covered = Rule("", tuple(conditions)).holds(columns)
    p, n = positive[covered].sum(), (~positive[covered]).sum()
    return ((p - n) / (p + n) if p + n else -1.0), p / max(1, p + n)


def learn(columns: dict[str, np.ndarray], labels: np.ndarray, order: tuple[str, ...], seed: int = 1) -> list[Rule]:
    """Rules for the labels of order, the first first; what no rule covers has no label.

    For each label: a rule is grown on two thirds of the rows that are left until it covers none of another label, cut
    back from its end to what is worth most on the other third, and kept while it is right there more often than not. Rows
    that a rule covers are taken out before the next.
    """
    rng = np.random.default_rng(seed)
    columns = {k: np.asarray(v, dtype=float) for k, v in columns.items()}
    labels = np.asarray(labels)
    left = np.ones(len(labels), dtype=bool)
    rules: list[Rule] = []
    for label in order:
        while (labels[left] == label).any():
            rows = rng.permutation(np.flatnonzero(left))
            positive = labels[rows] == label
            third = np.zeros(len(rows), dtype=bool)
            for side in (positive, ~positive):  # one third of either side
                third[np.flatnonzero(side)[::3]] = True
            part = lambda mask: ({k: v[rows[mask]] for k, v in columns.items()}, positive[mask])  # noqa: E731, B023
            conditions = _grow(*part(~third))
            if not conditions:
                break
            kept = max(range(1, len(conditions) + 1), key=lambda k: (_worth(conditions[:k], *part(third))[0], -k))
            conditions = conditions[:kept]
            if _worth(conditions, *part(third))[1] <= 0.5:
                break
            rule = Rule(label, tuple(conditions))
            rules.append(rule)
            left &= ~rule.holds(columns)
    return rules


def apply(rules: list[Rule], columns: dict[str, np.ndarray]) -> np.ndarray:
    """Labels by the first rule that holds, None without one; the counterpart of to_sql() for tests."""
    out = np.full(len(next(iter(columns.values()))), None, dtype=object)
    for rule in reversed(rules):
        out[rule.holds(columns)] = rule.label
    return out


def to_sql(rules: list[Rule]) -> str:
    """A CASE expression over columns named like the features."""
    if not rules:
        return "CAST(NULL AS STRING)"
    cases = (f"WHEN {' AND '.join(c.sql() for c in rule.conditions)} THEN '{rule.label}'" for rule in rules)
    return f"CASE {' '.join(cases)} END"
