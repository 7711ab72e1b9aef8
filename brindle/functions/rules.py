"""Weighted rules as data, compiled to columns here and to SQL for comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import any_of, found


@dataclass(frozen=True)
class Rule:
    """Adds weight if the pattern is found in the field; label names it in results."""

    label: str
    field: str
    pattern: str
    weight: int


def wb(*terms: str) -> str:
    return any_of(list(terms), bounded=True)


def sub(*terms: str) -> str:
    return any_of(list(terms))


def holds(rule: Rule) -> Column:
    return found(F.col(rule.field), rule.pattern)


def findings(rules: list[Rule]) -> Column:
    """Whether each rule holds, as an array: for several of score, labels and first_label to read."""
    return F.array(*[holds(r) for r in rules])


def _held(rules: list[Rule], among: Column | None) -> list[Column]:
    return [holds(r) if among is None else F.get(among, i) for i, r in enumerate(rules)]


def score(rules: list[Rule], among: Column | None = None) -> Column:
    """Sum of the weights of the rules that hold; among: their findings, if they are known."""
    return reduce(lambda a, b: a + b, [F.when(h, r.weight).otherwise(0) for r, h in zip(rules, _held(rules, among))])


def labels(rules: list[Rule], among: Column | None = None) -> Column:
    """Labels of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(h, F.lit(r.label)) for r, h in zip(rules, _held(rules, among))]))


def first_label(rules: list[Rule], otherwise: str | None) -> Column:
    """Label of the first rule that holds."""
    return F.coalesce(*[F.when(holds(r), F.lit(r.label)) for r in rules], F.lit(otherwise))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def score_sql(rules: list[Rule]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({r.field}, {quoted(r.pattern)}) THEN {r.weight} ELSE 0 END" for r in rules)


def labels_sql(rules: list[Rule]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({r.field}, {quoted(r.pattern)}) THEN {quoted(r.label)} END" for r in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def first_label_sql(rules: list[Rule], otherwise: str | None) -> str:
    cases = " ".join(f"WHEN regexp_matches({r.field}, {quoted(r.pattern)}) THEN {quoted(r.label)}" for r in rules)
    return f"CASE {cases} ELSE {quoted(otherwise) if otherwise else 'NULL'} END"
