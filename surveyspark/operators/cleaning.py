"""Cleaning as data: rules over coded columns, applied as one conjunction.

A rule keeps an allow-list of codes (nulls dropped) or drops a deny-list
(nulls kept, as a frame filter would). The rule list is applied as a single
filter so Catalyst can push every conjunct into the scan, and the row funnel
(rows left after each successive rule) comes from one aggregation pass
instead of one count per step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import drop_codes, keep_codes


@dataclass(frozen=True)
class Rule:
    column: str
    action: str                 # "keep" (allow-list) or "drop" (deny-list)
    codes: tuple
    keep_null: bool = True      # only for "drop": keep missing values

    def predicate(self) -> Column:
        if self.action == "keep":
            return keep_codes(self.column, self.codes)
        if self.action == "drop":
            return drop_codes(self.column, self.codes, keep_null=self.keep_null)
        raise ValueError(f"unknown rule action {self.action!r}")

    def describe(self) -> str:
        codes = ",".join(str(c) for c in self.codes)
        return f"{self.column} {self.action} [{codes}]"


def keep(column: str, *codes) -> Rule:
    return Rule(column, "keep", tuple(codes))


def drop(column: str, *codes, keep_null: bool = True) -> Rule:
    return Rule(column, "drop", tuple(codes), keep_null)


def conjunction(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a & b, [r.predicate() for r in rules], F.lit(True))


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return df.where(conjunction(rules)) if rules else df


def clean(df: DataFrame, rules: Sequence[Rule], columns: Sequence[str] | None = None) -> DataFrame:
    out = apply_rules(df, rules)
    return out.select(*columns) if columns else out


def drop_sentinel(df: DataFrame, column: str, value, keep_null: bool = True) -> DataFrame:
    """Drop rows equal to one sentinel; missing values kept unless told otherwise."""
    return apply_rules(df, [Rule(column, "drop", (value,), keep_null)])


def cleaning_funnel(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(step, rule, rows_left)``: step 0 is the input, step i the rows that
    pass rules 1..i. One scan, one ``count_if`` per prefix of the rule list."""
    prefixes, acc = [], F.lit(True)
    for r in rules:
        acc = acc & r.predicate()
        prefixes.append(acc)
    structs = [F.struct(F.lit(0).alias("step"), F.lit("input").alias("rule"),
                        F.count(F.lit(1)).alias("rows_left"))]
    structs += [F.struct(F.lit(i + 1).alias("step"), F.lit(r.describe()).alias("rule"),
                         F.count_if(p).alias("rows_left"))
                for i, (r, p) in enumerate(zip(rules, prefixes))]
    return df.agg(F.array(*structs).alias("f")).select(F.inline("f"))
