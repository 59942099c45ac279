"""Declarative rules compiled to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> tuple[Column, Column]:
    """(outcome, index from 1) of the first rule that holds; the default has the index behind the last."""
    outcome = reduce(lambda later, r: F.when(r[0], F.lit(r[1])).otherwise(later), reversed(rules), F.lit(default).cast("string"))
    index = reduce(lambda later, k: F.when(rules[k][0], F.lit(k + 1)).otherwise(later), reversed(range(len(rules))), F.lit(len(rules) + 1))
    return outcome, index


def banded(value: Column, bands: list[tuple[float | None, str]]) -> Column:
    """The first band whose upper limit the value does not pass (limits inclusive; None has no limit); null stays null."""
    return first_match([(value.isNotNull() if top is None else value <= top, name) for top, name in bands])[0]


def handling_class(mass: Column, longest: Column, bands: list[tuple[float | None, str]], beyond: float, override: str) -> Column:
    """Bands by mass, overridden for pieces strictly longer than `beyond`; a null mass gives null."""
    return F.when(mass.isNull(), F.lit(None).cast("string")).when(longest > beyond, override).otherwise(banded(mass, bands))


def reason(name: str, index: Column, *tests: tuple[str, Column]) -> Column:
    """Provenance `name#index: test=value, ...`, in the order of the tests; null values are left out."""
    parts = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in tests]
    return F.concat(F.lit(f"{name}#"), index.cast("string"), F.lit(": "), F.concat_ws(", ", *parts))
