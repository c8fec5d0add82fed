"""Correctness checks as columns. Each takes the generated text and the gold answer."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefork.functions.arrays import let

# Fixed patterns (the answer conventions the checks are defined by).
BOXED_PATTERN = r"\\boxed\{([^}]*)\}"
NUMBER_PATTERN = r"-?\d[\d,]*\.?\d*"

CorrectnessColumn = Callable[[Column, Column], Column]


def strip(text: Column) -> Column:
    """Strip all leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def exact_match(text: Column, gold: Column) -> Column:
    return F.coalesce(F.contains(text, strip(gold)), F.lit(False))


def _last_number(text: Column) -> Column:
    return let(
        F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, F.replace(F.element_at(found, -1), F.lit(","), F.lit(""))),
    )


def extract_number(text: Column) -> Column:
    """Last number of the last box if it holds one, else the last number of the text."""
    boxed = let(
        F.regexp_extract_all(text, F.lit(BOXED_PATTERN), F.lit(1)),
        lambda boxes: F.when(F.size(boxes) > 0, _last_number(F.element_at(boxes, -1))),
    )
    return F.coalesce(boxed, _last_number(text))


def numeric_answer(text: Column, gold: Column) -> Column:
    def same(pred: Column, want: Column) -> Column:
        a, b = pred.try_cast("double"), want.try_cast("double")
        return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < 1e-6).otherwise(pred == want)

    wanted = F.coalesce(extract_number(gold), strip(gold))
    found = let(extract_number(text), lambda pred: let(wanted, lambda want: same(pred, want)))
    return F.coalesce(found, F.lit(False))


def regex(pattern: str) -> CorrectnessColumn:
    """Search for ``pattern``; compare the first group (or the match) with gold, if there is gold."""
    group = 1 if re.compile(pattern).groups else 0

    def check(text: Column, gold: Column) -> Column:
        hit = text.rlike(pattern)
        captured = strip(F.regexp_extract(text, pattern, group))
        return F.coalesce(hit & F.when(gold.isNull(), F.lit(True)).otherwise(captured == strip(gold)), F.lit(False))

    return check


def python_problem_check(fn: Callable[[dict, str], bool]) -> CorrectnessColumn:
    """Wrap a Python ``fn(problem, text) -> bool`` that sees the whole problem, not its answer alone.

    Where the problems come from a file, that is the object of their line with ``problem_id`` and ``prompt`` as loaded:
    keys that no schema lists are there under their names, with the types that they have in the file.
    """

    def whole(problem: str | None) -> dict:
        columns = json.loads(problem) if problem else {}
        raw, _ = columns.pop("raw", None), columns.pop("extra", None)
        return {**json.loads(raw), **{k: columns[k] for k in ("problem_id", "prompt") if k in columns}} if raw else columns

    def run(text: pd.Series, problem: pd.Series) -> pd.Series:
        return pd.Series([bool(fn(whole(p), t or "")) for t, p in zip(text, problem)])

    def check(text: Column, problem: Column) -> Column:
        return F.pandas_udf(run, "boolean")(text, problem)

    check.whole_problem = True
    return check


def python_check(fn: Callable[[dict, str], bool], answer_key: str = "answer") -> CorrectnessColumn:
    """Wrap a Python ``fn(problem, text) -> bool`` for checks that no column expression can state."""

    def run(text: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series(
            [bool(fn({} if g is None else {answer_key: g}, "" if t is None else t)) for t, g in zip(text, gold)]
        )

    def check(text: Column, gold: Column) -> Column:
        return F.pandas_udf(run, "boolean")(text, gold)

    return check
