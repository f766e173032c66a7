"""Chains of projections written once: as DataFrame steps for Spark and as nested selects for the SQL check.

The scalar functions used in them (sin, atan2, floor, pow, ...) mean the same in both; angles are reduced by floor, which
unlike % never keeps a sign. Each step sees the columns of the ones before, so Catalyst evaluates a shared term once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

Steps = list[dict[str, str]]


def with_steps(df: DataFrame, steps: Steps) -> DataFrame:
    for step in steps:
        df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in step.items()))
    return df


def sql_steps(source: str, steps: Steps) -> str:
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source})"
    return source


def mod360(x: str) -> str:
    return f"(({x}) - 360.0 * floor(({x}) / 360.0))"


def wrap180(x: str) -> str:
    return f"({mod360(f'({x}) + 180.0')} - 180.0)"


def number(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"
