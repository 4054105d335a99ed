"""Rules that stand for the CHECK, UNIQUE and completeness constraints of the store. They raise; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Names the rules that rows broke, with how many rows broke each."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row (rule, n) per broken rule; a rule whose condition is null counts as broken. One pass over ``df``."""
    counts = [F.count_if(~F.coalesce(cond, F.lit(False))).alias(name) for name, cond in rules.items()]
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules]))
    return df.agg(*counts).select(stacked.alias("x")).select("x.*").where("n > 0")


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    if bad := violations(df, rules).collect():
        raise ValidationError(", ".join(f"{r['rule']}: {r['n']}" for r in sorted(bad, key=lambda r: r["rule"])))
    return df


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand for more than one row; null key parts are equal."""
    return df.groupBy(*key).count().where("count > 1")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    if not duplicates(df, *key).isEmpty():
        raise ValidationError(f"duplicate {', '.join(key)}")
    return df
