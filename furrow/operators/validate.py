"""Checks of constraints over tables; every check is one row with how many rows it saw and how many break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(name: str, checked: DataFrame, broken: DataFrame) -> DataFrame:
    return checked.join(broken, how="inner", on=F.lit(True)).select(F.lit(name).alias("check_name"), "checked_rows", "violations")


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], name: str) -> DataFrame:
    """Rows whose key is complete but meets no parent row. Keys with a null are not checked against the parent."""
    full = child.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])
    whole = None
    for i in range(len(columns)):
        test = F.col(f"k{i}").isNotNull()
        whole = test if whole is None else whole & test
    keys = parent.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(parent_columns)])
    same = None
    for i in range(len(columns)):
        test = F.col(f"k{i}") == F.col(f"p{i}")
        same = test if same is None else same & test
    broken = full.filter(whole).join(keys, same, "left_anti")
    return _said(name, _counted(full, "checked_rows"), _counted(broken, "violations"))


def duplicates(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each key; keys with a null are all different."""
    keyed = df.select(*columns).dropna("any")
    groups = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("violations"))
    return _said(name, _counted(df, "checked_rows"), groups)


def breaks(df: DataFrame, allowed: Column, name: str) -> DataFrame:
    """Rows for which a check is false; null passes, as in SQL."""
    return df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("checked_rows"), F.count(F.when(~allowed, 1)).alias("violations"))


def outside(df: DataFrame, column: str, values: list, name: str) -> DataFrame:
    """Rows whose value is not among those allowed; null passes."""
    return breaks(df, F.col(column).isin(*values), name)


def nulls(df: DataFrame, column: str, name: str) -> DataFrame:
    return breaks(df, F.col(column).isNotNull(), name)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, repeats counted."""
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)
