"""Keyed tables: upsert, replace, delete. Each gives the new state of the table; the caller writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of `new` replace those of the same key; columns in `keep` stay as they were in the old row.

    `new` has at most one row per key. Columns that only one side has are null on the other.
    """
    keep = keep or []
    kept = old.select(*key, *keep) if keep else None
    fresh = new.drop(*keep).join(kept, key, "left") if kept is not None else new
    return fresh.unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def read_through(wanted: DataFrame, cached: DataFrame, compute, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Results for the wanted keys: cached ones, and computed ones for the rest; also the cache with the new hits."""
    hits = cached.join(wanted.select(*key).distinct(), key, "left_semi")
    made = compute(wanted.join(cached.select(*key), key, "left_anti"))
    found = made.where(F.col("found")) if "found" in made.columns else made
    return hits.unionByName(made, allowMissingColumns=True), cached.unionByName(found, allowMissingColumns=True)
