"""Runs that a user has excluded: sets of ids, and the documents that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT = r'"excluded":\s*\[[^\]]*\]'


def sorted_ids(run: Column) -> Column:
    """An aggregate: the distinct ids in order."""
    return F.array_sort(F.collect_set(run))


def union(stored: DataFrame, given: DataFrame) -> DataFrame:
    """The rows of both, each once."""
    return stored.unionByName(given).distinct()


def toggled(ids: Column, run: Column) -> Column:
    """An array of ids without run if it was there, and else with it."""
    return F.when(F.array_contains(ids, run), F.array_remove(ids, run)).otherwise(F.array_append(ids, run))


def persisted(document: Column, ids: Column) -> Column:
    """A JSON document with another list of excluded runs, sorted, and all else as it was."""
    entry = F.concat(F.lit('"excluded":['), F.array_join(F.array_sort(F.array_distinct(ids)).cast("array<string>"), ","), F.lit("]"))
    return F.when(document.rlike(KEPT), F.regexp_replace(document, F.lit(KEPT), entry)).otherwise(F.regexp_replace(document, F.lit(r"^\s*\{"), F.concat(F.lit("{"), entry, F.lit(","))))


def read(document: Column) -> Column:
    """The excluded runs of a JSON document; empty if it names none."""
    return F.coalesce(F.from_json(document, "struct<excluded:array<int>>")["excluded"], F.array().cast("array<int>"))
