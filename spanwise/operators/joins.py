"""Key joins. Spark chooses broadcast, hash or merge by the sizes it sees; nothing here forces one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str) -> DataFrame:
    """Rows of probe with the row of build that they refer to; build's key is unique, so no row is multiplied."""
    return probe.join(build, F.col(probe_key) == F.col(build_key))


def flagged_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, flag: Column, name: str) -> DataFrame:
    """Key join in which `name` says whether the build row fulfils flag."""
    return key_join(probe, build.withColumn(name, F.coalesce(flag, F.lit(False))), probe_key, build_key)


def star_join(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """A chain of key joins: (dimension, key on the left, key of the dimension)."""
    for dimension, left, right in dimensions:
        fact = key_join(fact, dimension, left, right)
    return fact


def in_role(dimension: DataFrame, role: str) -> DataFrame:
    """A dimension with its columns prefixed, to join it in more than one role."""
    return dimension.select(*(F.col(c).alias(f"{role}_{c}") for c in dimension.columns))


def branches_join(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, branches: list[Column]) -> DataFrame:
    """One key join for a disjunction of conditions on both sides; a row that fulfils several branches counts once."""
    any_branch = branches[0]
    for b in branches[1:]:
        any_branch = any_branch | b
    return key_join(probe, build, probe_key, build_key).filter(any_branch)


def exists_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str) -> DataFrame:
    """Rows of outer for which inner has one at least."""
    return outer.join(inner, F.col(outer_key) == F.col(inner_key), "left_semi")
