"""Comparing policies and configurations over tables of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saltmarsh.operators.policy import ActionPolicy, decide

ATTRIBUTES = ("type", "detector", "confidence", "action", "obfuscation")


def compare_policies(findings: DataFrame, policies: dict[str, ActionPolicy | None]) -> DataFrame:
    """One to four policies over the same findings: a row for each finding and policy.

    All policies decide in one projection, so detection and the findings' scan happen once.
    """
    if not 1 <= len(policies) <= 4:
        raise ValueError("one to four policies are compared")
    sides = F.array(*[F.struct(F.lit(name).alias("policy"), decide(p, F.struct("*")).alias("d")) for name, p in policies.items()])
    keys = [c for c in findings.columns if c != "action"]
    return findings.select(*keys, F.explode(sides).alias("_s")).select(*keys, F.col("_s.policy").alias("policy"), "_s.d.*")


def action_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("policy", "action").agg(F.count(F.lit(1)).alias("n"))


def changed(compared: DataFrame, keys: list[str], base: str) -> DataFrame:
    """How many findings each other policy decides differently from ``base``."""
    own = F.max(F.when(F.col("policy") == base, F.col("action"))).over(W.partitionBy(*keys))
    return compared.withColumn("_b", own).where(F.col("policy") != base).groupBy("policy").agg(F.sum((F.col("action") != F.col("_b")).cast("long")).alias("changed"))


def clusters(findings: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``findings`` with ``cluster``: numbers from 1 in each ``key`` of ranges that overlap one another in turn."""
    by = W.partitionBy(key).orderBy(start, end)
    reached = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (reached <= F.col(start)), 1).otherwise(0)
    return findings.withColumn("_o", opens).withColumn("cluster", F.sum("_o").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_o")


def compare_configurations(base: DataFrame, other: DataFrame, key: str, errors: DataFrame | None = None) -> DataFrame:
    """How findings of two configurations relate: a row for each cluster of overlapping ranges.

    ``relation``: added, removed, unchanged, changed, split, merged or regrouped; with the
    numbers of findings on each side and ``changes``, the attributes that differ where one
    finding stands against one. Texts in ``errors`` (by ``key``) failed on a side and are
    never compared.
    """
    both = reduce(DataFrame.unionByName, [d.select(key, "start", "end", *ATTRIBUTES, F.lit(n).alias("_side")) for n, d in ((0, base), (1, other))])
    if errors is not None:
        both = both.join(errors.select(key).distinct(), key, "left_anti")
    side = lambda n: F.sum((F.col("_side") == n).cast("int"))
    one = lambda n, c: F.min(F.when(F.col("_side") == n, F.col(c)))
    columns = ("start", "end", *ATTRIBUTES)
    joined = clusters(both, key).groupBy(key, "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), side(0).alias("n_base"), side(1).alias("n_other"), *[one(n, c).alias(f"_{n}{c}") for n in (0, 1) for c in columns])
    moved = F.when((F.col("_0start") != F.col("_1start")) | (F.col("_0end") != F.col("_1end")), "range")
    differ = F.array_compact(F.array(moved, *[F.when(~F.col(f"_0{c}").eqNullSafe(F.col(f"_1{c}")), c) for c in ATTRIBUTES]))
    single = (F.col("n_base") == 1) & (F.col("n_other") == 1)
    relation = (
        F.when(F.col("n_base") == 0, "added").when(F.col("n_other") == 0, "removed").when(single & (F.size(differ) == 0), "unchanged").when(single, "changed")
        .when(F.col("n_base") == 1, "split").when(F.col("n_other") == 1, "merged").otherwise("regrouped")
    )
    return joined.select(key, "cluster", "start", "end", "n_base", "n_other", relation.alias("relation"), F.when(single, F.array_join(differ, ",")).otherwise("").alias("changes"))


def number_request(parts: DataFrame, request: str, part: str, replaced: str) -> DataFrame:
    """``parts`` with ``offset``, how many placeholders earlier parts of a request have used."""
    before = W.partitionBy(request).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(replaced).over(before), F.lit(0)))
