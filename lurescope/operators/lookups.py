"""Joins with knowledge tables, which are parameters and never baked into expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescope.runtime import small


def listed(rows: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    return rows.join(small(dimension), column, "left_semi")


def unlisted(rows: DataFrame, dimension: DataFrame, column: str) -> DataFrame:
    return rows.join(small(dimension), column, "left_anti")


def by_suffix(rows: DataFrame, dimension: DataFrame, host: str = "host", suffix: str = "suffix") -> DataFrame:
    """rows with the suffixes of the dimension that their host has at a label's boundary: an equi-join on exploded suffixes."""
    labels = F.split(F.col(host), r"\.")
    each = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return rows.withColumn(suffix, F.explode(each)).join(small(dimension), suffix)


def by_prefix(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """rows whose host is the dimension's and whose path starts with its prefix."""
    return rows.join(small(dimension), "host").where(F.col("path").startswith(F.col("prefix")))


def containing(rows: DataFrame, phrases: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """(rows, category): the categories of which the lower-cased text holds a phrase; one scan, no join."""
    lowered = F.lower(F.col(text))
    categories: dict[str, list[str]] = {}
    for category, phrase in phrases:
        categories.setdefault(category, []).append(phrase)
    tests = []
    for category, found in categories.items():
        test = F.lit(False)
        for phrase in found:
            test = test | F.contains(lowered, F.lit(phrase.lower()))
        tests.append(F.when(test, F.lit(category)))
    return rows.withColumn("category", F.explode(F.array_compact(F.array(*tests))))


def lookalikes(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """(label, brand, method) of domain labels near a brand: equal, joined with other words, or one edit or swap apart.

    Distinct labels are joined on keys that any such pair shares: the label and its deletions of one character, and
    whole tokens. So no pair of all labels with all brands is made.
    """
    distinct = labels.select("label").where(F.length("label") >= 4).distinct()
    tokens = distinct.select("label", F.explode(F.split("label", "-")).alias("brand")).where("brand <> label")
    combo = tokens.join(small(brands), "brand").select("label", "brand", F.lit("combosquat").alias("method"))
    near = _deletions(distinct, "label").join(small(_deletions(brands.where(F.length("brand") >= 6), "brand")), "_key").select("label", "brand").distinct()
    edit = F.levenshtein("label", "brand", 1) == 1
    same = F.length("label") == F.length("brand")
    differ = F.filter(F.sequence(F.lit(1), F.length("label")), lambda i: F.substring(F.col("label"), i, F.lit(1)) != F.substring(F.col("brand"), i, F.lit(1)))
    at = F.try_element_at(differ, F.lit(1))
    swap = same & (F.size(differ) == 2) & (F.try_element_at(differ, F.lit(2)) == at + 1) & (F.substring(F.col("label"), at, F.lit(2)) == F.reverse(F.substring(F.col("brand"), at, F.lit(2))))
    typo = near.where("label <> brand").where(edit | swap).select("label", "brand", F.lit("typosquat").alias("method"))
    equal = distinct.join(small(brands), F.col("label") == F.col("brand")).select("label", "brand", F.lit("tld-swap").alias("method"))
    return equal.unionByName(combo).unionByName(typo).distinct()


def _deletions(rows: DataFrame, column: str) -> DataFrame:
    """Each string with itself and every string that lacks one of its characters, under ``_key``."""
    text = F.col(column)
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return rows.withColumn("_key", F.explode(F.array_distinct(F.concat(F.array(text), each))))


def budgeted(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group in this order: what a limited number of lookups is spent on."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
