"""Values that look the same on screen but differ in their characters, brought to one form in SQL.

Look-alike and width forms are mapped, invisible characters dropped, and the result is grouped under the
accent-sensitive, case-sensitive Unicode collation, which also holds composed and decomposed accents equal. The
canonical member of a class is deterministic, and is joined back to every value of the class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strophe.functions.text import is_missing, lookalike_table, visible
from strophe.operators.skew import join_split
from strophe.session import cut


def lookalike_classes(values: DataFrame) -> DataFrame:
    """``(field, value, canonical)`` for distinct present values of (field, value).

    canonical: the member that is spelt as its own skeleton where there is one (no look-alike, odd space or invisible
    character), else the smallest by code point. Missing values and values of invisible characters only give no
    rows. Case, accents, simplified and traditional forms keep values apart; a space inside a value does too.
    """
    return _classes(values).drop("members")


def _classes(values: DataFrame) -> DataFrame:
    v = values.select("field", "value").where(~is_missing("value")).distinct()
    v = v.withColumn("plain", visible(F.col("value"), lookalike_table())).where("plain <> ''")
    v = cut(v.withColumn("skeleton", F.expr("collate(plain, 'UNICODE')")))
    canonical = v.groupBy("field", "skeleton").agg(F.min_by("value", F.struct(F.col("value") != F.col("plain"), F.col("value"))).alias("canonical"), F.count("*").alias("members"))
    return v.join(canonical, ["field", "skeleton"]).select("field", "value", "canonical", "members")


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """``(field, value_a, value_b)``: all pairs of different raw values of one class, value_a < value_b by code point.
    Only values that are not alone in their class enter the join,
    and a class of very many values is dealt over several tasks."""
    c = cut(_classes(values).where("members > 1").drop("members"))
    a, b = c.withColumnRenamed("value", "value_a"), c.withColumnRenamed("value", "value_b")
    return join_split(a, b, ["field", "canonical"]).where("value_a < value_b").select("field", "value_a", "value_b")
