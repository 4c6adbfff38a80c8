"""Finding and replacing patterns in texts with DataFrame functions: values, places and what lies between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_values(docs: DataFrame, pattern: str) -> DataFrame:
    """docs with `parts` (what lies between matches of the pattern) and `vals` (the matches, one fewer)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("vals", F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).withColumn("parts", F.when(F.size("vals") > 0, F.split(text, pattern, -1)).otherwise(F.array(text)))


def starts() -> Column:
    """The places (code points before) of `vals`."""
    return F.expr("transform(sequence(1, size(vals)), k -> cast(aggregate(slice(parts, 1, k), 0L, (s, x) -> s + length(x)) + aggregate(slice(vals, 1, k - 1), 0L, (s, x) -> s + length(x)) as bigint))")


def rebuilt(replacements: str) -> Column:
    """The text with `vals` replaced by an array column of as many strings."""
    return F.array_join(F.zip_with("parts", replacements, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
