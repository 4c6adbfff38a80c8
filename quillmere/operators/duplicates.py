"""Groups of repeated events, by a key that depends on the format of the file that an event came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.tables import latest


def native_key(file: str, formats: dict[str, list[Column]], otherwise: list[Column]) -> Column:
    """A digest of the file's name and of the columns that its ending asks for. A null is told from any text, and parts keep their lengths, so no two keys run together."""
    text = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    digest = lambda columns: F.sha2(F.concat(*[text(c) for c in (F.col(file), *columns)]), 256)
    cases = [(F.col(file).endswith(ending), digest(columns)) for ending, columns in formats.items()]
    chosen = reduce(lambda w, case: w.when(*case), cases[1:], F.when(*cases[0])) if cases else None
    return digest(otherwise) if chosen is None else chosen.otherwise(digest(otherwise))


def grouped(events: DataFrame, key: Column) -> DataFrame:
    """events with duplicate_group_id and duplicate_multiplicity. Sizes are counted before the shuffle, so a large group never lies in one task."""
    rows = events.withColumn("duplicate_group_id", key)
    sizes = rows.groupBy("duplicate_group_id").agg(F.count("*").alias("duplicate_multiplicity"))
    return rows.join(sizes, "duplicate_group_id").select(*events.columns, "duplicate_group_id", "duplicate_multiplicity")


def first_of_groups(events: DataFrame, order: list[str]) -> DataFrame:
    """One of grouped events for each group: the first by `order`, numbers whose tuple is unique."""
    falling = events.withColumns({f"_down_{c}": -F.col(c) for c in order})
    return latest(falling, ["duplicate_group_id"], [f"_down_{c}" for c in order]).drop(*[f"_down_{c}" for c in order])


def sensitivity(events: DataFrame) -> DataFrame:
    """duplicate_multiplicity, n_events, n_groups and removed (all but the first of each group) of grouped events."""
    m = F.col("duplicate_multiplicity")
    out = events.groupBy(m).agg(F.count("*").alias("n_events"))
    return out.withColumn("n_groups", (F.col("n_events") / m).cast("long")).withColumn("removed", F.col("n_events") - F.col("n_groups"))
