"""First steps of every dataset: canonical names, provenance, numbers, guards on columns and anchors, coordinate ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.ordering import row_numbers


def canonical(df: DataFrame, names: dict[str, str], keep_others: bool = False) -> DataFrame:
    """df with columns renamed by `names` (from, to); those that it does not list go, unless kept. ValueError where two would have one name."""
    held = {a: b for a, b in names.items() if a in df.columns}
    columns = [held.get(c, c) for c in df.columns if c in held or keep_others]
    if len(set(columns)) < len(columns):
        raise ValueError(f"columns of one name: {sorted(c for c in set(columns) if columns.count(c) > 1)}")
    return df.select(*[F.col(f"`{c}`").alias(held.get(c, c)) for c in df.columns if c in held or keep_others])


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns as doubles; what is no number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def with_provenance(df: DataFrame, key: str, stamps: dict[str, str | int | None], campaign: str | None = None) -> DataFrame:
    """df with a constant column for each stamp, a record number from 1 in the order of a hash of `key` (unique), and source_year: of a campaign label like 2020-2021 the year before its last."""
    rows = row_numbers(df, key, 7, "source_record_number").withColumn("source_record_number", F.col("source_record_number") + 1)
    rows = rows.withColumns({k: F.lit(v) for k, v in stamps.items()})
    if campaign is None:
        return rows
    last = F.regexp_extract(F.col(campaign).cast("string"), r"([0-9]{4})[^0-9]*$", 1).try_cast("int")
    return rows.withColumn("source_year", F.when(F.col(campaign).cast("string").rlike(r"^[0-9]{4}$"), last).otherwise(last - 1))


def by_status(df: DataFrame, status: str, accepted: tuple[str, ...]) -> DataFrame:
    """df with accepted (0 or 1): the status is one of the given; null is not."""
    return df.withColumn("accepted", F.coalesce(F.col(status).isin(*accepted), F.lit(False)).cast("int"))


def only_anchors(df: DataFrame, at: str, allowed: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """The rows at allowed anchors; ValueError where their number is not the expected one."""
    kept = df.join(F.broadcast(allowed.select(at).distinct()), at, "left_semi")
    if expected_rows is not None and (n := kept.count()) != expected_rows:
        raise ValueError(f"{n} rows at the allowed anchors, {expected_rows} expected")
    return kept


def check_anchors(df: DataFrame, at: str, allowed: DataFrame) -> DataFrame:
    """df, or ValueError where it has an anchor that is not allowed (at most ten are named)."""
    bad = df.select(at).distinct().join(F.broadcast(allowed.select(at).distinct()), at, "left_anti").orderBy(at).limit(10).collect()
    if bad:
        raise ValueError(f"anchors that are not allowed: {[str(r[0]) for r in bad]}")
    return df


def column_roles(df: DataFrame, numeric: list[str], categorical: list[str], binary: list[str], excluded: list[str]) -> dict[str, list[str]]:
    """The roles as given, or ValueError where a column has none, two, or isn't there."""
    listed = [*numeric, *categorical, *binary, *excluded]
    missing, extra = sorted(set(listed) - set(df.columns)), sorted(set(df.columns) - set(listed))
    twice = sorted({c for c in listed if listed.count(c) > 1})
    if missing or extra or twice:
        raise ValueError(f"missing {missing}, without a role {extra}, in two roles {twice}")
    return {"numeric": numeric, "categorical": categorical, "binary": binary, "excluded": excluded}


def binary_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_null and n_other (neither 0 nor 1) of each column, in one scan."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])))
    return long.groupBy("column_name").agg(F.count_if(F.col("v").isNull()).alias("n_null"), F.count_if(F.col("v").isNotNull() & ~F.col("v").isin(0.0, 1.0)).alias("n_other"))


def check_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or ValueError where one of the columns is not 0 or 1 throughout."""
    bad = binary_violations(df, columns).filter("n_null + n_other > 0").collect()  # one row a column
    if bad:
        raise ValueError(f"not 0 or 1 throughout: {sorted(r['column_name'] for r in bad)}")
    return df


def features_and_target(df: DataFrame, target: str, ids: list[str], dropped: list[str]) -> DataFrame:
    """df as its features, in a struct `x`, and the target `y`; ids stay beside them, other targets and what describes rows go."""
    x = [c for c in df.columns if c not in {target, *ids, *dropped}]
    return df.select(*ids, F.struct(*x).alias("x"), F.col(target).alias("y"))


def region_counts(df: DataFrame, by: list[str], x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """by, n, without coordinates, and inside or outside of the box (x low, y low, x high, y high)."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    inside = known & F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~known).alias("without"), F.count_if(inside).alias("inside"), F.count_if(known & ~inside).alias("outside"))


def envelope_counts(df: DataFrame, line: str, box: tuple[float, float, float, float]) -> DataFrame:
    """One row: lines, those whose envelope lies within the box, meets it only in part, and is apart from it; line: an array of (x, y)."""
    end = lambda f, c: f(F.transform(line, lambda p: p[c]))
    x0, x1, y0, y1 = end(F.array_min, "x"), end(F.array_max, "x"), end(F.array_min, "y"), end(F.array_max, "y")
    inside = (x0 >= box[0]) & (x1 <= box[2]) & (y0 >= box[1]) & (y1 <= box[3])
    apart = (x1 < box[0]) | (x0 > box[2]) | (y1 < box[1]) | (y0 > box[3])
    return df.agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.count_if(~inside & ~apart).alias("partly"), F.count_if(apart).alias("apart"))


def canonicalised(df: DataFrame, names: dict[str, str], as_numbers: list[str], key: str, stamps: dict[str, str | int | None], flags: dict[str, Column]) -> DataFrame:
    """The whole first step: canonical names, numbers, record numbers and stamps, and flags."""
    return with_provenance(numbers(canonical(df, names), as_numbers), key, stamps).withColumns(flags)
