"""Audits of whole tables: coverage in time, eligibility, identifiers, ranges, structure, stages and partitions. Each is one aggregation or two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.operators.ordering import prefix_sum


def temporal_coverage(rows: DataFrame, day: str, status: str) -> DataFrame:
    """One row: n, earliest, latest, missing days, parse failures and days that more than one row has. Rows are summed by day first."""
    daily = rows.groupBy(day).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "parse_failure").alias("failed"))
    none = F.col(day).isNull()
    return daily.agg(
        F.sum("n").alias("n"),
        F.min(day).alias("earliest"),
        F.max(day).alias("latest"),
        F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("failed").alias("parse_failures"),
        F.count_if(~none & (F.col("n") > 1)).alias("repeated_days"),
    )


def right_edge(rows: DataFrame, day: str, horizons: tuple[int, ...]) -> DataFrame:
    """latest, horizon and the last day whose horizon is wholly observed."""
    latest = rows.agg(F.max(day).alias("latest")).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    return latest.withColumn("last_eligible", F.expr("date_sub(latest, horizon)"))


def window_eligibility(anchors: DataFrame, at: str, policies: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """policy, horizon, the anchor, covered_days, eligible and reason. policies: (policy, first, last) observed days, a small table.

    An anchor is eligible if every day of (t, t + H] is observed.
    """
    rows = anchors.crossJoin(F.broadcast(policies)).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    begin, end = F.date_add(at, 1), F.expr(f"date_add({at}, horizon)")
    covered = F.greatest(F.lit(0), F.datediff(F.least(end, F.col("last")), F.greatest(begin, F.col("first"))) + 1)
    reason = F.when(F.col("first") > begin, "before_first_day").when(F.col("last") < end, "right_censored").otherwise("eligible")
    return rows.select("policy", "horizon", at, covered.alias("covered_days"), (reason == "eligible").cast("int").alias("eligible"), reason.alias("reason"))


def first_ineligible(table: DataFrame, at: str) -> DataFrame:
    """policy, horizon, n_anchors, n_eligible, first_ineligible (anchor after an eligible one) and its reason, of window_eligibility."""
    last = table.groupBy("policy", "horizon").agg(F.max(F.when(F.col("eligible") == 1, F.col(at))).alias("last_good"), F.count("*").alias("n_anchors"), F.sum("eligible").alias("n_eligible"))
    after = table.filter("eligible = 0").join(last.select("policy", "horizon", "last_good"), ["policy", "horizon"]).filter(F.col(at) > F.col("last_good"))
    first = after.groupBy("policy", "horizon").agg(F.min(at).alias("first_ineligible"), F.min_by("reason", at).alias("reason"))
    return last.drop("last_good").join(first, ["policy", "horizon"], "left")


def observation_calendar(spark_table: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Every day from first to last (ISO dates) with its events and a status: before_first, observed, quiet (no event between observed days) or after_last."""
    seen = spark_table.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n_events"))
    ends = seen.agg(F.min("day").alias("low"), F.max("day").alias("high"))
    every = spark_table.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    status = F.when(F.col("day") < F.col("low"), "before_first").when(F.col("day") > F.col("high"), "after_last").when(F.col("n_events").isNull(), "quiet").otherwise("observed")
    return every.join(seen, "day", "left").crossJoin(ends).select("day", F.coalesce("n_events", F.lit(0)).alias("n_events"), status.alias("status"))


def counts_by_period(rows: DataFrame, day: str, source: str) -> DataFrame:
    """grain (day, month, year, source), value and n: four counts in one scan by grouping sets."""
    parts = rows.select(F.col(day).cast("date").cast("string").alias("day"), F.date_format(day, "yyyy-MM").alias("month"), F.year(day).cast("string").alias("year"), F.col(source).cast("string").alias("source"))
    grouped = parts.groupingSets([["day"], ["month"], ["year"], ["source"]], "day", "month", "year", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    grain = F.when(F.col("g") == 7, "day").when(F.col("g") == 11, "month").when(F.col("g") == 13, "year").otherwise("source")
    return grouped.select(grain.alias("grain"), F.coalesce("day", "month", "year", "source").alias("value"), "n")


def identifier_audit(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, nulls, distinct, repeated, lowest, highest and contiguous (every whole number between them is there) of number columns."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("long").alias("id")) for c in columns])))
    each = long.groupBy("column_name", "id").agg(F.count("*").alias("times"))
    some = F.col("id").isNotNull()
    out = each.groupBy("column_name").agg(
        F.sum("times").alias("n"), F.coalesce(F.sum(F.when(~some, F.col("times"))), F.lit(0)).alias("nulls"), F.count("id").alias("n_distinct"), F.count_if(some & (F.col("times") > 1)).alias("repeated"), F.min("id").alias("lowest"), F.max("id").alias("highest")
    )
    return out.withColumn("contiguous", F.coalesce(F.col("highest") - F.col("lowest") + 1 == F.col("n_distinct"), F.lit(False)))


def frequencies(rows: DataFrame, column: str, rare_below: int) -> DataFrame:
    """value, n, share and rare of each value; null is a value."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") < rare_below).alias("rare"))


def type_sets(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """kinds (the sorted kinds that an entity has, joined) and n_entities of each such set."""
    held = rows.select(key, kind).distinct().groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(kind)), "|").alias("kinds"))
    return held.groupBy("kinds").agg(F.count("*").alias("n_entities"))


def pair_audit(rows: DataFrame, a: str, b: str, low_high: dict[str, tuple[float, float]], sentinel: float) -> DataFrame:
    """One row of counts on two indices: out of range, sentinels, nulls, and rows where just one is known."""
    out = []
    for c in (a, b):
        low, high = low_high[c]
        out += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.col(c) == sentinel).alias(f"{c}_sentinel"), F.count_if((F.col(c) != sentinel) & ~F.col(c).between(low, high)).alias(f"{c}_out_of_range")]
    return rows.agg(F.count("*").alias("n"), *out, F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias("one_known"))


def rank_quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """by, share and value: the value at place floor(n * share) of the known ones in order (from 0). Rows are summed by value, which are ordered in ranges."""
    cells = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    cells = prefix_sum(cells, by, value, ["n"])
    cells = cells.join(F.broadcast(totals), by) if by else cells.crossJoin(F.broadcast(totals))
    up_to = F.col("total") - F.col("n_to") + F.col("n")
    each = cells.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(up_to > F.floor(F.col("total") * F.col("share")))
    return each.groupBy(*by, "share").agg(F.min(value).alias("value"))


def temperature_audit(rows: DataFrame, by: list[str], low: str, mean: str, high: str) -> DataFrame:
    """by, days, complete days, days with high < low, and with the mean outside of both."""
    known = F.col(low).isNotNull() & F.col(mean).isNotNull() & F.col(high).isNotNull()
    return rows.groupBy(*by).agg(F.count("*").alias("n_days"), F.count_if(known).alias("complete"), F.count_if(F.col(high) < F.col(low)).alias("reversed"), F.count_if((F.col(mean) < F.col(low)) | (F.col(mean) > F.col(high))).alias("mean_outside"))


def precipitation_audit(rows: DataFrame, by: list[str], value: str, flag: str) -> DataFrame:
    """by, n, missing, zeros, positives, negatives and traces (flag T)."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"), F.count_if(v == 0).alias("zeros"), F.count_if(v > 0).alias("positives"), F.count_if(v < 0).alias("negatives"), F.count_if(F.col(flag) == "T").alias("traces"))


def field_inventory(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, n, missing, missing_percent, flagged, traces (T) and estimated (E) of each value column and its flag column."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNull().alias("gone"), F.col(f).cast("string").alias("flag")) for c, f in fields.items()])))
    flag = lambda x: F.count_if(F.col("flag") == x)
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("gone").alias("missing"), F.round(100 * F.count_if("gone") / F.count("*"), 6).alias("missing_percent"), F.count("flag").alias("flagged"), flag("T").alias("traces"), flag("E").alias("estimated"))


def annual_summary(daily: DataFrame, by: str, day: str) -> DataFrame:
    """by, year, days, days without rain data, rain_total, wettest, mean_of_means, lowest and highest."""
    return daily.groupBy(by, F.year(day).alias("year")).agg(
        F.count("*").alias("n_days"), F.count_if(F.col("rain").isNull()).alias("rain_missing"), F.round(F.sum("rain"), 4).alias("rain_total"), F.round(F.max("rain"), 4).alias("wettest"), F.round(F.avg("mean"), 6).alias("mean_of_means"), F.min("low").alias("lowest"), F.max("high").alias("highest")
    )


def date_anomalies(rows: DataFrame, made: str, renewed: str, version: str) -> DataFrame:
    """One row of counts: dates missing, after the version's date, and renewals before the making."""
    v = F.lit(version).cast("date")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(made).isNull()).alias("made_missing"), F.count_if(F.col(made) > v).alias("made_in_future"), F.count_if(F.col(renewed) > v).alias("renewed_in_future"), F.count_if(F.col(renewed) < F.col(made)).alias("renewed_before_made"))


def feature_bounds(rows: DataFrame, bounds: dict[str, float], label: str) -> DataFrame:
    """feature, highest, n_distinct, missing_percent, label_correlation, bound and over_bound of each feature."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.col(label).cast("double").alias("y"), F.lit(float(b)).alias("bound")) for c, b in bounds.items()])))
    return long.groupBy("feature", "bound").agg(F.max("x").alias("highest"), F.count_distinct("x").alias("n_distinct"), F.round(100 * F.count_if(F.col("x").isNull()) / F.count("*"), 6).alias("missing_percent"), F.round(F.corr("x", "y"), 6).alias("label_correlation"), F.count_if(F.col("x") > F.col("bound")).alias("over_bound"))


def anchor_enumeration(rows: DataFrame, at: str, expected: DataFrame) -> DataFrame:
    """Each anchor found or expected (a column of the same name) with its rows and a status: ok, missing or unexpected. Only the anchor column is read."""
    found = rows.groupBy(at).agg(F.count("*").alias("n_rows"))
    both = found.join(expected.select(at).distinct().withColumn("listed", F.lit(True)), at, "full")
    status = F.when(F.col("n_rows").isNull(), "missing").when(F.col("listed").isNull(), "unexpected").otherwise("ok")
    return both.select(at, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))


def structural_csv(lines: DataFrame, column: str, width: int, delimiter: str, day_at: int, number_at: list[int]) -> DataFrame:
    """One row of counts on raw lines: blank, of another width, with empty fields, unreadable days or numbers, and repeated lines."""
    row = F.split(F.col(column), f"\\Q{delimiter}\\E", -1)
    field = lambda i: F.trim(F.get("f", F.lit(i)))
    parts = lines.select(F.col(column).alias("line"), row.alias("f")).groupBy("line", "f").agg(F.count("*").alias("times"))
    blank = F.trim("line") == ""
    whole = ~blank & (F.size("f") == width)
    bad_day = whole & (field(day_at) != "") & F.try_to_timestamp(field(day_at), F.lit("yyyy-MM-dd")).isNull()
    bad_number = reduce(lambda a, b: a | b, [(field(i) != "") & field(i).try_cast("double").isNull() for i in number_at]) & whole
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0))
    return parts.agg(F.sum("times").alias("n_lines"), n(blank).alias("blank"), n(~blank & (F.size("f") != width)).alias("other_width"), n(whole & F.exists("f", lambda x: F.trim(x) == "")).alias("with_empty"), n(bad_day).alias("bad_day"), n(bad_number).alias("bad_number"), F.coalesce(F.sum(F.when(~blank, F.col("times") - 1)), F.lit(0)).alias("repeated"))


def neighbours_in_order(rows: DataFrame, by: str, order: list[str], day: str, columns: list[str]) -> DataFrame:
    """by, adjacent rows equal in all `columns`, and rows whose day is before that of the row ahead, in the order of each entity's rows."""
    w = Window.partitionBy(by).orderBy(*order)
    held = F.struct(*columns)
    flags = rows.select(by, (F.lag(held).over(w) == held).alias("same"), (F.col(day) < F.lag(day).over(w)).alias("back"))
    return flags.groupBy(by).agg(F.count_if("same").alias("adjacent_equal"), F.count_if("back").alias("steps_back"))


def panel_statistics(panel: DataFrame, entity: str, at: str, targets: list[str], counts: tuple[str, str], nullable: list[str]) -> DataFrame:
    """One row: rows, entities, anchors, prevalence of each target, rows whose raw and collapsed counts differ, and nulls of columns."""
    raw, collapsed = counts
    ids = panel.select(entity).distinct().agg(F.count("*").alias("n_entities"))
    anchors = panel.select(at).distinct().agg(F.count("*").alias("n_anchors"))
    sums = panel.agg(F.count("*").alias("n_rows"), *[F.round(F.avg(t), 6).alias(f"{t}_rate") for t in targets], F.count_if(F.col(raw) != F.col(collapsed)).alias("counts_differ"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in nullable])
    return sums.crossJoin(ids).crossJoin(anchors)


def against_expected(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, found, expected and ok of two tables (name, value): what is missing on either side is not ok."""
    both = found.select("name", F.col("value").alias("found")).join(expected.select("name", F.col("value").alias("expected")), "name", "full")
    return both.withColumn("ok", F.coalesce(F.col("found") == F.col("expected"), F.lit(False)))


def stage_reconciliation(stages: list[tuple[str, DataFrame, DataFrame]], key: str) -> DataFrame:
    """stage, n_in, n_out, lost (rows of `key` that are gone), gained and ok, for (name, before, after)."""

    def one(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
        a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((before, "x"), (after, "y")))
        x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
        sums = a.join(b, key, "full").agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n_in"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_out"), F.coalesce(F.sum(F.greatest(x - y, F.lit(0))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.greatest(y - x, F.lit(0))), F.lit(0)).alias("gained"))
        return sums.select(F.lit(name).alias("stage"), "*", ((F.col("lost") == 0) & (F.col("gained") == 0)).alias("ok"))

    return reduce(DataFrame.unionByName, [one(*s) for s in stages])


def mart_reconciliation(mart: DataFrame, key: str, part: str, explained: Column) -> DataFrame:
    """One row: rows, distinct keys, repeated keys, parts, the least and most rows of a part, and explained rows."""
    keys = mart.groupBy(key).agg(F.count("*").alias("times")).agg(F.sum("times").alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("times") > 1).alias("repeated_keys"))
    parts = mart.groupBy(part).agg(F.count("*").alias("n"), F.count_if(explained).alias("e")).agg(F.count("*").alias("n_parts"), F.min("n").alias("least_rows"), F.max("n").alias("most_rows"), F.sum("e").alias("n_explained"))
    return keys.crossJoin(parts)
