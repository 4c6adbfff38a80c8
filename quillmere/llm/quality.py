"""Quality rules with host verdicts, on DataFrame functions alone.

Each document is measured in one pass over its own row (no shuffle of texts). Rule failures are
then summed by host, each rule's failure rate is shrunk towards the corpus with a beta prior
whose mean and strength are fitted to the hosts themselves (method of moments), and a host
whose shrunk rate of any rule exceeds `host_limit` is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import row_columns, text_key, with_rows, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RULES = ("base", "symbols", "lines")


def words_of(text: Column) -> Column:
    """The runs of characters other than \\x20 and \\x09-\\x0D; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def metrics(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_key and the measures of each row; a null text has no words and no lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_of(F.col(host)).alias("host"), text.alias("text"))
    at = at.select("*", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    at = at.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_key"),
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.bin(F.size("w"))).alias("p"),
    )
    # Each window as one long: its hash in the high bits, its place in the low p bits. Sorted, equal windows lie side by side;
    # what agrees in the hash is compared word for word.
    hashed = "transform(sequence(0, n_words - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]) & (shiftleft(1L, 63 - p) - 1L), p) | i)"
    at = at.withColumn("s", F.expr(f"if(n_words >= 3, sort_array({hashed}), array())"))
    low = "(shiftleft(1L, p) - 1L)"
    words = lambda x: f"slice(w, cast({x} & {low} as int) + 1, 3)"
    same = lambda j: f"coalesce(shiftright(x, p) = shiftright(get(s, {j}), p) and {words('x')} = {words(f'get(s, {j})')}, false)"
    at = at.withColumn("q", F.expr(f"sort_array(transform(filter(s, (x, i) -> {same('i - 1')} or {same('i + 1')}), x -> x & {low}))"))
    repeated = F.expr("aggregate(q, named_struct('n', 0L, 'last', -3L), (s, x) -> named_struct('n', s.n + least(3L, x - s.last), 'last', x), s -> s.n)")
    return at.withColumn("n_repeat_words", repeated).drop("w", "p", "s", "q")


def host_of(source: Column) -> Column:
    """The host of an address, or the whole value where it is none; lower case."""
    low = F.lower(source.cast("string"))
    return F.when(low.contains("://"), F.regexp_extract(low, r"://(?:[^/@]*@)?([^/:?#]+)", 1)).otherwise(low)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(measured: DataFrame) -> DataFrame:
    """For each host its rows, and for each rule the failures and the shrunk rate rate_<rule>."""
    fails = {"base": base_failed(), "symbols": 10 * F.col("n_symbols") > F.col("word_chars"), "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")}
    hosts = measured.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(fails[r]).alias(f"fails_{r}") for r in RULES])
    hosts = written(hosts, "hosts")
    rate = lambda r: F.col(f"fails_{r}") / F.col("n")
    sums = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *[F.sum(f"fails_{r}").alias(f"f_{r}") for r in RULES], *[F.sum(F.col("n") * rate(r) * rate(r)).alias(f"q_{r}") for r in RULES]).first()
    for r in RULES:
        mean, strength = beta_prior(sums["n"] or 0, sums["hosts"], sums[f"f_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"fails_{r}") + mean * strength) / (F.col("n") + strength))
    return hosts


def beta_prior(n: int, hosts: int, fails: int, squares: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the prior; squares: sum of n * rate**2 over hosts. Strength is kept within 10 and 10,000."""
    if not n:
        return 0.0, 10.0
    mean = fails / n
    within = mean * (1 - mean)
    between = squares / n - mean * mean - within * hosts / n
    return mean, min(1e4, max(10.0, within / between - 1 if between > 0 else 1e4))


def verdicts(docs: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """doc_id, text_key, host, the measures, base_failed and kept, for each row of `docs` (doc_id, text and the host column).

    A null or empty text has no words and fails the base rules; a null host has no verdict. Repeated
    rows give equal rows, an empty table none, and other columns are not read.
    """
    measured = written(metrics(docs, host), "metrics")
    bad = host_rates(measured).filter(" or ".join(f"rate_{r} > {host_limit}" for r in RULES)).select("host", F.lit(True).alias("host_failed"))
    out = measured.join(written(bad, "bad-hosts"), "host", "left").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_failed").isNull())


def kept_documents(docs: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The rows of docs whose verdict is kept, with all their columns, whatever their names.

    Null and empty texts fail the base rules and go; a null host is judged by its own rules alone; null and repeated ids
    are told apart by their texts. An empty table gives none.
    """
    bad = verdicts(docs, host, host_limit).filter("not kept").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text"), F.coalesce("host", F.lit("")).alias("bad_host")).distinct()
    held = with_rows(docs, id=F.col("doc_id").cast("long"), text_key=text_key(), host=F.coalesce(host_of(F.col(host)), F.lit("")))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_text")) & (F.col("host") == F.col("bad_host"))
    return row_columns(held.join(bad, same, "left_anti"), docs.columns)
