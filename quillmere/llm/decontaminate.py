"""Benchmark decontamination by winnowing, on DataFrame functions alone.

A span of `span` words has span - k + 1 runs of k words. Of each such window of runs the
smallest hash is its fingerprint; so a span that a document shares with an item gives both the
same fingerprint. Fingerprints of documents and items are joined, each hit is extended to the
spans around it, and these are compared as text with the spans of the items. Items of fewer
words than a span are one window each; they are found by their word of the smallest hash.

Arrays are exploded with explode_outer: explode would have Spark push a filter on the array's
size below, and compute the whole chain of arrays once more for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import row_columns, text_key, with_rows, written

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 4  # words of a fingerprint
MOST_BROADCAST = 200_000  # benchmark rows (fingerprints or windows) that are broadcast; more are shuffled


def words_of(text: Column) -> Column:
    """Lower-cases A-Z and takes the runs of digits, letters and characters beyond ASCII; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def fingerprinted(rows: DataFrame, span: int, k: int = K) -> DataFrame:
    """rows with array column w, plus grams (a hash for each run of k = 4 words) and prints (the distinct window minima); both empty below `span` words."""
    if k != 4 or span < 5:
        raise ValueError("runs are of four words, and spans longer")
    pair = lambda a, m, f: f"zip_with(slice({a}, 1, size({a}) - {m}), slice({a}, 1 + {m}, size({a}) - {m}), (x, y) -> {f})"
    none = "cast(array() as array<bigint>)"
    rows = rows.withColumn("h", F.expr(f"if(size(w) >= {span}, transform(w, x -> xxhash64(x)), {none})"))
    rows = rows.withColumn("g", F.expr(f"if(size(h) = 0, {none}, {pair('h', 1, 'xxhash64(x, y)')})")).drop("h")
    rows = rows.withColumn("grams", F.expr(f"if(size(g) = 0, {none}, {pair('g', 2, 'xxhash64(x, y)')})")).drop("g")
    width, have = span - k + 1, 1
    rows = rows.withColumn("m", F.col("grams"))
    while have < width:  # minima over have runs become minima over have + more
        more = min(have, width - have)
        rows = rows.withColumn("m", F.expr(f"if(size(m) = 0, {none}, {pair('m', more, 'least(x, y)')})"))
        have += more
    return rows.withColumn("prints", F.array_distinct("m")).drop("m")


def _small(side: DataFrame) -> DataFrame:
    """Marks the benchmark's side for broadcast if it has no more than MOST_BROADCAST rows."""
    return F.broadcast(side) if side.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else side


def _matched(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, text_key, w, grams, print) of the fingerprints that rows share with prints. Where prints are too many to broadcast, only ids and fingerprints are shuffled, and the words come in afterwards, once a row."""
    if prints.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.select("doc_id", "text_key", "w", "grams", F.explode_outer("prints").alias("print")).join(F.broadcast(prints), "print")
    narrow = rows.select("doc_id", "text_key", F.explode_outer("prints").alias("print")).join(prints, "print").distinct()
    narrow = written(narrow.groupBy("doc_id", "text_key").agg(F.collect_set("print").alias("shared")), "matched").select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text"), "shared")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_text"))
    return rows.drop("prints").join(narrow, same).select("doc_id", "text_key", "w", "grams", F.explode_outer("shared").alias("print"))


def hits(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """(doc_id, text_key, start, stop, item): each place of docs (doc_id, text_key, w) where a window of items (item, w) occurs."""
    items = items.filter("size(w) > 0")
    whole = fingerprinted(items.filter(F.size("w") >= span), span)
    prints = written(whole.select(F.explode_outer("prints").alias("print")).filter("print is not null").distinct(), "prints")
    places = whole.select("item", "w", F.explode(F.sequence(F.lit(1), F.size("w") - span + 1)).alias("i"))
    windows = written(places.select("item", F.array_join(F.slice("w", F.col("i"), span), " ").alias("window")).distinct(), "windows")
    found = _matched(fingerprinted(docs, span), prints)
    found = found.select("doc_id", "text_key", "w", F.explode_outer(F.expr("filter(transform(grams, (x, i) -> if(x = print, i, null)), i -> i is not null)")).alias("at"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - (span - K)), F.least(F.col("at"), F.size("w") - span))
    found = found.select("doc_id", "text_key", "w", F.explode_outer(starts).alias("start"))
    found = found.select("doc_id", "text_key", "start", F.array_join(F.slice("w", F.col("start") + 1, span), " ").alias("window"))
    out = found.join(_small(windows), "window").select("doc_id", "text_key", "start", (F.col("start") + span).alias("stop"), "item")
    short = written(items.filter(F.size("w") < span).select("item", "w", F.expr("array_min(transform(w, x -> xxhash64(x)))").alias("least")), "short-items")
    if short.head(1):
        short = short.select("item", "least", F.size("w").alias("m"), F.expr("array_position(transform(w, x -> xxhash64(x)), least) - 1").alias("offset"), F.array_join("w", " ").alias("window"))
        some = docs.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
        some = some.select("doc_id", "text_key", "w", "h", F.explode_outer(F.array_distinct("h")).alias("least")).join(_small(short), "least")
        some = some.select("doc_id", "text_key", "w", "item", "m", "offset", "window", F.explode_outer(F.expr("filter(transform(h, (x, i) -> if(x = least, i - offset, null)), i -> i is not null and i >= 0 and i + m <= size(w))")).alias("start"))
        some = some.filter(F.expr("array_join(slice(w, cast(start as int) + 1, m), ' ')") == F.col("window"))
        out = out.union(some.select("doc_id", "text_key", F.col("start").cast("int"), (F.col("start") + F.col("m")).cast("int"), "item"))
    return out


def contaminated(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256 and contaminated for each row of `docs` (doc_id, text) against `items` (item_id, text).

    A null text has no words and is never hit; an item without words has no window. Repeated rows give
    equal rows, an empty table none; no items, no hits. A null doc_id stays null, and its text is looked at like any other. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(F.col("text")).alias("w"))
    wanted = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    found = hits(rows, wanted, span).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.expr("aggregate(spans, named_struct('n', 0, 'end', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.stop - greatest(s.end, x.start)), 'end', greatest(s.end, x.stop)), s -> s.n)")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), covered.cast("long").alias("hit"), F.size("items").cast("long").alias("many"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    sizes = rows.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"))
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return sizes.join(found, same, "left").select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("many", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """The rows of docs that no window of the items touches, with all their columns, whatever their names.

    Null and empty texts and those of a null doc_id that hold no window stay, repeated rows stay or go together, and
    texts are looked at whole. An empty table gives none; without items all rows stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), words_of(F.col("text")).alias("w"))
    bad = hits(rows, items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")), span)
    bad = written(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct(), "hit-documents")
    held = with_rows(docs, id=F.col("doc_id").cast("long"), text_key=text_key())
    return row_columns(held.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("text_key") == F.col("bad_text")), "left_anti"), docs.columns)
