"""Secret scans with a random forest against false positives, on DataFrame functions and Spark ML.

Candidates are long runs of key characters that hold a digit, what is assigned to a name like
token or password (DB_PASSWORD=, accessToken:, "password": too), passwords in URLs (scheme://user:password@host), and keys of a known
form. Each is described by its length,
character transitions and classes, by how far words of a dictionary, and words of stand-ins, cover it, by where it stands (path)
and by its neighbouring words. A random forest trained on labelled findings tells secrets from other values.

Where no labelled findings are given, some are planted (plants.py): PLANTS secrets and look-alikes
are put between words of the corpus, and the forest is trained on these. A label is what was planted,
not a rule over the features; `held_out` measures the forest on planted findings it has not seen.
The dictionary holds the words that stand around findings three times or more, in all documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import row_columns, text_key, with_rows, written
from quillmere.llm.plants import examples, others
from quillmere.llm.spans import rebuilt, starts, with_values

FIT_ROWS = 20_000  # labelled findings that the forest is fitted on, at most: those of the smallest hash
PLANTS, SEED = 6_000, 11  # planted findings, each between words of another document
KEY = ("doc_key", "text_key", "path", "ordinal")  # says which finding it is; none of these is ever null
WORDS = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"  # ends of names, whatever stands before
SHORT = r"(?:(?<![A-Za-z])(?i:key|auth)|(?<=[a-z0-9])(?:Key|Auth))(?<!(?i:public|primary|foreign)[_.-]?(?i:key))"  # where a part of a name begins (not in monkey)
ASSIGNS = rf"(?:(?i:{WORDS})|{SHORT})[\x22']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\x22']?"
PADDING = r"(?:={1,2}(?![A-Za-z0-9+/_=-]))?"  # of base64; any other '=' parts a name from its value
KNOWN = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{50,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)?)"
URL_PASSWORD = r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@]{4,}(?=@[A-Za-z0-9\[])"  # of scheme://user:password@host
CANDIDATE = rf"{URL_PASSWORD}|(?<=[:=>\s\x22'])(?<=[:=>]\s{{0,3}}[\x22']?)(?<={ASSIGNS})(?!>)[^\s\x22'=:]{{8,}}{PADDING}|(?<![A-Za-z0-9+/_-])(?:{KNOWN}|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{16,}}){PADDING}"
ASSIGNED = rf"{ASSIGNS}$"
HINT = rf"[0-9]|{KNOWN}|://[^\s/:@]*:|(?i:{WORDS}|key|auth)"  # no text without it has a candidate
NUMBERS = ("length", "digits", "uppers", "others", "hexes", "changes", "distinct", "vowels", "coverage", "assigned", "known", "quoted", "in_url", "repeats", "stand_in")
STAND_IN = r"(?i)change|example|sample|dummy|your|here|todo|replace|insert|enter|default|secret|token|passw(?:or)?d|none|null|test|fake|redacted|value|[*<>{}$()]"  # words and marks of values that stand for a secret


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, text_key, path, ordinal, start, value, before, after): the candidates in docs (doc_id, text, source), with 40 characters around them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), "text")
    rows = with_values(rows.filter(F.col("text").rlike(HINT)), CANDIDATE).filter("size(vals) > 0").withColumn("starts", starts())
    before = "substring(cast(text as string), cast(greatest(starts[i] - 40, 0) + 1 as int), cast(least(starts[i], 40) as int))"  # of the text: a name can be a candidate itself
    around = F.expr(f"transform(vals, (v, i) -> named_struct('value', v, 'start', starts[i], 'before', {before}, 'after', left(parts[i + 1], 40)))")
    rows = rows.select("doc_id", "text_key", "path", F.posexplode(around))
    return rows.select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("doc_key"), "text_key", "path", F.col("pos").alias("ordinal"), "col.start", "col.value", "col.before", "col.after")


def described(found: DataFrame) -> DataFrame:
    """found with the features of NUMBERS but coverage, and the words around."""
    share = lambda what: F.regexp_count("value", F.lit(what)) / F.length("value")
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    return (
        found.withColumn("length", F.length("value").cast("double"))
        .withColumn("digits", share("[0-9]"))
        .withColumn("uppers", share("[A-Z]"))
        .withColumn("others", share("[^A-Za-z0-9]"))
        .withColumn("hexes", share("[0-9a-fA-F]"))
        .withColumn("changes", share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"))
        .withColumn("distinct", F.size(F.array_distinct(F.split("value", ""))) / F.length("value"))
        .withColumn("vowels", share("(?i)[aeiou]"))
        .withColumn("assigned", F.col("before").rlike(ASSIGNED).cast("double"))
        .withColumn("known", F.col("value").rlike(f"^{KNOWN}").cast("double"))
        .withColumn("in_url", (F.col("before").rlike(r"://[^\s/:@]*:$") & F.col("after").rlike("^@")).cast("double"))
        .withColumn("repeats", share(r"(.)(?=\1)"))
        .withColumn("stand_in", (F.length("value") - F.length(F.regexp_replace("value", STAND_IN, ""))) / F.length("value"))
        .withColumn("quoted", F.col("before").rlike("[\\x22']$").cast("double"))
        .withColumn("word_before", word("before", r"([\p{L}_-]+)[^\p{L}]*$"))
        .withColumn("word_after", word("after", r"^[^\p{L}]*([\p{L}_-]+)"))
        .withColumn("kind", F.regexp_replace(F.regexp_replace(F.lower("path"), r"[0-9]+", ""), r"^.*[./]", ""))
    )


def planted(docs: DataFrame, n: int = PLANTS, seed: int = SEED, generator: Callable[[int, int], list[tuple[str, str, str, float]]] = examples) -> DataFrame:
    """described findings with `label`: n values of the generator put between words of as many documents (those of the smallest hash; bounded by n)."""
    some = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.left("text", F.lit(400)).alias("head"), F.xxhash64("text").alias("at")).filter("head is not null")
    some = some.orderBy("at", "source", "head").limit(n)  # 400 characters of each: what is ordered and sent holds no whole texts
    piece = F.split(F.translate("head", "=:'\"", "    "), r"[\s\d]+")
    some = some.select("source", F.array_join(F.slice(piece, 1, 6), " ").alias("before"), F.array_join(F.slice(piece, 7, 6), " ").alias("after"))
    around = [(r["source"], r["before"], r["after"]) for r in some.collect()] or [("", "so", "end")]
    made = generator(n, seed)
    rows = [(i, f"{around[i % len(around)][1]} {lead}", value, f"{tail} {around[i % len(around)][2]}", around[i % len(around)][0], label) for i, (lead, value, tail, label) in enumerate(made)]
    i, before, value, after, source, label = zip(*rows, strict=True)
    table = pa.table({"doc_id": pa.array(i, pa.int64()), "text": [b + v + a for b, v, a in zip(before, value, after, strict=True)], "source": source, "at": pa.array(map(len, before), pa.int64()), "label": label})
    plants = written(docs.sparkSession.createDataFrame(table), "plants")
    found = described(candidates(plants)).join(plants.select("doc_id", "at", "label"), "doc_id")
    return found.filter(F.col("start") == F.col("at")).drop("at")


def dictionary(found: DataFrame) -> DataFrame:
    """(word): what stands around the findings three times or more."""
    around = found.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"[\p{L}]{2,}"), F.lit(0))).alias("word"))
    return written(around.groupBy("word").count().filter("count > 2").select("word"), "dictionary")


def _covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with coverage: the share of the value in runs of letters that the dictionary has."""
    runs = found.select(*KEY, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("word"))
    sums = runs.join(words, "word").groupBy(*KEY).agg(F.sum(F.length("word")).alias("covered"))
    return found.join(sums, list(KEY), "left").withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.col("length")).drop("covered")


def fitted(known: DataFrame, words: DataFrame) -> PipelineModel | None:
    """The forest; none where one label is all there is."""
    known = known.orderBy(F.xxhash64("doc_id", "ordinal", "value"), "doc_id", "ordinal").limit(FIT_ROWS)
    known = written(_covered(known, words), "labelled-findings")
    if known.select("label").distinct().count() < 2:
        return None
    stages = [
        FeatureHasher(inputCols=["word_before", "word_after", "kind"], outputCol="hashed", numFeatures=128),
        VectorAssembler(inputCols=[*NUMBERS, "hashed"], outputCol="features"),
        RandomForestClassifier(numTrees=40, maxDepth=9, seed=7, featureSubsetStrategy="onethird"),
    ]
    return Pipeline(stages=stages).fit(known)


def scored(found: DataFrame, model: PipelineModel, words: DataFrame) -> DataFrame:
    """(*KEY, score) of each finding."""
    return model.transform(_covered(found.dropDuplicates(list(KEY)), words)).select(*KEY, F.round(vector_to_array("probability")[1], 6).alias("score"))


def held_out(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row of n, positives, precision and recall: the forest fitted on three quarters of the planted findings, tried on the rest."""
    known = written(planted(docs), "planted")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    words = dictionary(written(described(candidates(docs)), "findings"))
    told = known.filter(test).join(scored(known.filter(test), fitted(known.filter(~test), words), words), list(KEY)).withColumn("said", F.col("score") >= limit)
    hit = F.count_if(F.col("said") & (F.col("label") > 0))
    return told.agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("positives"), (hit / F.count_if("said")).alias("precision"), (hit / F.count_if(F.col("label") > 0)).alias("recall"))


def transferred(docs: DataFrame, limit: float = 0.5, n: int = 3_000, seed: int = 77) -> DataFrame:
    """One row of n, positives, candidates, precision, recall and forest_precision, forest_recall: what `secrets` says (the forest, and known forms whatever
    their score), and the forest alone, of n findings of the other generator. What is no candidate counts as told to be no secret."""
    words = dictionary(written(described(candidates(docs)), "findings"))
    model, test = fitted(planted(docs), words), written(planted(docs, n, seed, others), "other-plants")
    positives = int(sum(label > 0 for *_, label in others(n, seed)))
    told = test.select(*KEY, "label", "known").join(scored(test, model, words), list(KEY))
    measured = [F.lit(n).alias("n"), F.lit(positives).alias("positives"), F.count("*").alias("candidates")]
    for name, said in (("", (F.col("score") >= limit) | (F.col("known") > 0)), ("forest_", F.col("score") >= limit)):
        hit = F.count_if(said & (F.col("label") > 0))
        measured += [F.try_divide(hit, F.count_if(said)).alias(f"{name}precision"), (hit / positives).alias(f"{name}recall")]
    return told.agg(*measured)


def secrets(docs: DataFrame, labelled: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """(doc_id, text_key, ordinal, start, length, value_sha256, score, secret) of each candidate in docs (doc_id, text, source).

    labelled: findings (doc_id, start, label 0 or 1) to train on instead of planted ones. A null or empty text has no candidate, a
    null source an empty path, a null doc_id stays null; with labels of one kind only, candidates assigned to a secret's name or of a known
    form score 1 and others 0. A key of a known form is a secret whatever its score, unless labels are given: a form too rare for
    the forest is not lost. Repeated rows give a row each, an empty table none; texts are searched whole; other columns are not read.
    """
    found = written(described(candidates(docs)), "findings")
    words = dictionary(found)
    known = found.join(labelled.select("doc_id", "start", F.col("label").cast("double")), ["doc_id", "start"]) if labelled is not None else planted(docs)
    model = fitted(known, words)
    rows = found.withColumn("score", F.greatest("assigned", "known")) if model is None else found.join(scored(found, model, words), list(KEY))
    secret = F.col("score") >= limit
    if labelled is None:
        secret = secret | (F.col("known") > 0)
    return rows.select("doc_id", "text_key", "ordinal", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", secret.alias("secret"))


def redacted(docs: DataFrame, labelled: DataFrame | None = None, limit: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """docs with each secret in its text replaced by `mark`; all rows and columns stay, whatever their names.

    A null text stays null, an empty one empty; rows of a null or repeated id are told apart by their texts; an empty table gives none.
    """
    told = secrets(docs, labelled, limit).filter("secret").groupBy("doc_id", "text_key").agg(F.collect_set("ordinal").alias("found"))
    told = written(told.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text"), "found"), "secrets")
    held = with_rows(docs, id=F.col("doc_id").cast("long"), text_key=text_key(), whole=F.col("text").cast("string"))
    rows = held.join(told, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_text")), "left")
    rows = with_values(rows.withColumn("text", F.when(F.col("found").isNotNull(), F.col("whole"))), CANDIDATE)  # texts without a secret aren't searched again
    rows = rows.withColumn("new", F.expr("transform(vals, (v, i) -> if(array_contains(found, i), '" + mark.replace("\\", "\\\\").replace("'", "\\'") + "', v))"))
    return row_columns(rows, docs.columns, text=F.when(F.col("found").isNotNull(), rebuilt("new")).otherwise(F.col("whole")))
