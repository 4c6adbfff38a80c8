"""Stages keep all columns, whatever their names; long texts, null and repeated ids, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"
CLASHES = ["_id", "_key", "_found", "_host", "_row", "row", "id", "key", "found", "host", "text_key", "bad_id", "of_id", "vals", "parts", "component_id"]


def stage_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(90)) for _ in range(5)]
    return [(1, texts[0], "a"), (1, texts[1], None), (None, texts[2], "b"), (None, texts[3], None), (2, "token=Ab1" + "x9" * 12 + " " + texts[4], "a"), (3, None, "a"), (4, "", None)]


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontaminate", "secrets"])
def test_stages_keep_clashing_columns(spark, name):
    import corpus_pipeline

    plain = spark.createDataFrame(stage_rows(), DOCS)
    docs = plain.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("-"))) for c in CLASHES})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    assert sorted(out.select("doc_id", "text", "source").collect(), key=str) == sorted(stage(spark, plain, "/root/testdata/sf0.001").collect(), key=str)
    assert all(r["_key"].startswith("_key") for r in out.collect())
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_packing_of_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(stage_rows(), DOCS).withColumns({c: F.lit(c) for c in CLASHES})
    out = corpus_pipeline.packing(spark, docs, "").collect()
    assert sum(r["start"] == 0 for r in out) == len(stage_rows())
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    from quillmere.llm.minhash import near_duplicates

    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    a, b, c = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(5, a, "s"), (5, b, "s"), (7, b, "s"), (3, a, "s"), (None, c, "s"), (None, c, "s"), (None, c + " end", "s"), (None, b, "s"), (None, "", "s")]
    out = near_duplicates(spark.createDataFrame(rows, DOCS), ngram=2).collect()
    told = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out), key=str)
    # a: ids 3 and 5; b: 5, 7 and a null one; c: null ids alone, of which one text (twice there, or once) is kept; an empty text alone
    firm = [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (None, 5, False), (None, None, True)]
    assert all(told.count(x) >= 1 for x in firm) and len(told) == 9
    assert sum(t[0] is None and t[1] is None for t in told) == 4 and sum(t == (None, None, True) for t in told) in (2, 3)


def test_seams_of_long_texts(spark):
    from quillmere.llm.recompression import without_repeats
    from quillmere.llm.suffixes import SEGMENT, without_repeated_bytes

    rng = random.Random(6)
    long = rng.randbytes(SEGMENT * 2).hex()[: SEGMENT + 100_000]
    seam = long[SEGMENT - 700 : SEGMENT + 900]
    docs = spark.createDataFrame([(1, long, "a"), (2, "head " + seam + " tail", "a"), (None, "x" * 399, "a")], DOCS)
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in without_repeated_bytes(docs).collect()}
    assert out == {1: (1600, 1), 2: (1600, 1), None: (0, 0)}
    spaced = " ".join(long[i : i + 5] for i in range(0, len(long), 5))
    part = " ".join(spaced.split()[1_000_000:1_000_200])
    docs = spark.createDataFrame([(1, spaced, "a"), (2, "head " + part + " tail", "a")], DOCS)
    assert {r["doc_id"]: r["n_removed"] for r in without_repeats(docs, texts=False).collect()} == {1: 0, 2: 200}


@pytest.mark.parametrize("op", ["op1", "op2", "op5", "op6", "op9", "op10"])
def test_texts_of_a_megabyte(spark, op):
    from quillmere.llm import decontaminate, minhash, pii, quality, secrets, sharding

    rng = random.Random(7)
    text = " ".join(rng.randbytes(3).hex() for _ in range(150_000))
    item = " ".join(text.split()[140_000:140_012])
    docs = spark.createDataFrame([(1, text + " a.b@example.com token=Abc123def456ghi7", "a"), (2, text, "a")], DOCS)
    run = {
        "op1": lambda: minhash.near_duplicates(docs).filter("component_id = 1").count() == 2,
        "op2": lambda: secrets.secrets(docs).filter("secret").count() == 1,
        "op5": lambda: pii.pseudonyms(docs, "k").count() == 1,
        "op6": lambda: decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).filter("n_hit = 12").count() == 2,
        "op9": lambda: sharding.sharded(docs).filter("size > 1000000").count() == 2,
        "op10": lambda: quality.metrics(docs).filter("n_words >= 150000").count() == 2,
    }
    assert run[op]()
