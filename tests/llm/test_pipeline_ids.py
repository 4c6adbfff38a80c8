import random

DOCS = "doc_id long, text string, source string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def best_of_groups(rows):
    """(doc_id, text) of the smallest document, a null id last, of each group of near duplicates."""
    docs = sorted({(r[0], r[1] or "") for r in rows}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    sets, group = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[k]) - both):
                low, high = sorted((group[i], group[k]))
                group = [low if g == high else g for g in group]
    return [(docs[i][0], {t for j, (d, t) in enumerate(docs) if group[j] == g and d == docs[i][0]}) for i, g in enumerate(group) if i == g]


def rows_of():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    near = lambda t: " ".join([*t.split()[:-1], "end"])
    rows = [(1, texts[0], "a"), (1, texts[1], "a"), (1, texts[1], "a"), (2, texts[2], "a"), (3, near(texts[2]), "a"), (2, near(texts[1]), "a")]
    rows += [(None, texts[3], "a"), (None, texts[4], "a"), (None, texts[4], "a"), (None, near(texts[2]), "a"), (None, near(texts[4]), "a"), (-5, texts[5], "a"), (9, texts[5], "a")]
    return rows + [(None, None, "a"), (None, "", "a"), (7, None, "a"), (8, "", "a")]


def test_near_dedup_against_brute_force(spark):
    import corpus_pipeline

    rows = rows_of()
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert out.columns == ["doc_id", "text", "source"]
    found, true = sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=str), sorted(best_of_groups(rows), key=lambda x: str((x[0], min(x[1]))))
    assert len(found) == len(true)
    left = list(true)
    for d, t in found:
        left.remove(next(x for x in left if x[0] == d and t in x[1]))
    assert not left


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([r for r in rows_of() if r[1]], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        if name == "near_dedup":
            assert sorted((str(r["doc_id"]) for r in docs.collect())) == ["-5", "1", "1", "2", "None", "None"]
        else:
            assert docs.count() == before.count()
    packed = corpus_pipeline.packing(spark, docs, "")
    assert packed.filter("doc_id is null").count() > 0
