import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, OPERATORS, odd_rows


@pytest.mark.parametrize("op", sorted(OPERATORS))
def test_rows_of_a_null_id_stay(spark, op):
    rows = odd_rows() + [(None, odd_rows()[0][1], "a"), (None, "two", None), (None, None, "a")]
    out = OPERATORS[op](spark.createDataFrame(rows, DOCS)).collect()
    if op not in ("op2", "op5"):
        assert sum(r["doc_id"] is None for r in out) == 3 and len(out) == len(rows)


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 20])
def test_windows_of_null_ids_against_brute_force(spark, chunk_bytes):
    from quillmere.llm.recompression import without_repeats

    rng = random.Random(8)
    base = [rng.choice(["ab", "cd", "ef", "gh", "ij"]) for _ in range(300)]
    rows = []
    for i in range(60):
        at = rng.randrange(250)
        own = [str(rng.random()) for _ in range(rng.randrange(40))]
        rows.append((None if i % 6 == 0 else -i, " ".join(own + base[at : at + rng.randrange(10, 50)] + own[:5]), "s"))
    order = lambda d: (d is None, d or 0)
    first, true = {}, []
    for d, t, _ in rows:
        w = t.split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, d), d, key=order)
    for d, t, _ in rows:
        w = t.split()
        gone = {k + x for k in range(len(w) - 12) if order(first[tuple(w[k : k + 13])]) < order(d) for x in range(13)}
        true.append((d, len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    out = without_repeats(spark.createDataFrame(rows, DOCS), chunk_bytes=chunk_bytes).collect()
    assert sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in out), key=str) == sorted(true, key=str)
    assert any(n and d is None for d, n, _ in true)


def test_hits_of_null_ids_are_told(spark):
    from quillmere.llm.decontaminate import clean_documents, contaminated

    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"so {item} it", "s"), (None, "clean", "s"), (1, item, "s"), (1, "clean too", "s")], DOCS)
    out = sorted(((r["doc_id"], r["n_hit"], r["contaminated"]) for r in contaminated(docs, items).collect()), key=str)
    assert out == [(1, 0, False), (1, 11, True), (None, 0, False), (None, 11, True)]
    assert sorted(r["text"] for r in clean_documents(docs, items).collect()) == ["clean", "clean too"]
