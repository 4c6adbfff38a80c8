"""Windows are compared only where a shared symbol stands."""

import random

import pytest

DOCS = "doc_id long, text string, source string"


def corpus():
    rng = random.Random(12)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    return [(i, " ".join([f"x{rng.random()}" for _ in range(rng.randrange(30))] + base[(at := rng.randrange(340)) : at + rng.randrange(10, 60)]), "s") for i in range(40)]


@pytest.mark.parametrize("chunk_bytes", [1500, 1 << 23])
def test_no_shared_symbol_no_removal(spark, monkeypatch, chunk_bytes):
    """With keys that no two documents share nothing is compared, in one chunk or in many; with those of the method all repeats go."""
    import numpy as np

    from quillmere.llm import recompression

    docs = spark.createDataFrame(corpus(), DOCS)
    first = {}
    for d, t, _ in corpus():
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    true = {d: len({k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for x in range(13)}) for d, t, _ in corpus() for w in [t.split()]}
    assert {r["doc_id"]: r["n_removed"] for r in recompression.without_repeats(docs, chunk_bytes=chunk_bytes).collect()} == true
    assert sum(true.values()) > 100

    def lonely(window):
        def run(texts):
            out = []
            for t in texts:
                n = max(0, len(t.split()) - window + 1)
                out.append(recompression._packed(np.random.default_rng(list(t)).integers(0, 2**63, n).astype(np.uint64), np.ones(n)).tobytes())
            return [out]

        return run

    monkeypatch.setattr(recompression, "_marks", lonely)
    assert all(r["n_removed"] == 0 for r in recompression.without_repeats(docs, chunk_bytes=chunk_bytes).collect())
