import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def odd_rows():
    rng = random.Random(3)
    base = " ".join(rng.choice(["ab", "cd", "éf", "g."]) for _ in range(400))
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " tail", None), (4, None, "a"), (5, "", "b"), (6, "   \n\t ", "b"), (7, "one", None), (7, "one", None), (8, "a" * 3000, "c")]
    return rows + [(10 + i, base[i * 20 : i * 20 + 700] + str(rng.random()), "d") for i in range(20)]


OPERATORS = {
    "op1": lambda d: __import__("quillmere.llm.minhash", fromlist=["x"]).near_duplicates(d, ngram=2),
    "op2": lambda d: __import__("quillmere.llm.secrets", fromlist=["x"]).secrets(d),
    "op4": lambda d: __import__("quillmere.llm.suffixes", fromlist=["x"]).without_repeated_bytes(d, chunk_bytes=2000),
    "op5": lambda d: __import__("quillmere.llm.pii", fromlist=["x"]).pseudonyms(d, "k"),
    "op7": lambda d: __import__("quillmere.llm.recompression", fromlist=["x"]).without_repeats(d, chunk_bytes=2000),
    "op9": lambda d: __import__("quillmere.llm.sharding", fromlist=["x"]).sharded(d),
    "op10": lambda d: __import__("quillmere.llm.quality", fromlist=["x"]).verdicts(d),
}


@pytest.mark.parametrize("op", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, op):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "chunk": F.lit("x"), "n": F.lit(None)})
    out = OPERATORS[op](docs).collect()
    if op not in ("op2", "op5"):
        assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    assert OPERATORS[op](docs.limit(0)).count() == 0


def brute_bytes(rows, window):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("most_pieces", [20_000, 2])
def test_repeated_bytes_against_brute_force(spark, most_pieces):
    from quillmere.llm.suffixes import without_repeated_bytes

    rng = random.Random(1)
    base = "".join(rng.choice("ab ") for _ in range(300))
    rows = [(i, base[rng.randrange(200) :][: rng.randrange(300)] + "".join(rng.choice("abcé") for _ in range(rng.randrange(100)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 500)]
    out = without_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), window=60, shorter=40, chunk_bytes=1000, most_pieces=most_pieces).collect()
    assert {r[0]: tuple(r[1:5]) for r in out} == brute_bytes(rows, 60)
    assert {r[0]: r[5] for r in out} == {d: x[1] for d, x in brute_bytes(rows, 40).items()}


def test_pieces_are_whole_ordered_and_hold_the_tokenizers_ids(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op3_order_preserving_packing"](spark, SF).orderBy("sequence_id", "offset").collect()
    filled, at = collections.Counter(), collections.Counter()
    for r in out:
        ids = np.array([*model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["offset"], r["doc_tokens"]) == (at[r["doc_id"]], filled[r["sequence_id"]], len(ids))
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        at[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    assert set(at) == set(texts) and max(filled.values()) <= 2048
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in out)


def test_names_of_added_tokens_get_the_plain_call_s_ids(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillmere.llm.packing import packed

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "One. Two <|endoftext|>" * 3000, None, "", "plain. text\n\nhere"]
    out = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id", "start").collect()
    assert next(r["doc_tokens"] for r in out if r["doc_id"] == 0) == 5
    for r in out:
        ids = np.array([*model.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packed(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_cuts_cost_no_more_than_any_other(spark):
    import itertools

    import numpy as np

    from quillmere.llm.packing import cuts

    rng = random.Random(5)
    for _ in range(30):
        places = np.array(sorted(rng.sample(range(1, 40), 9)))
        places = places[np.append(True, np.diff(places) <= 12)]
        penalties = np.array([float(rng.randrange(6)) for _ in places])
        cost = lambda c: sum(12 - (b - a) + penalties[list(places).index(b)] for a, b in zip((0, *c), c)) if all(b - a <= 12 for a, b in zip((0, *c), c)) else 1e9
        if places[0] > 12 or (np.diff(places) > 12).any():
            continue
        best = min(cost((*c, places[-1])) for n in range(len(places)) for c in itertools.combinations(places[:-1].tolist(), n))
        assert cost(tuple(cuts(places, penalties, 12))) == best


def test_shards_move_only_into_the_new_one(spark):
    out = queries.QUERIES["op9_jump_sharding"](spark, SF).toPandas()
    assert ((out.shard == out.grown_shard) | (out.grown_shard == 16)).all()
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    text = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(zlib.crc32(text[d]) == c and len(text[d]) + 1 == s for d, c, s in zip(out.doc_id, out.text_crc32, out["size"]))


def test_pseudonyms_are_valid_linked_and_one_to_one(spark):
    from quillmere.llm.pii import pseudonyms, pseudonymised

    ips = [f"10.0.{i // 50}.{i % 50}" for i in range(300)]
    text = "4111 1111 1111 1111 and 2024-02-29 +1 (017) 555-7713 97.51.17.173 x.34@mail7.example.com 4111111111111112 999.1.1.1"
    docs = spark.createDataFrame([(1, text), (2, "so 97.51.17.173"), (3, " ".join(ips)), (4, "clean words"), (5, None)], "doc_id long, text string")
    out = pseudonyms(docs, "k").collect()
    assert {r["kind"] for r in out if r["doc_id"] == 1} == {"card", "date", "phone", "ip", "email"}
    assert not [r for r in out if r["doc_id"] in (4, 5)]
    name = {(r["doc_id"], r["kind"]): r["pseudonym"] for r in out}
    assert name[1, "ip"] == name[2, "ip"]
    assert len({r["pseudonym"] for r in out if r["doc_id"] == 3}) == 300
    digits = [int(c) for c in name[1, "card"] if c.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    after = {r["doc_id"]: r["text"] for r in pseudonymised(docs, "k").collect()}
    assert after[4] == "clean words" and after[5] is None and "97.51.17.173" not in after[1] and "999.1.1.1" in after[1]


def test_secrets_are_told_from_other_values(spark):
    from quillmere.llm.secrets import redacted, secrets

    rng = random.Random(2)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words token = "{hexes()}" more', "src1") for i in range(40)] + [(100 + i, f"paid {rng.randrange(10**15, 10**16)} to me", "src2") for i in range(40)]
    docs = spark.createDataFrame([*rows, (200, "clean", "src1"), (201, None, None), (None, *rows[0][1:])], DOCS)
    out = secrets(docs).collect()
    assert all(r["secret"] == ((r["doc_id"] or 0) < 100) for r in out) and len(out) == 81
    after = {r["doc_id"]: r["text"] for r in redacted(docs).collect()}
    assert "<SECRET>" in after[0] and after[100] == rows[40][1] and after[200] == "clean" and after[201] is None


def test_archives_round_trip_and_roll(spark, tmp_path):
    from quillmere.llm.warc import read_archives, write_archives

    big = "x" * 300
    pages = spark.createDataFrame([(i, f"http://h/{i}", big if i % 3 == 0 else f"{i} é" * 60) for i in range(60)] + [(90, None, None), (91, "u", ""), (92, "u", "short"), (93, "u", "short"), (5, "again", big)], "page_id long, url string, html string")
    base = f"file://{tmp_path}/w"
    manifest = write_archives(pages, base, range_bytes=4000, file_bytes=600)
    assert manifest.count() > 5
    out = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in read_archives(manifest, base).collect()}
    assert len(out) == 65 and out[0, 300] == ("response", None) and out[3, 300] == ("revisit", 0) and out[5, 300] == ("revisit", 0)
    assert out[92, 5] == out[93, 5] == ("response", None) and out[90, 0] == ("response", None)


def test_short_items_are_found(spark):
    from quillmere.llm.decontaminate import clean_documents, contaminated

    items = spark.createDataFrame([(1, "Red green blue"), (2, None), (3, "!!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a red, GREEN blue red green", "s"), (2, "red green", "s"), (3, None, "s")], DOCS)
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in contaminated(docs, items).collect()}
    assert out == {1: (6, 3, 1), 2: (2, 0, 0), 3: (0, 0, 0)}
    assert sorted(r["doc_id"] for r in clean_documents(docs, items).collect()) == [2, 3]


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after


def test_packing_ids_are_the_tokenisers() -> None:

    import public_tokenizers

    from quillmere.llm.packing import Tokens

    tokens, rng = Tokens(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    bits = ["a", "Zb", "é", "1", "23", ".", " ", " ", "\n", ",", "!?", "'s", "don't", "\t", "  ", "漢字", "😀", ":", "_", "<|endoftext|>", "\r\n", "\x1c", "ß.", "д", "²", "·"]
    texts = ["", " ", "\n", "a ", " a", "a  b"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for (ids, stops), true in zip(tokens.many(part), tokens.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == true.ids
            assert not len(stops) or (np.diff(stops) > 0).all() and stops[-1] <= len(true.ids)
