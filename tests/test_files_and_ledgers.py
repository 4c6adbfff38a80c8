"""CSV by header, file inventories, ledgers, bootstrap by weights."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.operators import resampling
from quillmere.sources import files, ledgers, sinks


def test_columns_go_by_each_file_s_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date/Time,Rain,Snow\n2020-01-02,1,2\n")
    (tmp_path / "b.csv").write_text("Date/Time,Snow,Rain\n2020-01-01,7,3.5\n")
    (tmp_path / "c d.csv").write_bytes("﻿Snow,Date/Time,Other\n9,2020-01-03,x\n".encode())
    (tmp_path / "e.csv").write_bytes("Rain,Date/Time,Névé\nM,2020-01-04,é\n".encode("cp1252"))
    (tmp_path / "empty.csv").write_text("")
    names = {"Date/Time": "day", "Rain": "rain", "Snow": "snow", "Névé": "neve"}
    out = sinks.station_days(spark, f"file://{tmp_path}", names, ["rain", "snow"], "A").orderBy("day").collect()
    assert [tuple(r) for r in out] == [("A", "2020-01-01", 3.5, 7.0, None), ("A", "2020-01-02", 1.0, 2.0, None), ("A", "2020-01-03", None, 9.0, None), ("A", "2020-01-04", None, None, "é")]
    rows = files.read_csv(spark, f"file://{tmp_path}/[ab].csv", "Rain double, Snow double").collect()
    assert sorted(map(tuple, rows)) == [(1.0, 2.0), (3.5, 7.0)]


def test_inventory_knows_line_endings(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    contents = {"x.csv": (b"1\r\n2\r\n", b"1\n2\n"), "sub/y.bin": (b"\r\n\x0d", b"\n\n"), "z.md": (b"a\rb", b"a\nb"), "same.txt": (b"\xd0\x0d\x0a\xa0", b"\xd0\x0d\x0a\xa0"), "new.py": (None, b""), "gone.json": (b"{}", None)}
    for name, both in contents.items():
        for folder, content in zip((a, b), both, strict=True):
            if content is not None:
                (folder / name).parent.mkdir(parents=True, exist_ok=True)
                (folder / name).write_bytes(content)
    before, after = (ledgers.file_inventory(spark, f"file://{d}") for d in (a, b))
    got = {r["file"]: (r["n_bytes"], r["sha256"], r["text_sha256"]) for r in before.collect()}

    def told(name, content):
        text = content if name.endswith(".bin") else content.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        return len(content), hashlib.sha256(content).hexdigest(), hashlib.sha256(text).hexdigest()

    assert got == {n: told(n, c) for n, (c, _) in contents.items() if c is not None}
    assert {r["file"]: r["status"] for r in ledgers.inventory_changes(before, after).collect()} == {"x.csv": "line_endings", "sub/y.bin": "changed", "z.md": "line_endings", "same.txt": "same", "new.py": "added", "gone.json": "removed"}


def test_each_row_has_one_place_in_a_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1), (4, -9), (5, 7)], "k int, v int")
    told = ledgers.routed(rows, {"negative": F.col("v") < 0, "small": F.col("v") < -5}, F.col("v") == 7)
    assert {r["k"]: (r["ledger_status"], r["ledger_reason"]) for r in told.collect()} == {1: ("accepted", None), 2: ("accepted", None), 3: ("excluded", "negative"), 4: ("excluded", "negative"), 5: ("member", None)}
    path = f"file://{tmp_path}/ledger"
    assert {tuple(r) for r in ledgers.write_ledger(told, path).collect()} == {("accepted", "none", 2), ("excluded", "negative", 2), ("member", "none", 1)}
    assert tuple(ledgers.reconciled(rows, path, "k").first()) == (5, 5, 0, 0)
    told.filter("k = 1").withColumn("ledger_reason", F.lit("none")).write.mode("append").partitionBy("ledger_status", "ledger_reason").parquet(path)
    assert tuple(ledgers.reconciled(rows.union(spark.createDataFrame([(9, 9)], "k int, v int")), path, "k").first()) == (6, 6, 1, 1)


def test_weights_are_poisson_and_belong_to_the_unit():
    w = resampling.unit_weights(np.arange(4000), 100, 3)
    assert w.shape == (4000, 101) and (w[:, -1] == 1).all()
    assert abs(w[:, :-1].mean() - 1) < 0.01 and abs(w[:, :-1].var() - 1) < 0.02
    assert 0.7 < w[:, :-1].sum(axis=0).var() / 4000 < 1.3  # replicates differ as much as they should
    assert abs(np.corrcoef(w[:-1, :-1].ravel(), w[1:, :-1].ravel())[0, 1]) < 0.01
    assert (resampling.unit_weights(np.array([7, 9]), 100, 3) == w[[7, 9]]).all()


def test_a_score_s_rows_may_come_in_several_batches():
    rng = np.random.default_rng(1)
    scores = np.sort(rng.integers(0, 6, 60))[::-1].astype(float)
    columns = [np.where(scores > 2, 0, 1).astype(np.int32), rng.integers(0, 9, 60), scores, np.ones(60, np.int64), rng.integers(0, 2, 60)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["range", "unit", "score", "n", "pos"])
    add = lambda batches: {(r, float(s)): n[i].tolist() + p[i].tolist() for r, ss, n, p in resampling._score_cells(iter(batches), 5, 1) for i, s in enumerate(ss)}
    assert add([whole]) == add([whole.slice(i, 7) for i in range(0, 60, 7)]) and len(add([whole])) == 6


@pytest.mark.parametrize("label", [0, 1, None])
def test_no_interval_without_both_classes(spark, label):
    rows = spark.createDataFrame([(i, 0.1 * i, label) for i in range(5)], "u long, p double, y int")
    out = {r["metric"]: r for r in resampling.bootstrap_metrics(rows, "u", "p", "y", replicates=20).collect()}
    assert set(out) == set(resampling.METRICS) and all(r["status"] == "INSUFFICIENT_VARIATION" and r["low"] is None and r["n_used"] == 0 for r in out.values())
