"""Guards, sinks, tree contributions, wide durations, encodings by file, and fits that have no SQL."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import attribution, canonical, evaluation, explained, mart, scoring, survival
from quillmere.plans import catalog
from quillmere.sources import files, sinks

SF = "/root/testdata/sf0.001"


def shapley(x, leaves, n):
    """Contributions by the definition: over all orders of the features."""

    def value(known):
        return sum(v * math.prod((float(low < x[f] <= high) if f in known else share) for f, low, high, share in path) for v, path in leaves)

    out = [0.0] * n
    for order in itertools.permutations(range(n)):
        known = set()
        for f in order:
            before = value(known)
            known = known | {f}
            out[f] += value(known) - before
    return [v / math.factorial(n) for v in out]


def test_tree_contributions_against_the_definition(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(*r, float(r[1] + r[2] * r[3] > 0.8)) for r in rows], "id long, a double, b double, c double, label double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(df)
    out = explained.tree_contributions(df, model, ["id"], ["a", "b", "c"]).orderBy("id").limit(12).collect()
    found = explained.leaves(model)
    for r in out:
        true = shapley(rows[r["id"]][1:], found, 3)
        assert np.allclose([c["value"] for c in r["contributions"]], true, atol=1e-9)
        assert abs(r["base"] + sum(true) - r["margin"]) < 1e-9
    margins = {r["id"]: r["rawPrediction"][1] for r in model.transform(df).collect()}
    assert all(abs(margins[r["id"]] - r["margin"]) < 1e-9 for r in out)  # the raw prediction of class 1
    assert attribution.additivity(explained.tree_contributions(df, model, ["id"], ["a", "b", "c"])).first()["n_failed"] == 0


def test_guards_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "x", 0, "2020-01-31"), (2, None, 2, "2020-02-29")], "a int, b string, c int, t string")
    allowed = df.filter("a = 1").select("t")
    with pytest.raises(ValueError, match="2020-02-29"):
        canonical.check_anchors(df, "t", allowed)
    assert canonical.only_anchors(df, "t", allowed, 1).count() == 1
    with pytest.raises(ValueError, match="2 rows"):
        canonical.only_anchors(df, "t", df, 1)
    with pytest.raises(ValueError, match="without a role"):
        canonical.column_roles(df, ["a"], ["b"], ["c"], [])
    assert canonical.column_roles(df, ["a"], ["b"], ["c"], ["t"])["binary"] == ["c"]
    with pytest.raises(ValueError, match="c"):
        canonical.check_binary(df, ["c"])
    with pytest.raises(ValueError, match="one name"):
        canonical.canonical(df, {"a": "k", "b": "k"})
    assert canonical.canonical(df, {"a": "k"}, keep_others=True).columns == ["k", "b", "c", "t"]
    with pytest.raises(ValueError, match="once"):
        mart.aligned(df, df.union(df), "a")
    with pytest.raises(ValueError, match="more than one"):
        mart.per_anchor(df, df.withColumn("t", F.lit("2020-01-31")), "t")
    assert scoring.leak_audit(["x", "target_180d", "id"], ["id"], ("target",)) == [("target_180d", "suspicious"), ("id", "excluded")]


def test_long_durations_lose_no_pairs(spark):
    rows = spark.createDataFrame([(600_000, 1, 2), (2_000_000, 1, 1)], "d int, e int, s int")
    got = survival.concordance(rows, "d", "e", "s").first()
    assert (got["pairs"], got["c_index"]) == (1, 1.0)
    with pytest.raises(ValueError, match="bits"):
        survival.concordance(rows, "d", "e", "s", bits=20)


def test_recall_is_decided_by_counts(spark):
    rows = spark.range(3_000_001).select((F.lit(1.0) - F.col("id") / 4e6).alias("p"), F.lit(1).alias("label"))
    got = evaluation.recall_threshold(rows, [], "p", "label", 0.5).first()
    assert got["tp"] == 1_500_001


def test_encodings_are_told_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\nÉté,1\n".encode())
    (tmp_path / "b.csv").write_bytes("name,n\nHiver’é,2\n".encode("cp1252"))
    got = {r["n"]: r["name"] for r in files.read_csv(spark, f"file://{tmp_path}", "name string, n int").collect()}
    assert got == {1: "Été", 2: "Hiver’é"}


def test_yearly_files_carry_their_names(spark, tmp_path):
    for y in (2019, 2021):
        spark.range(y - 2018).write.parquet(f"{tmp_path}/y{y}.parquet")
    got = files.yearly_files(spark, f"file://{tmp_path}/y{{year}}.parquet", range(2018, 2023))
    assert got.groupBy("source_year").count().orderBy("source_year").collect() == [(2019, 1), (2021, 3)]
    assert got.filter("source_file is null").count() == 0


def test_later_events_do_not_change_earlier_features(spark):
    from quillmere.operators import panel

    early = spark.createDataFrame([("S", d) for d in ("2017-02-15", "2017-05-20", "2017-10-10")], "k string, d string").withColumn("d", F.to_date("d"))
    more = early.union(spark.createDataFrame([("S", "2017-04-15")], "k string, d string").withColumn("d", F.to_date("d")))
    at = [panel.trailing_counts(e, "k", "d", (90,)).filter("as_of_date <= '2017-03-31'").orderBy("as_of_date").collect() for e in (early, more)]
    assert at[0] == at[1] and at[0][-1]["events_90d"] == 1


def test_packed_geometries_with_envelopes(spark):
    import struct

    body = struct.pack("<BI2d", 1, 1, 3.5, -2.0)
    blobs = [b"GP\x00\x01" + b"\x00" * 4 + body, b"GP\x00\x03" + b"\x00" * 36 + body, b"XX\x00\x01" + b"\x00" * 4 + body, None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, blob binary")
    got = {r["i"]: r["line"] for r in df.select("i", sinks.decoded(sinks.wkb_of(F.col("blob"))).alias("line")).collect()}
    assert [got[i] and (got[i][0]["x"], got[i][0]["y"]) for i in range(4)] == [(3.5, -2.0), (3.5, -2.0), None, None]


def test_log_rank_tail(spark):
    table = spark.createDataFrame([(3.841459,)], "chi2 double")
    assert survival.log_rank_p(table).first()["p_value"] == 0.05


@pytest.mark.parametrize("name", ["j12_long_horizon", "j15_batch_scores", "j17_seed_matrix", "j18_family_ablation", "k01_tree_contributions"])
def test_fits_have_rows(spark, name):
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows
    if name == "k01_tree_contributions":
        assert all(r["n_failed"] == 0 for r in rows)
    if name == "j17_seed_matrix":
        assert not any(r["alert"] for r in rows)


def test_same_run_twice_gives_the_same_prints(spark):
    """Two runs of a fit, told apart by nothing but their rows' fingerprint."""
    from quillmere.operators.tables import fingerprint

    a, b = (fingerprint(catalog.QUERIES["j15_batch_scores"](spark, SF), [], ["l_orderkey", "l_linenumber", "score", "calibrated"]).first() for _ in range(2))
    assert a == b
