"""Matrices are written from arrays, and nothing wide is written or dealt out before them."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import values
from featloom import session
from featloom.checks import model_checks
from featloom.operators import model
from featloom.plans import quotes


def back(df, slots, slot="slot"):
    numbers = model.number_array(["a", "b"])
    parts = model.vector_parts(numbers, 2, F.col(slot).cast("int"), slots)
    return {r.k: r.features for r in model.materialize_matrix(df.select("k", parts.alias("features")), "m").collect()}


@pytest.fixture
def written(monkeypatch):
    """The names of the tables written to the shared folder."""
    names, path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: names.append(name) or path(spark, name))
    return names


def test_parts_are_read_back_as_vectors(spark):
    df = spark.createDataFrame(
        [(1, 0, 2.5, 0), (2, None, 0.0, 2), (3, 7, None, None)], "k int, a int, b double, slot int"
    )
    want = {1: [0, 2.5, 1, 0], 2: [0, 0, 0, 0], 3: [7, 0, 0, 0]}
    assert {k: list(v.toArray()) for k, v in back(df, 2).items()} == want
    sparse = back(df, 3)
    assert {k: (v.size, list(v.indices), list(v.values)) for k, v in sparse.items()} == {
        1: (5, [1, 2], [2.5, 1.0]), 2: (5, [4], [1.0]), 3: (5, [0], [7.0]),
    }
    assert {k: list(v.toArray()) for k, v in back(df, 0).items()} == {1: [0, 2.5], 2: [0, 0], 3: [7, 0]}
    with pytest.raises(Exception, match="NaN"):
        back(df.withColumn("b", F.lit(math.nan)), 2)


def tables(spark, monkeypatch):
    """Twelve assemblies of one feature; the features of the plan are not at issue."""
    tubes = spark.createDataFrame([(f"t{i}", 10.0 + i) for i in range(12)], "tube_assembly_id string, length double")
    monkeypatch.setattr(quotes, "assembly_features", lambda *given: tubes)
    rows = [(f"t{i % 13}", f"s{i % 5}", "2013-07-07", i, 1, "Yes", i % 9, 2.0 + i % 12) for i in range(130)]
    given = spark.createDataFrame(rows, "tube_assembly_id string, supplier string, d string, annual_usage int, "
                                        "min_order_quantity int, bracket_pricing string, quantity int, cost double")
    return given.withColumn("quote_date", F.to_date("d")).drop("d"), {"tube": tubes}


def test_scoring_writes_no_assemblies(spark, monkeypatch, written):
    train, known = tables(spark, monkeypatch)
    test = train.drop("cost").withColumn("id", F.col("annual_usage") % 3)
    scored = quotes.score_test_set(train, test, known, fit=lambda m: model.fit_gbt(m, rounds=1, depth=0, subsample=1.0))
    assert scored.columns == ["id", "cost"] and scored.count() == 120
    assert "assemblies" not in written and written.count("matrix") == 1
    mean = math.expm1(sum(math.log1p(2.0 + i % 12) for i in range(130) if i % 13 < 12) / 120)
    assert all(r.cost == pytest.approx(mean) for r in scored.collect())


def test_folds_write_their_features_once(spark, monkeypatch, written):
    train, known = tables(spark, monkeypatch)
    scores, votes = quotes.cross_validated_score(train, known, fit=lambda m: model.fit_forest(m, trees=2, depth=4))
    assert scores.count() == 6 and votes.where("feature like 'supplier_%' or feature = 'length'").count() > 0
    assert "assemblies" not in written and written.count("fold-features") == 1


def test_folds_of_lines_are_dealt_out_once(spark, tmp_path, written):
    lines = spark.range(400).selectExpr(
        "id div 4 as l_orderkey", "cast(id % 4 as int) as l_linenumber", "id * 1.5e0 as l_extendedprice",
        "cast(id % 9 as double) as l_quantity", "0.05e0 as l_discount", "0.01e0 as l_tax",
        "case id % 3 when 0 then 'R' else 'N' end as l_returnflag", "'O' as l_linestatus",
        "date'2020-01-01' as l_shipdate",
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    scores = model_checks.fold_scores(spark, str(tmp_path), swap=False)[0]
    assert [r[:2] for r in values(scores)] == [(1, "forward"), (2, "forward"), (3, "forward")]
    assert written.count("line-folds") == 1
