"""Matrices of cross-validation on disk."""

import os

from featloom.operators import model
from featloom.session import materialize


def test_matrices_of_a_pair_go_once_it_is_scored(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id", "cast(id % 4 as int) as fold", "cast(id % 9 as double) as x", "1e0 + id % 9 as cost")
    made = []

    def kept(df, name):
        made.append(materialize(df, name))
        return made[-1]

    monkeypatch.setattr(model, "materialize_matrix", kept)
    pairs = [(i, rows.where(f"fold = {i}"), rows.where(f"fold <> {i}")) for i in (1, 2)]
    prepare = lambda a, b: (model.assemble(a, ["x"], ["cost"]), model.assemble(b, ["x"], ["cost"]), ["x"])
    fit = lambda m: model.fit_gbt(m, rounds=1, depth=2, min_rows=1)
    scores, splits = model.cross_validate(pairs, prepare, fit)
    assert len(made) == 4 and scores.count() == 4 and splits.count() == 2
    for matrix in made:
        for file in matrix.inputFiles():
            assert not os.path.exists(file.removeprefix("file://").removeprefix("file:"))
