import datetime

import pytest
from pyspark.sql import functions as F

from helpers import values
from featloom.functions.columns import by_name
from featloom.operators import model
from featloom.plans import assemblies, basic_quotes, quotes
from featloom.plans.recipes import (
    BOSS,
    FLOAT,
    HFL,
    NUT,
    OPTIONAL_STEPS,
    RECIPES,
    SLEEVE,
)
from featloom.session import checkpoint_dir, in_parallel, materialize, scratch_path
from featloom.sources import csv_tables
from featloom.sources.csv_tables import load_tables, read_csv_table, write_csv_table


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv_nulls_decimals_and_ids(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,size,kind\nC-1,.437,9999\nC-2,NA,NA\nC-3,9999,NONE\n")
    df = read_csv_table(spark, path, "id string, size double, kind string")
    assert values(df) == [("C-1", 0.437, "9999"), ("C-2", None, None), ("C-3", 9999.0, "NONE")]


def test_csv_columns_follow_the_header(spark, tmp_path):
    path = put(tmp_path / "a.csv", "extra,size,id\nx,1.5,C-1\n")
    df = read_csv_table(spark, path, "id string, size double")
    assert df.columns == ["id", "size"] and values(df) == [("C-1", 1.5)]
    with pytest.raises(ValueError, match="weight"):
        read_csv_table(spark, path, "id string, weight double")


def test_csv_text_in_a_number_column(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,size\nC-1,See Drawing\nC-2,4\n")
    with pytest.raises(Exception):
        read_csv_table(spark, path, "id string, size double").collect()
    text = read_csv_table(spark, path, "id string, size string")
    numbers = text.select("id", F.col("size").try_cast("double").alias("size"))
    assert values(numbers) == [("C-1", None), ("C-2", 4.0)]


def test_csv_dates_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, datetime.date(2013, 7, 7), None, "a,b"), (2, None, 2.5, 'say "x"')],
        "id int, quote_date date, cost double, note string",
    )
    target = str(tmp_path / "out")
    write_csv_table(df, target)
    write_csv_table(df, target)
    back = read_csv_table(spark, target, "id int, quote_date date, cost double, note string")
    assert values(back) == values(df)


def test_every_declared_schema_parses(spark, tmp_path):
    assert len(csv_tables.SCHEMAS) == 21
    for name, ddl in csv_tables.SCHEMAS.items():
        header = ",".join(part.split()[0] for part in ddl.replace("\n", " ").split(","))
        put(tmp_path / f"{name}.csv", header + "\n")
    tables = load_tables(spark, str(tmp_path), register=True)
    assert all(t.count() == 0 for t in tables.values())
    assert spark.table("comp_nut").columns == tables["comp_nut"].columns


def test_scratch_goes_to_the_checkpoint_folder(spark):
    folder = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == folder
    assert scratch_path(spark, "x").startswith(folder)
    df = spark.range(3).select(by_name("id").alias("a b#1"))
    assert values(materialize(df, "t")) == [(0,), (1,), (2,)]
    assert in_parallel([lambda: 1, lambda: 2]) == [1, 2]


def test_sleeve_sentinel_and_suffix(spark):
    df = spark.createDataFrame(
        [("a", 9999.0, 12.0), ("b", 3.0, None)],
        "component_id string, length double, intended_nut_pitch double",
    )
    assert values(SLEEVE.prepare(df)) == [("a", 14.4, 12.0), ("b", 3.0, None)]
    assert SLEEVE.prepare(df).columns == ["component_id", "length_sleeve", "intended_nut_pitch_sleeve"]


def test_float_limit_and_flag(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0, 1.0, "Yes", 2.5), ("b", 1.0, 1.0, 1.0, "No", 2.6), ("c", 1.0, 1.0, 1.0, None, None)],
        "component_id string, bolt_pattern_long double, bolt_pattern_wide double, "
        "thickness double, orientation string, weight double",
    )
    assert values(FLOAT.prepare(df), "component_id", "orientation_float") == [("a", 1)]


def test_one_hot_names_carry_their_column(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "C-1", "SP-9", "SP-9", "Yes", "No", 0.1)],
        "component_id string, hose_diameter double, corresponding_shell string, "
        "coupling_class string, material string, plating string, orientation string, weight double",
    )
    assert HFL.prepare(df).columns == [
        "component_id", "hose_diameter_hfl", "weight_hfl", "plating_hfl", "orientation_hfl",
        "corresponding_shell_C-1_hfl", "coupling_class_SP-9_hfl", "material_SP-9_hfl",
    ]


def test_nut_prepares_metric_codes(spark):
    rows = [
        (f"n{i}", None if i == 3 else 10.0 + i, 5.0 + i % 3, "M10" if i % 2 else ".687",
         1.0 + i % 4, None if i == 5 else 8.0 + i, None if i == 7 else 0.1 * (i % 5))
        for i in range(12)
    ]
    df = spark.createDataFrame(
        rows, "component_id string, hex_nut_size double, length double, thread_size string, "
        "thread_pitch double, diameter double, weight double",
    )
    out = {r.component_id: r for r in NUT.prepare(df).collect()}
    assert out["n1"].thread_pitch_nut == 16.93 and out["n2"].thread_pitch_nut == 3.0
    assert out["n7"].weight_nut == 0.07709
    assert all(r.hex_nut_size_nut is not None and r.diameter_nut is not None for r in out.values())


def test_optional_steps_extend_a_recipe():
    full = BOSS.with_steps(*OPTIONAL_STEPS["comp_boss"])
    assert len(full.regressions) == 4 and len(full.one_hots) == 3
    assert len(BOSS.regressions) == 2


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """All input tables as small CSV files, 40 assemblies with 6 quotes each."""
    path = tmp_path_factory.mktemp("csv")

    def table(name, rows):
        names = [part.split()[0] for part in csv_tables.SCHEMAS[name].replace("\n", " ").split(",")]
        lines = [",".join(names)]
        for row in rows:
            lines.append(",".join(str(row.get(n, "NA")) for n in names))
        (path / f"{name}.csv").write_text("\n".join(lines) + "\n")

    keys = [f"TA-{i:02d}" for i in range(40)]
    table("tube", [dict(
        tube_assembly_id=k, material_id=f"SP-{i % 3}", diameter=6 + i % 5, wall=1, num_bends=i % 4,
        length=9999 if i == 39 else 50 + i, bend_radius=9999 if i % 7 == 0 else 20 + i,
        end_a_1x="Y", end_a_2x="N", end_x_1x="N", end_x_2x="Y",
        end_a=f"EF-{i % 3}", end_x="NONE" if i % 5 == 0 else f"EF-{i % 4}", num_boss=i % 2,
        num_bracket=0,
    ) for i, k in enumerate(keys)])
    table("tube_end_form", [dict(end_form_id=f"EF-{i}", forming="Yes" if i else "No") for i in range(3)])
    table("bill_of_materials", [dict(
        tube_assembly_id=k,  # the sixth bill is there but empty
        **({"component_id_1": f"C-{i % 11}", "quantity_1": 2} if i != 5 else {}),
        **({"component_id_2": f"C-{i % 7}", "quantity_2": 1} if i % 3 and i != 5 else {}),
    ) for i, k in enumerate(keys)])
    table("specs", [dict(
        tube_assembly_id=k, **({"spec1": f"SP-{i % 2}"} if i % 4 else {})) for i, k in enumerate(keys)])
    names = ["NUT-SWIVEL", "NUT-FLARED", "SLEEVE-ORFS", "ELBOW", "NA"]
    table("components", [dict(component_id=f"C-{i}", name=names[i % 5]) for i in range(11)])
    for recipe in RECIPES:
        columns = [part.split() for part in csv_tables.SCHEMAS[recipe.table].replace("\n", " ").split(",")]
        rows = []
        for i in range(11):
            row = {}
            for n, (name, kind) in enumerate(columns):
                if name == "component_id":
                    row[name] = f"C-{i}"
                elif name == "thread_size" and kind == "string":
                    row[name] = "M8" if i % 2 else ".5"
                elif kind == "double":
                    row[name] = "NA" if (i + n) % 6 == 0 else round(1 + ((i + 1) * (n + 2)) % 13 * 0.1, 2)
                elif name in ("orientation", "plating", "groove", "unique_feature", "blind_hole"):
                    row[name] = ("Yes", "No", "NA")[(i + n) % 3]
                else:
                    row[name] = f"X-{(i + n) % 3}"
            rows.append(row)
        table(recipe.table, rows)
    lines = [dict(
        tube_assembly_id=k, supplier=f"S-{(i + j) % 4}", quote_date=f"2014-0{1 + j}-15",
        annual_usage=10 * j, min_order_quantity=j, bracket_pricing="Yes" if j % 2 else "No",
        quantity=2500 if (i, j) == (1, 0) else 1 + j, cost=round(5 + i / 4 + 20 / (1 + j), 2), id=6 * i + j,
    ) for i, k in enumerate(keys) for j in range(6)]
    table("train_set", lines[:180])
    table("test_set", [{**line, "supplier": "S-new"} for line in lines[180:]])
    return str(path)


CUTOFFS = assemblies.Cutoffs(
    material=2, end=2, spec=2, component=3, base_name=2, connection=2, end_form=2
)


@pytest.fixture(scope="module")
def tables(spark, folder):
    names = [n for n in csv_tables.SCHEMAS if not n.startswith("type_") and n != "comp_other"]
    return load_tables(spark, folder, names)


def test_assembly_features(tables):
    df = assemblies.assembly_features(tables, CUTOFFS)
    rows = {r.tube_assembly_id: r for r in df.collect()}
    assert len(rows) == 39 and "TA-39" not in rows
    assert rows["TA-00"].bend_radius == 31.75 and rows["TA-01"].bend_radius == 21
    assert rows["TA-05"].total_components is None
    assert rows["TA-01"].total_components == 3 and rows["TA-01"].end_NONE == 0
    assert rows["TA-04"].has_specs == 0 and rows["TA-01"].has_specs == 1
    assert "num_bracket" not in df.columns and "material_id_SP-1" in df.columns
    assert rows["TA-01"]["base_NUT"] == 2


def test_quote_features_keep_every_usable_quote(tables):
    df = quotes.quote_features(tables["train_set"], tables, CUTOFFS)
    assert df.count() == 179
    row = df.where("tube_assembly_id = 'TA-02' and min_order_quantity = 0").first()
    assert row.inv_annual_usage == 0 and row.bracket_pricing == 0 and row.month == 1
    assert sum(row[f"supplier_S-{i}"] for i in range(4)) == 1


def test_scoring_a_test_set(tables):
    scored = quotes.score_test_set(
        tables["train_set"], tables["test_set"], tables, CUTOFFS,
        fit=lambda m: model.fit_gbt(m, rounds=5, depth=3, min_rows=2),
    )
    rows = {r.id: r.cost for r in scored.collect()}
    assert sorted(rows) == list(range(180, 234))
    assert all(0 < cost < 60 for cost in rows.values())


def test_cross_validated_score(tables):
    scores, votes = quotes.cross_validated_score(
        tables["train_set"], tables, CUTOFFS, base_split=1 / 3,
        fit=lambda m: model.fit_forest(m, trees=2, depth=4),
    )
    assert [(r.fold, r.direction) for r in scores.collect()] == [
        (1, "forward"), (1, "swapped"), (2, "forward"), (2, "swapped"),
    ]
    assert all(0 < r.rmsle < 1 for r in scores.collect())
    assert votes.select("fold").distinct().count() == 2


def test_basic_features(tables):
    cutoffs = basic_quotes.BasicCutoffs(component=3, base_name=2, name=2, material=2, end=2)
    built = basic_quotes.basic_assemblies(tables, cutoffs)
    df = basic_quotes.basic_quote_features(tables["train_set"], built, cutoffs=cutoffs)
    assert df.count() == 180
    row = df.where("tube_assembly_id = 'TA-05' and annual_usage = 10").first()
    assert row.total_components == 0 and row.has_components == 0
    assert row.inv_annual_usage == pytest.approx(1 / 11) and row.has_boss == 1 and row.day == 15
    assert "base_RareNameType" not in df.columns and "material_id" not in df.columns
    assert {"end_a_bucket_EF-0", "name_NUT-FLARED", "total_specs"} <= set(df.columns)


def test_csv_quotes_as_other_tools_write_them(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"say ""hi"", x"\n2,back\\slash\\\n')
    rows = read_csv_table(spark, str(tmp_path / "a.csv"), "k int, v string").orderBy("k").collect()
    assert [r.v for r in rows] == ['say "hi", x', "back\\slash\\"]
    write_csv_table(spark.createDataFrame(rows), str(tmp_path / "out"))
    again = read_csv_table(spark, str(tmp_path / "out"), "k int, v string").orderBy("k").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_csv_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("c,length,weight\nA,1,2\n")
    (tmp_path / "b.csv").write_text("c,weight,length\nB,1,2\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_csv_table(spark, str(tmp_path), "c string, length double, weight double").collect()


def test_csv_line_ends_inside_fields(spark, tmp_path):
    rows = [(1, "two\nlines"), (2, 'a "quoted"\r\n, one'), (3, None), (4, "plain")]
    df = spark.createDataFrame(rows, "k int, v string")
    write_csv_table(df, str(tmp_path / "out"))
    back = read_csv_table(spark, str(tmp_path / "out"), "k int, v string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    path = put(tmp_path / "a.csv", 'k,v\n1,"two\nlines"\n')
    assert read_csv_table(spark, path, "k int, v string", multi_line=True).collect() == [(1, "two\nlines")]


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    put(tmp_path / "t.csv" / "a.csv", "id,size\nC-1,1.5\nC-2,NA\n")
    put(tmp_path / "t.csv" / "b.csv", "size,extra,id\n2.5,x,C-3\n")
    put(tmp_path / "t.csv" / "c.csv", "id,size\nC-4,4\n")
    with pytest.raises(Exception):  # noqa: B017
        read_csv_table(spark, str(tmp_path / "t.csv"), "id string, size double").collect()
    tables = load_tables(
        spark, str(tmp_path), ["t"], {"t": "id string, size double"}, mixed_headers=True
    )
    assert values(tables["t"]) == [("C-1", 1.5), ("C-2", None), ("C-3", 2.5), ("C-4", 4.0)]
    put(tmp_path / "t.csv" / "d.csv", "id\nC-5\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        read_csv_table(spark, str(tmp_path / "t.csv"), "id string, size double", mixed_headers=True)


def test_plans_run_few_queries_ahead(spark, monkeypatch):
    """Fits, vocabularies and written tables before the result itself."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    from pyspark.sql.readwriter import DataFrameWriter

    import featloom.checks as checks

    ran = []
    for owner, name in ((Frame, "collect"), (Frame, "first"), (Frame, "count"), (Frame, "isEmpty"), (DataFrameWriter, "parquet")):
        def counted(self, *a, _name=name, _run=getattr(owner, name), **k):
            ran.append(_name)
            return _run(self, *a, **k)

        monkeypatch.setattr(owner, name, counted)
    folder = "/root/testdata/sf0.001"
    for query, most in (("quote_features", 15), ("basic_quote_features", 6)):
        ran.clear()
        checks.QUERIES[query](spark, folder)
        assert 0 < len(ran) <= most, ran
