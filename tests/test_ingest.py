"""File sets, the preferred row of a key, and models scored on rows they have not seen."""

import os

import pytest

from loomwright.plans.registry import QUERIES
from loomwright.sources import files

DATA = "/root/testdata/sf0.01"


def test_file_sets_of_several_layouts(spark, tmp_path):
    for name, text in (("vol_abc__1.csv", "código;nome\n1;ação\n"), ("vol_xyz__2.csv", "codigo;praça;nome\n2;p;n\n3;;\n"), ("vol_abc__3.csv", "código;nome\n")):
        (tmp_path / name).write_bytes(text.encode("latin-1"))
    names = {"código": "key", "codigo": "key", "nome": "name", "praça": "place"}
    rows = files.read_file_set(spark, str(tmp_path), names, r"vol_([a-z]+)__").collect()
    assert sorted(r[:] for r in rows) == [("1", "ação", "", "abc", "vol_abc__1.csv"), ("2", "n", "p", "xyz", "vol_xyz__2.csv"), ("3", "", "", "xyz", "vol_xyz__2.csv")]
    (tmp_path / "vol_new__4.csv").write_bytes("codigo;outra\n1;2\n".encode("latin-1"))
    with pytest.raises(ValueError, match=r"unknown \['outra'\], missing \['name', 'place'\]"):
        files.read_file_set(spark, str(tmp_path), names, r"vol_([a-z]+)__")


def test_preferred_row_of_a_key(spark):
    rows = [("a", False, 1, "x"), ("a", True, 9, "y"), ("a", True, 3, "z"), ("b", None, 5, "u"), ("b", False, 2, "v"), ("c", False, None, "w"), (None, True, 1, "n")]
    got = files.latest_per_key(spark.createDataFrame(rows, "k string, p boolean, i int, v string"), "k", "p", "i")
    assert {(r["k"], r["v"]) for r in got.collect()} == {("a", "z"), ("b", "v"), ("c", "w"), (None, "n")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name, floor", [("ml_logreg", 0.7), ("ml_tree", 0.8), ("ml_rf", 0.9), ("ml_gbt", 0.85), ("ml_mlp", 0.85)])
def test_models_on_rows_held_out(spark, name, floor):
    r = QUERIES[name](spark, DATA).first()
    assert 0.25 < r["n_held"] / (r["n_held"] + r["n_fit"]) < 0.35
    assert r["auc"] > floor and r["pr_auc"] > 0.8


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_learning_curve_over_the_documents(spark):
    curve = QUERIES["ml_learning_curve"](spark, DATA).orderBy("share").collect()
    assert [c["share"] for c in curve] == [0.25, 0.5, 1.0] and curve[0]["n"] < curve[1]["n"] < curve[2]["n"]
    assert curve[2]["test_auc"] > 0.6
