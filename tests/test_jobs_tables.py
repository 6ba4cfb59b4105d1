"""Exploration, explanation export and folder inventories on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from creditloom.operators import explain as E
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.woe import WoeModel
from creditloom.sources.inventory import scan_folder


def test_inventory_of_files_with_their_encodings(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "sample.csv").write_text("client_id;issue_date;default_flag\n1;01.01.2023;0\n2;05.02.2023;1\n", encoding="cp1251")
    (tmp_path / "deep" / "sample.csv").write_text("имя,сумма\nМария,1\nПётр,2\n", encoding="cp1251")
    (tmp_path / "b.jsonl").write_text('{"x": 1, "y": 0}\n', encoding="utf-8")
    (tmp_path / "broken.parquet").write_text("no table", encoding="utf-8")
    (tmp_path / "readme.md").write_text("not read", encoding="utf-8")
    rows = scan_folder(spark, str(tmp_path)).collect()
    by = {(r.path.rsplit("/", 2)[-2:][0] == "deep", r.dataset, r.column_name): r for r in rows}
    first = by[(False, "sample.csv", "default_flag")]
    assert first.target_candidate == 1 and first.delimiter == ";" and first.encoding == "utf-8" and first.n_rows == 2
    assert by[(False, "sample.csv", "issue_date")].date_candidate == 1
    assert by[(True, "sample.csv", "имя")].encoding == "cp1251" and by[(True, "sample.csv", "имя")].delimiter == ","
    assert by[(False, "b.jsonl", "x")].dtype == "bigint" and by[(False, "b.jsonl", "x")].example == "1"
    bad = [r for r in rows if r.error]
    assert [(r.dataset, r.column_name, r.n_rows) for r in bad] == [("broken.parquet", None, None)]
    assert len({r.path for r in rows}) == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_folder(spark, str(tmp_path / "deep" / "none"))


def test_eda_tables_and_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2020-01-01", 0), (2, "b", "2020-01-02", 1), (None, None, None, None)], "v long, level string, issue_date string, target int")
    rows = {(r.section, r.item, r.x): (r.value, r.text) for r in J.eda_job(df.withColumn("issue_date", F.to_date("issue_date")), bins=2).collect()}
    assert rows[("describe", "v.mean", None)] == (1.5, None) and rows[("describe", "level.unique", None)] == (2.0, None)
    assert ("target_candidate", "target", None) in rows and ("date_candidate", "issue_date", None) in rows
    assert rows[("histogram", "v", 0.0)] == (1.0, None) and rows[("trend", "2020-01-02", 1.0)] == (0.5, None)
    assert J.eda_job(df.limit(0), bins=2).count() > 0
    df.write.parquet(str(tmp_path / "in" / "t.parquet"))
    made = J.eda_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), bins=3)
    assert made["dataset"].endswith("t.parquet")
    assert spark.read.json(made["inventory"]).count() == 4 and spark.read.json(made["report"]).filter("section = 'describe'").count() > 5


def test_explanation_holds_intercept_coefficients_and_reasons(spark, tmp_path):
    woe = WoeModel({"a": [0.0, 1.0, 2.0], "b": [0.0, 5.0]}, {"a": {1: -0.5, 2: 0.5}, "b": {1: 0.1}})
    model = L.Champion("logistic_woe", ["a", "b"], woe=woe, coefficients=[2.0, -1.0], intercept=0.25)
    df = spark.createDataFrame([("x", 0.5, 3.0), ("y", None, 9.0), (None, 1.5, 1.0)], "id string, a double, b double")
    rows = E.explanation(model, df, ["id"], 2).collect()
    fixed = [(r.section, r.position, r.feature, r.value) for r in rows if r.section != "reason"]
    assert fixed == [("intercept", None, None, 0.25), ("coefficient", 1, "a", 2.0), ("coefficient", 2, "b", -1.0)]
    reasons = sorted((r.id or "", r.position, r.feature, r.value) for r in rows if r.section == "reason")
    assert reasons == [("", 1, "a", 1.0), ("", 2, "b", -0.1), ("x", 1, "a", -1.0), ("x", 2, "b", -0.1), ("y", 1, "a", 0.0), ("y", 2, "b", -0.0)]
    path = J.export_explanation(model, df, ["id"], str(tmp_path / "e"), 1)
    lines = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert len(lines) == 6 and {"section": "intercept", "value": 0.25} in lines
