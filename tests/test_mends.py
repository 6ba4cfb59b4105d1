"""Cases in which data decide wrongly when only a part of them is looked at, and inputs with gaps."""

import pytest
from pyspark.sql import functions as F

from creditloom.functions.clean import pick_id, rejection
from creditloom.operators.models import poisson_copies
from creditloom.operators.splits import row_folds
from creditloom.plans.slices import SlicedFrame
from creditloom.sources.readers import HEAD_BYTES, SourceConfig, file_profile, load_source, read_dataset


def test_files_of_one_folder_keep_their_own_encoding_and_delimiter(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("id;name\n1;Анна\n".encode("cp1251"))
    (folder / "b.csv").write_text("id,name\n2,Борис\n", encoding="utf-8")
    (folder / "c.csv").write_text("id,name\nx3,Vera\n", encoding="utf-8")
    rows = {r["id"]: r["name"] for r in read_dataset(spark, str(folder)).collect()}
    assert rows == {"1": "Анна", "2": "Борис", "x3": "Vera"}


def test_an_ascii_beginning_does_not_decide_the_encoding(spark, tmp_path):
    head = "id;name\n" + "1;abc\n" * (HEAD_BYTES // 6 + 10)
    (tmp_path / "late.csv").write_bytes((head + "2;Отчёт за январь\n").encode("cp1251"))
    assert file_profile(spark, str(tmp_path)).first().encoding == "cp1251"
    last = read_dataset(spark, str(tmp_path / "late.csv")).filter("id = 2").first()
    assert last["name"] == "Отчёт за январь"


def test_only_a_source_that_is_not_there_may_be_missing(spark, tmp_path):
    cfg = SourceConfig(str(tmp_path))
    assert load_source(spark, cfg, "loan_details") is None
    (tmp_path / "loan_details.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        load_source(spark, cfg, "loan_details")


def test_rows_without_a_date_are_in_the_last_block(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 != 0, F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))).alias("d"))
    rows = row_folds(df, "d", "id", 3).collect()
    assert len(rows) == 40 and {r.block for r in rows if r.d is None} == {3}
    dated = [r.block for r in sorted((r for r in rows if r.d), key=lambda r: r.d)]
    assert dated == sorted(dated) and set(dated) == {0, 1, 2, 3}


def test_slices_without_a_tiebreak_use_the_other_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 1.0), (None, 1, 3.0)], "e string, d int, x double").withColumn("d", F.lit("2020-01-01").cast("date"))
    sliced = SlicedFrame(df, "e", "d", ())
    got = sliced.trailing(2, {"n": lambda w: F.row_number().over(w)}).result().collect()
    assert {(r.e, r.x, r.n) for r in got} == {("a", 1.0, 1), ("a", 2.0, 2), (None, 3.0, None)}


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(4000).withColumn("k", F.concat(F.lit("k"), "id"))
    one = poisson_copies(df.repartition(3), "k", 0.8, 1).groupBy("k").count().collect()
    two = poisson_copies(df.repartition(7), "k", 0.8, 1).groupBy("k").count().collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert abs(sum(r["count"] for r in one) / 4000 - 0.8) < 0.06


def test_names():
    assert [rejection(c, "t", ["Amount"]) for c in ("T", "t", "amount", "row_id", "y_1", "dpd_3", "My_Date", "yes")] == [
        "target", "target", "forbidden", "service", "outcome", "outcome", "date", None,
    ]
    assert pick_id(["a_client_id", "Customer_Ref"], ["client_id", "customer_ref"]) == "Customer_Ref"
    assert pick_id(["other"], ["client_id"]) is None


def test_inventory_counts_narrow_values_without_sorting_them(spark):
    from creditloom.sources.inventory import _exact_row, inventory

    rows = [(1, 10, 0.5, "a", [1]), (2, None, float("nan"), "a", None), (2, 10, -0.0, None, [1]), (None, 7, 0.0, "b", [2])]
    df = spark.createDataFrame(rows, "k long, s short, x double, t string, l array<int>").repartition(2)
    plan = _exact_row(df, df.schema.fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan
    got = {r.column_name: (r.n_rows, r.dtype, r.null_fraction, r.unique) for r in inventory(df, "d").collect()}
    assert got == {"k": (4, "bigint", 0.25, 2), "s": (4, "smallint", 0.25, 2), "x": (4, "double", 0.0, 3), "t": (4, "string", 0.25, 2), "l": (4, "array<int>", 0.25, 2)}
    assert {r.column_name: r.example in (x, y) for r, (x, y) in zip(inventory(df.select("k", "l"), "d").collect(), [("1", "2"), ("[1]", "[2]")])} == {"k": True, "l": True}
    none = inventory(df.limit(0), "d").collect()
    assert [(r.n_rows, r.null_fraction, r.unique, r.example) for r in none] == [(0, 0.0, 0, None)] * 5


def test_trees_work_out_their_rows_once(spark):
    from pyspark.sql import functions as F

    from creditloom.operators.models import train_trees

    seen = spark.sparkContext.accumulator(0)

    def value(i):
        seen.add(1)
        return float(i % 7)

    df = spark.range(60).select((F.col("id") % 3 == 0).cast("int").alias("target"), F.udf(value, "double")("id").alias("x"))
    train_trees(df, "target", ["x"], maxIter=1, maxDepth=1)
    assert seen.value == 60


def test_partitions_of_tasks_that_expand_their_rows_are_small(spark):
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
