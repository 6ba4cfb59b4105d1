"""Closed-form toys and edge cases of the operators."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditloom.functions import clean as C
from creditloom.functions.expr import clip, compare, correlation, finite_frame, flag, safe_ratio
from creditloom.functions.scorecard import PointsScale
from creditloom.operators import diagnostics as D
from creditloom.operators import metrics as M
from creditloom.operators import prep as P
from creditloom.operators import splits as X
from creditloom.operators import stats as S
from creditloom.operators import woe as W
from creditloom.operators.drift import psi
from creditloom.operators.fairness import fairness_report
from creditloom.operators.joins import left_merge, merge_coverage


def scores(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


# -- null rules ------------------------------------------------------------------------------------------


def test_nan_and_infinity_become_null(spark):
    df = finite_frame(spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double"))
    assert [r.x for r in df.collect()] == [1.0, None, None, None]


def test_ratio_clip_and_flag_keep_missing_apart(spark):
    df = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(safe_ratio(a, b).alias("r"), clip(a, 5.0, None).alias("c"), flag(a > 3).alias("f")).collect()
    assert [tuple(r) for r in rows] == [(2.0, 5.0, 1), (None, 5.0, 1), (None, None, 0)]


@pytest.mark.parametrize("op,want", [(">=", [0, 1, 1]), (">", [0, 0, 1]), ("<=", [1, 1, 0]), ("<", [1, 0, 0]), ("==", [0, 1, 0]), ("?", [0, 1, 1])])
def test_compare(spark, op, want):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert [r[0] for r in df.select(flag(compare(F.col("x"), op, 2.0))).collect()] == want


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (None, 9.0, 1.0)], "a double, b double, c double")
    row = df.select(correlation(F.col("a"), F.col("b")).alias("x"), correlation(F.col("a"), F.col("c")).alias("y")).first()
    assert row.x == pytest.approx(1.0) and row.y is None


# -- cleaning --------------------------------------------------------------------------------------------


def test_text_numbers_and_currency(spark):
    df = spark.createDataFrame([("10+ years", "1 200,50 so'm"), ("n/a", "abc"), ("$1,500.25", None)], "t string, m string")
    rows = df.select(C.number_in_text(F.col("t")).alias("t"), C.parse_currency(F.col("m")).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(None, 1200.5), (None, None), (1500.25, None)]


def test_ids_stay_null_and_aliases_follow_their_order(spark):
    df = spark.createDataFrame([(" 7 ", 1), (None, 2)], "CUST_ID string, age int")
    out = C.normalize_id(df, "demographics")
    assert out.columns == ["customer_ref", "age"]
    assert [r.customer_ref for r in out.orderBy("age").collect()] == ["7", None]
    with pytest.raises(ValueError):
        C.normalize_id(spark.createDataFrame([(1,)], "x int"), "demographics")


def test_leakage_names():
    names = ["age", "default_rate", "y_prob", "index", "income", "first_date", "Loan_Id", "dpd_max", "query"]
    assert C.safe_features(names, "target", ["loan_id"]) == ["age", "income", "query"]
    with pytest.raises(ValueError):
        C.safe_features(["dpd"], "target")


def test_auto_cast_decides_on_the_share_of_digits(spark):
    df = spark.createDataFrame([("1a", "x", "9")] * 6 + [("b", "y", "z")] * 4, "a string, b string, c string")
    assert C.auto_cast_columns(df, exclude=["c"]) == ["a"]
    late = df.sparkSession.createDataFrame([(str(i),) for i in range(50)] + [("word",)] * 950, "t string")
    assert C.auto_cast_columns(late) == []


# -- metrics ---------------------------------------------------------------------------------------------


def test_separable_scores(spark):
    r = M.metric_report(scores(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert r.roc_auc == r.gini == r.ks == r.pr_auc == pytest.approx(1.0)


def test_equal_scores_and_one_class(spark):
    same = M.metric_report(scores(spark, [0, 1, 0, 1], [0.5] * 4)).first()
    assert same.roc_auc == pytest.approx(0.5) and same.ks == pytest.approx(0.0)
    one = M.metric_report(scores(spark, [0, 0], [0.1, 0.2])).first()
    assert one.roc_auc is None


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 10)), min_size=4, max_size=50))
def test_auc_is_the_share_of_ordered_pairs(spark, data):
    y, p = [a for a, _ in data], [b / 10 for _, b in data]
    got = M.ordered_metrics(scores(spark, y, p)).first()
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    if pos and neg:
        pairs = [(a > b) + 0.5 * (a == b) for a in pos for b in neg]
        assert got.roc_auc == pytest.approx(np.mean(pairs))
    else:
        assert got.roc_auc is None


def test_probability_one_has_no_bin_unless_asked(spark):
    df = scores(spark, [1, 1, 0], [1.0, 0.95, 0.05])
    assert sum(r.n for r in M.reliability(df).collect()) == 2
    assert sum(r.n for r in M.reliability(df, include_one=True).collect()) == 3


def test_lift_of_a_perfect_order(spark):
    df = scores(spark, [1] * 10 + [0] * 90, np.linspace(1, 0, 100))
    points = {r.point: r for r in M.lift_curve(df).collect()}
    assert len(points) == 10
    assert points[1].gain == pytest.approx(1.0) and points[1].lift == pytest.approx(10.0, rel=1e-4)
    assert points[10].gain == pytest.approx(0.1)


def test_scores_and_probabilities_round_trip(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.05, 0.2, 0.5, 0.0, 1.0)], "p double")
    rows = df.select("p", PointsScale().points(F.col("p")).alias("s"), PointsScale().probability(PointsScale().points(F.col("p"))).alias("q")).collect()
    assert all(300 <= r.s <= 900 for r in rows)
    assert all(r.q == pytest.approx(r.p) for r in rows[:3])


def test_base_odds_give_the_base_score(spark):
    s = spark.range(1).select(PointsScale().points(F.lit(1 / 21)).alias("s")).first().s
    assert s == pytest.approx(650.0)


def test_psi_sees_a_shift(spark):
    rows = [("train", float(x)) for x in (0.1, 0.2, 0.3, 0.4, 0.5)] + [("valid", float(x)) for x in (0.1, 0.1, 0.1, 0.5, 0.9)]
    df = spark.createDataFrame(rows, "split string, x double")
    for shared in (False, True):
        assert psi(df, "split", "train", ["valid"], ["x"], shared_bins=shared).first().psi > 0.1
    assert psi(df.withColumn("x", F.lit(1.0)), "split", "train", ["valid"], ["x"]).first().psi == pytest.approx(0.0)


def test_fairness_drops_small_groups_and_keeps_one_class_groups(spark):
    rows = [("a", i % 2, i / 100) for i in range(60)] + [("b", 0, 0.5)] * 55 + [("c", 1, 0.5)] * 5 + [(None, 1, 0.1)] * 70
    df = spark.createDataFrame(rows, "g string, y int, p double")
    out = {r.group: r for r in fairness_report(df, ["g", "nope"], "y", "p").collect()}
    assert set(out) == {"a", "b"}
    assert out["b"].auc is None and out["a"].auc > 0.5


# -- splits ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,want", [(1, (1, 1)), (2, (1, 2)), (3, (1, 2)), (5, (3, 4)), (10, (6, 8)), (1000, (600, 800))])
def test_share_positions(n, want):
    train_end, valid_end = X.share_positions(n)
    assert train_end == want[0]
    assert train_end <= valid_end <= n
    if n >= 3:
        assert (train_end, valid_end) == want and valid_end < n


def test_position_split_of_three_rows_fills_every_part(spark):
    df = spark.sql("select id, timestamp_ntz'2020-01-01' as d from range(3)")
    parts = X.split_by_time(df, "d", "2030-01-01", "2031-01-01", "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 1, "valid": 1, "oot": 1}


def test_group_folds_keep_customers_together(spark):
    df = spark.sql("select id, id % 37 as g, timestamp_ntz'2020-01-01' + make_interval(0,0,0,cast(id % 50 as int)) as d from range(400)")
    out = X.group_folds(df, "d", "g", 3)
    assert out.groupBy("g").agg(F.count_distinct("block").alias("n")).filter("n > 1").count() == 0
    sizes = {r.block: r.n for r in out.groupBy("block").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {0: 10, 1: 9, 2: 9, 3: 9}


def test_hash_sample_is_repeatable_and_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in X.hash_sample(df, "k", 100).collect()}
    b = {r.k for r in X.hash_sample(df.repartition(7), "k", 100).collect()}
    assert a == b and len(a) == 100
    assert X.hash_sample(df, "k", 5000).count() == 1000


# -- preprocessing and binning ---------------------------------------------------------------------------


def toy(spark):
    return spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0), ("c", 1)], "cat string, y int")


def test_target_encoders_stay_in_the_unit_interval(spark):
    df = toy(spark).withColumn("id", F.monotonically_increasing_id())
    rows = P.encode_sigmoid_target(df, ["cat"], "y").collect()
    assert len(rows) == 6 and all(0 <= r.cat_encoded <= 1 for r in rows)
    folds = P.encode_target_out_of_fold(df, "cat", "y", X.hash_fold("id", 2), min_leaf=1).collect()
    assert len(folds) == 6 and all(0 <= r.cat_encoded <= 1 for r in folds)


def test_unseen_empty_missing_and_rare_levels(spark):
    train = spark.createDataFrame([("A",)] * 50 + [(" a ",)] * 40 + [("rare",)] + [("",)] * 5 + [(None,)] * 4, "c string").withColumn("y", F.lit(1))
    state = P.fit_categories(train, ["c"], "y", rare=0.05)
    assert state["c"].levels == ["__empty__", "__missing__", "__other__", "a"]
    new = spark.createDataFrame([("a",), ("zzz",), (None,), (" ",)], "c string")
    rows = new.select(*P.category_expressions(new, state, "frequency", 0.5)).collect()
    assert [tuple(r) for r in rows] == [(0, 0.9), (0, 0.01), (1, 0.04), (0, 0.05)]
    hot = new.select(*P.category_expressions(new, state, "onehot", 0.5))
    assert hot.columns == ["c_was_missing", "c___empty__", "c___missing__", "c___other__", "c_a"]
    assert [sum(r[1:]) for r in hot.collect()] == [1, 1, 1, 1]


def test_prep_model_survives_saving(spark, tmp_path):
    df = spark.sql("select id as customer_ref, id % 3 as y, cast(id as double) as x, concat('l', id % 4) as c, exp(id / 20) as z from range(400)")
    df = df.withColumn("y", (F.col("y") == 0).cast("int"))
    cfg = P.PrepConfig(target="y", log_skew=0.5, encoding="target", woe=True, min_samples=10, scale=True)
    model = P.fit_prep(df, cfg)
    model.save(spark, str(tmp_path / "prep"))
    again = P.PrepModel.load(spark, str(tmp_path / "prep"))
    a, b = model.transform(df), again.transform(df)
    assert a.columns == b.columns == model.feature_names
    assert a.exceptAll(b).count() == 0


def test_bins_are_right_closed_with_the_lowest_edge_in(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 2.0, 2.1)] + [(None,)], "x double")
    assert [r[0] for r in df.select(W.bin_number(F.col("x"), [0.0, 1.0, 2.0])).collect()] == [None, 1, 1, 2, 2, None, None]


def test_constant_columns_have_no_edges(spark):
    df = spark.sql("select cast(1 as double) as a, cast(null as double) as b, cast(id as double) as c from range(20)")
    assert list(W.bin_edges(df, ["a", "b", "c"], 4)) == ["c"]


@pytest.mark.parametrize("seed", [1, 2])
def test_woe_never_falls(spark, seed):
    rng = np.random.default_rng(seed)
    df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(rng.normal(size=900), rng.random(900) < 0.3)], "x double, y int")
    t = [r.woe for r in W.woe_table(df, W.bin_edges(df, ["x"], 6), "y", 20).orderBy("bin").collect()]
    assert len(t) == 6 and all(b >= a for a, b in zip(t, t[1:]))


def test_histogram_of_a_constant(spark):
    rows = S.histogram(spark.sql("select 3.0D as x from range(7)"), ["x"], 4).collect()
    assert sum(r.n for r in rows) == 7 and len(rows) == 4


# -- joins and diagnostics -------------------------------------------------------------------------------


def test_merge_keeps_the_last_duplicate_and_renames_clashes(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    right = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (None, 3, "none")], "k int, o int, v string")
    rows = {r.k: r for r in left_merge(base, right, ["k"], "r", ["o"]).collect()}
    assert rows[1].v_r == "new" and rows[2].v_r is None and rows[None].v_r is None
    assert left_merge(base, right.select("o"), ["k"], "r") is base
    got = merge_coverage(base, right, ["k"], "r").first()
    assert got.coverage == pytest.approx(1 / 3) and got.right_rows == 2


def test_level_codes_follow_the_sorted_text(spark):
    texts = ["item-0003", "item-0001", "item-0200", "item-0100", "item-0002", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.level: int(r.code) for r in D.level_codes(df, "t").collect()}
    assert got == {t: i for i, t in enumerate(sorted(t for t in texts if t))}


def test_verdicts(spark):
    df = spark.sql("select id, cast(id % 2 as int) as y, cast(id % 2 as double) as leak, 1.0D as flat, cast(pmod(hash(id), 50) as double) as noise from range(2000)")
    rows = {r.feature: r for r in D.diagnose(df, None, ["leak", "flat", "noise"], "y").collect()}
    assert rows["leak"].suspicious == 1 and rows["leak"].auc_train == pytest.approx(1.0)
    assert rows["flat"].low_variance == 1 and rows["flat"].auc_train == 0.5
    assert rows["noise"].suspicious == 0 and abs(rows["noise"].spearman) < 0.1


def test_text_keys_can_order_positions(spark):
    df = spark.sql("select concat('id-', id) as id, timestamp_ntz'2020-01-01' as d, concat('g', id % 9) as g from range(90)")
    parts = {r["split"]: r["count"] for r in X.position_split(df, "d", "id").groupBy("split").count().collect()}
    assert parts == {"train": 54, "valid": 18, "oot": 18}
    blocks = X.group_folds(df, "d", "g", 2).groupBy("block").agg(F.count_distinct("g").alias("n"))
    assert {r["block"]: r["n"] for r in blocks.collect()} == {0: 3, 1: 3, 2: 3}
    assert X.hash_sample(df, "id", 30).count() == 30
