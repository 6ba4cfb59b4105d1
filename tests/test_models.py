"""Models, calibration, blends, jobs and streaming on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.functions.scorecard import PointsScale
from creditloom.operators import calibrate as K
from creditloom.operators import explain as E
from creditloom.operators import jobs as J
from creditloom.operators import models as L
from creditloom.operators.history import HistoryConfig
from creditloom.operators.prep import PrepConfig
from creditloom.operators.features import FeatureSpec, interaction_candidates, smart_interactions
from creditloom.sources.inventory import dataset_paths, scan_folder
from creditloom.sources.readers import SourceConfig, file_profile, guess_encoding, load_master, read_dataset
from creditloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x1, x2 = rng.normal(size=1500), rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(1 - 1.5 * x1 + 0.5 * x2))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))], "id long, x1 double, x2 double, target int")
    return df.cache()


def newton(x, y, w):
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - y)) + penalty @ beta
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, grad)
    return beta


def test_logistic_equals_a_newton_solve(spark, table):
    pdf = table.toPandas()
    w = np.where(pdf.target == 1, 1.7, 0.6)
    coefs, intercept = L.logistic_fit(
        table.withColumn("w", F.when(F.col("target") == 1, 1.7).otherwise(0.6)), ["x1", "x2"], "target", "w", float(w.sum())
    )
    assert [*coefs, intercept] == pytest.approx(list(newton(pdf[["x1", "x2"]].values, pdf.target.values, w)), abs=1e-4)


def test_champion_scores_are_probabilities_and_reasons_sum_up(spark, table):
    model = L.train_champion(table, "target", ["x1", "x2"])
    scored = model.score(table, "p")
    assert scored.filter((F.col("p") < 0) | (F.col("p") > 1) | F.col("p").isNull()).count() == 0
    assert L.measure(model, table, "target")["roc_auc"] > 0.7
    reasons = E.champion_reasons(model, table, ["id"], top_k=2).join(scored, "id")
    logit = F.ln(F.col("p") / (1 - F.col("p"))) - model.intercept
    total = F.aggregate("factors", F.lit(0.0), lambda a, f: a + f["contribution"])
    assert reasons.filter(F.abs(logit - total) > 1e-9).count() == 0
    first = reasons.select((F.abs(F.col("factors")[0]["contribution"]) >= F.abs(F.col("factors")[1]["contribution"])).alias("ok"))
    assert first.filter("not ok").count() == 0


def test_missing_inputs_count_as_zero(spark, table):
    model = L.train_champion(table, "target", ["x1", "x2"])
    a = model.score(table.drop("x2"), "p").select("id", "p")
    b = model.score(table.withColumn("x2", F.lit(0.0)), "p").select("id", "p")
    assert a.exceptAll(b).count() == 0


def test_trees_blend_and_choice(spark, table):
    trees = L.train_trees(table, "target", ["x1", "x2"], maxIter=3, maxDepth=2)
    champion = L.train_champion(table, "target", ["x1", "x2"])
    both = L.train_ensemble([champion, trees], table, "target", trials=5, min_weight=0.1)
    assert sum(both.weights) == pytest.approx(1.0)
    assert both.metrics["optimized_roc_auc"] >= max(L.measure(m, table, "target")["roc_auc"] for m in (champion, trees)) - 1e-12
    assert set(trees.importances()) == {"x1", "x2"}
    lost = L.permutation_importance(trees, table, "target", "id", ["x1", "x2"])
    assert lost["x1"] > lost["x2"]


def test_production_choice_skips_suspicious_and_small_gains():
    def model(name, auc, bad=False):
        return L.TrainedModel(name, [], {"roc_auc": auc}, bad)

    champion = model("champion", 0.70)
    assert L.choose_production([model("a", 0.704)], champion).name == "champion"
    assert L.choose_production([model("a", 0.71), model("b", 0.9, True), model("c", 0.995)], champion).name == "a"
    assert L.is_suspicious({"roc_auc": 0.995}) and L.is_suspicious({"brier": 0.00005}) and not L.is_suspicious({"roc_auc": 0.8, "brier": 0.1})


def test_random_points_and_candidates_are_repeatable():
    space = {"depth": (2, 4), "rate": (0.1, 0.5)}
    assert L.random_points(space, 5) == L.random_points(space, 5)
    assert len({tuple(p.values()) for p in L.random_points(space, 100)}) == 60
    c = L.blend_candidates(3, 10, 0.05)
    assert len(c) == 14 and all(sum(w) == pytest.approx(1.0) for w in c)
    assert c[1] == [1.0, 0.0, 0.0] and min(min(w) for w in c[4:]) > 0.03


def test_shuffled_labels_keep_the_class_counts(spark, table):
    out = L.shuffled_labels(table, "target", "id", 20000)
    assert out.count() == table.count()
    assert out.agg(F.sum("target")).first()[0] == table.agg(F.sum("target")).first()[0]
    assert out.join(table.select("id", F.col("target").alias("t")), "id").filter("target <> t").count() > 100


def test_calibration(spark, table):
    scored = L.train_champion(table, "target", ["x1", "x2"]).score(table, "p").select(F.col("target").alias("y"), "p")
    iso = K.fit_isotonic(scored).apply(scored, "p", "c")
    rows = iso.orderBy("p").collect()
    assert all(b.c >= a.c - 1e-12 for a, b in zip(rows, rows[1:]))
    assert sum(r.c for r in rows) == pytest.approx(sum(r.y for r in rows))
    outside = K.fit_isotonic(scored).apply(spark.createDataFrame([(-1.0,), (2.0,)], "p double"), "p", "c").collect()
    assert (outside[0].c, outside[1].c) == pytest.approx((rows[0].c, rows[-1].c))
    best, found = K.fit_best(scored)
    assert found[f"{best.method}_brier"] == min(found.values())


def test_stacking_beats_or_falls_back_to_the_mean(spark, table):
    def fit(df):
        return L.train_trees(df, "target", ["x1", "x2"], maxIter=2, maxDepth=2)

    def forest(df):
        return L.train_trees(df, "target", ["x1", "x2"], "forest", numTrees=3, maxDepth=3)

    m = L.train_stacking([fit, forest], [fit(table), forest(table)], table, table, "target", "id", folds=2)
    assert (m.coefficients is not None) == (m.metrics["stacking_auc"] > m.metrics["averaging_auc"])
    assert m.score(table, "p").filter("p < 0 or p > 1").count() == 0


def test_stream_scores_equal_batch_scores(spark, table, tmp_path):
    model = L.train_champion(table, "target", ["x1", "x2"])
    scorer = J.Scorer(model, None, PointsScale())
    rows = table.select("id", "x1", "x2")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = score_stream(spark, str(tmp_path / "in"), rows.schema, scorer, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], 1)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = J.score_job(rows, scorer, ["id"])
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_smart_interactions_skip_ids_and_weak_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "t")], "income double, ratio double, num_calls double, text string")
    ranked = [("income", -0.4), ("num_calls", 0.3), ("text", 0.2), ("ratio", 0.1), ("gone", 0.09)]
    chosen = interaction_candidates(ranked, df, top_k=5, min_spearman=0.05)
    assert chosen == ["income", "ratio"]
    assert interaction_candidates(ranked, df, top_k=5, min_spearman=0.2) == ["income"]
    row = df.select(*[c.alias(n) for n, c in smart_interactions(df, chosen).items()]).first()
    assert row["ix_income_x_ratio"] == 2.0 and row["ix_ratio_div_income"] == 2.0 and row["ix_income_minus_ratio"] == -1.0


def test_spec_from_config_keeps_defaults():
    spec = FeatureSpec.from_config({"rolling_windows": [2], "event_markers": {"a": {"column": "x", "threshold": 3}}})
    assert spec.rolling_windows == [2] and spec.event_markers["a"].threshold == 3.0
    assert spec.volatility_features == FeatureSpec().volatility_features
    assert FeatureSpec.from_config({}) == FeatureSpec()


# -- sources ---------------------------------------------------------------------------------------------


def test_cyrillic_csv_is_recognised(spark, tmp_path):
    path = tmp_path / "clients.csv"
    path.write_bytes("client_id;issue_date;default_flag;имя\n1;01.02.2020;0;Анна\n2;03.04.2021;1;Борис\n".encode("cp1251"))
    row = file_profile(spark, str(tmp_path)).first()
    assert (row.encoding, row.delimiter) == ("cp1251", ";")
    df = read_dataset(spark, str(path))
    assert df.columns == ["client_id", "issue_date", "default_flag", "имя"]
    assert [r["имя"] for r in df.orderBy("client_id").collect()] == ["Анна", "Борис"]
    inv = scan_folder(spark, str(tmp_path)).filter("target_candidate = 1").collect()
    assert [r.column_name for r in inv] == ["default_flag"]


def test_mixed_folder_gives_one_summary_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text('{"x": 1, "y": null}\n{"x": 2, "y": 5}\n')
    (tmp_path / "note.md").write_text("skip me")
    assert len(dataset_paths(spark, str(tmp_path))) == 2
    rows = {(r.dataset, r.column_name): r for r in scan_folder(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    assert rows["b.jsonl", "y"].null_fraction == 0.5 and rows["a.csv", "x"].unique == 2


def test_encodings():
    assert guess_encoding("naïve".encode()) == "utf-8"
    assert guess_encoding("naïve".encode()[:3]) == "utf-8"
    assert guess_encoding("Отчёт за январь".encode("cp1251")) == "cp1251"
    assert guess_encoding("café crème brûlée".encode("cp1252")) == "cp1252"


def test_master_needs_only_the_applications(spark, tmp_path):
    (tmp_path / "application_metadata.csv").write_text("client_ref,customer_id,account_open_year,default\nx,7,2020,1\n")
    master, history = load_master(spark, SourceConfig(str(tmp_path)))
    row = master.first()
    assert row.customer_ref == "7" and str(row.application_date) == "2020-06-30 00:00:00" and history is None
    with pytest.raises(RuntimeError):
        load_master(spark, SourceConfig(str(tmp_path / "none")))


def test_dataset_job_with_every_source(spark):
    apps = spark.sql("select id as application_id, concat(' ', id % 40) as client_id, timestamp_ntz'2021-06-01' as application_date, cast(id % 3 = 0 as int) as target from range(200)")
    people = spark.sql("select cast(id as string) as cust_id, cast(20 + id as double) as age, concat('job', id % 3) as job from range(40)")
    loans = spark.sql("select cast(id % 40 as string) as customer_id, id as application_id, id * 10.0D as loan_amount from range(200)")
    ratios = spark.sql("select cast(id as string) as cust_num, id / 50 as debt_ratio from range(30)")
    past = spark.sql(
        "select cast(id % 40 as string) as customer_number, timestamp_ntz'2020-12-01' + make_interval(0, cast(id % 9 as int)) as statement_date, "
        "cast(id % 70 as double) as dpd, id * 2.0D as balance, 100.0D as due_amount, cast(id % 90 as double) as payment_amount, 1000.0D as credit_limit, 50.0D as min_payment from range(400)"
    )
    sources = {"application": apps, "demographics": people, "loan_details": loans, "financial_ratios": ratios, "credit_history": past}
    made = J.build_dataset(sources, PrepConfig(drop=("application_date",), min_samples=5), HistoryConfig(), advanced_history=True, keep=["application_id"])
    assert made.features.count() == 200
    columns = set(made.features.columns)
    assert {"age", "loan_amount", "debt_ratio", "dpd_value_mean", "dpd_30_flag_count", "balance_roll_mean_3", "beh_dpd_rate_6m", "job_freq", "default"} <= columns
    cover = {r["name"]: r["coverage"] for r in made.coverage.collect()}
    assert cover == pytest.approx({"demographics": 1.0, "loan_details": 1.0, "financial_ratios": 0.75, "credit_history": 1.0})
    assert made.prep.weights[1] == pytest.approx(200 / (2 * 67))
