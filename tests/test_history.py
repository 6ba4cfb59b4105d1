"""Point-in-time features against row-by-row pandas, with a heavy customer and tied dates."""

import numpy as np
import pandas as pd
import pytest

from creditloom.operators.history import HistoryConfig, history_features

CFG = HistoryConfig(tiebreak=("rid",), numeric=("debt_balance",))


def data(seed=0, customers=12, statements=500, applications=60):
    rng = np.random.default_rng(seed)
    hot = rng.random(statements) < 0.4
    h = pd.DataFrame(
        {
            "customer_ref": np.where(hot, 1, rng.integers(2, customers, statements)),
            "statement_date": pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.integers(0, 700, statements), unit="D"),
            "rid": rng.permutation(statements),
            "dpd_a": np.where(rng.random(statements) < 0.5, 0.0, rng.integers(1, 100, statements)).astype(float),
            "overdue_b": rng.integers(0, 40, statements).astype(float),
            "payment_amount": rng.integers(0, 5, statements).astype(float) * 100,
            "debt_balance": rng.normal(1e5, 10, statements).round(2),
            "revolving_balance": rng.integers(0, 1000, statements).astype(float),
            "credit_limit": rng.integers(0, 3, statements).astype(float) * 1000,
            "min_payment": np.full(statements, 150.0),
        }
    )
    for c in ("dpd_a", "payment_amount", "debt_balance"):
        h.loc[rng.random(statements) < 0.1, c] = np.nan
    a = pd.DataFrame(
        {
            "application_id": np.arange(applications),
            "customer_ref": np.where(rng.random(applications) < 0.4, 1, rng.integers(2, customers + 2, applications)),
            "application_date": pd.Timestamp("2020-09-01 13:00") + pd.to_timedelta(rng.integers(0, 400, applications), unit="D"),
        }
    )
    return h, a


def to_spark(spark, pdf):
    kinds = {c: "timestamp_ntz" if "date" in c else "double" if pdf[c].dtype.kind == "f" else "long" for c in pdf.columns}

    def plain(v):
        return None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    rows = [tuple(plain(v) for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in kinds.items())).repartition(4)


def slope(y):
    y = y.dropna()
    if y.empty:
        return np.nan
    return 0.0 if len(y) < 2 else float(np.polyfit(np.arange(len(y)), y.values, 1)[0])


def expected(h, app):
    upper, out = app.application_date, {}
    rows = h[(h.customer_ref == app.customer_ref) & (h.statement_date <= upper)].sort_values(["statement_date", "rid"])
    for k in (3, 6, 12):
        w = rows[rows.statement_date >= upper - pd.DateOffset(months=k)]
        if w.empty:
            continue
        dpd = w[["dpd_a", "overdue_b"]].max(axis=1)
        util = w.revolving_balance / w.credit_limit.replace(0, np.nan)
        pay, bal = w.payment_amount, w.debt_balance
        out |= {
            f"credit_history_records_{k}m": len(w),
            f"dpd_max_{k}m": dpd.max(),
            f"dpd_mean_{k}m": dpd.mean(),
            f"num_late_payments_{k}m": (dpd > 0).sum(),
            f"utilization_avg_{k}m": util.mean(),
            f"payment_to_debt_ratio_{k}m": (pay / bal).mean(),
            f"beh_dpd_cnt_ge30_{k}m": (dpd >= 30).sum(),
            f"beh_dpd_rate_{k}m": (dpd > 0).mean(),
            f"beh_payment_std_{k}m": 0.0 if pay.dropna().empty else pay.std(ddof=0),
            f"beh_balance_std_{k}m": 0.0 if bal.dropna().empty else bal.std(ddof=0),
            f"beh_util_std_{k}m": util.fillna(0).std(ddof=0),
            f"beh_underpayment_rate_{k}m": (pay < w.min_payment).mean(),
            f"beh_balance_delta_{k}m": np.nan if bal.dropna().empty else bal.dropna().iloc[-1] - bal.mean(),
        }
        if k >= 6:
            out[f"beh_balance_slope_{k}m"] = slope(bal)
            out[f"beh_util_slope_{k}m"] = slope(util.fillna(0))
        if k == 6:
            b = bal.dropna()
            out["trend_balance_6m"] = np.nan if b.empty else (b.iloc[-1] - b.iloc[0] if len(b) > 1 else 0.0)
        if k == 12:
            was = (dpd > 0).astype(int)
            out["beh_recovery_episodes_12m"] = int(((was == 0) & (was.shift(1).fillna(0) == 1)).sum())
            out["beh_payment_slope_12m"] = slope(pay.replace(0, np.nan))
            out["debt_balance_mean_hist"] = bal.mean()
            out["credit_history_records"] = len(w)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_windows_equal_brute_force(spark, seed):
    h, a = data(seed)
    got = history_features(to_spark(spark, h), to_spark(spark, a), CFG).toPandas().set_index("application_id")
    assert len(got) == len(a)
    columns = set()
    for app in a.itertuples():
        want = expected(h, app)
        columns |= set(want)
        row = got.loc[app.application_id]
        for c, v in want.items():
            np.testing.assert_allclose(float(row[c]) if row[c] is not None else np.nan, v, rtol=1e-7, atol=1e-7, err_msg=c)
        for c in columns - set(want):
            assert pd.isna(row[c]), c
    assert len(columns) > 45


def test_later_statements_change_nothing(spark):
    h, a = data(3)
    cut = a.application_date.max()
    late = h.assign(statement_date=cut + pd.Timedelta(days=1), dpd_a=99.0, rid=h.rid + 10_000)
    one = history_features(to_spark(spark, h[h.statement_date <= cut]), to_spark(spark, a), CFG)
    two = history_features(to_spark(spark, pd.concat([h[h.statement_date <= cut], late])), to_spark(spark, a), CFG)
    x = one.toPandas().sort_values("application_id").reset_index(drop=True)
    y = two.toPandas().sort_values("application_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_missing_ids_and_dates_give_null_features(spark):
    h = spark.createDataFrame([(1, 1, None, 5.0), (None, 2, None, 5.0)], "customer_ref long, rid long, d string, dpd double")
    h = h.selectExpr("customer_ref", "rid", "timestamp_ntz'2020-05-01' as statement_date", "dpd")
    a = spark.sql(
        "select * from values (1, 1, timestamp_ntz'2020-06-01'), (2, null, timestamp_ntz'2020-06-01'), (3, 1, null) as t(application_id, customer_ref, application_date)"
    )
    rows = {r["application_id"]: r["dpd_max_3m"] for r in history_features(h, a, HistoryConfig(tiebreak=("rid",))).collect()}
    assert rows == {1: 5.0, 2: None, 3: None}


def test_times_of_day_fold_without_changing_a_window(spark):
    h, a = data(4)
    a.loc[::3, "application_date"] = a.loc[::3, "application_date"].dt.normalize()
    left, right = to_spark(spark, h), to_spark(spark, a)
    plain = history_features(left, right, CFG).toPandas().sort_values("application_id").reset_index(drop=True)
    dated = left.withColumn("statement_date", left["statement_date"].cast("date"))
    folded = history_features(dated, right, CFG).toPandas().sort_values("application_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(plain, folded, check_dtype=False, rtol=1e-9, atol=1e-9)
