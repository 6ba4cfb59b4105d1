"""Master-table joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.joins import left_merge, merge_coverage, star_join
from creditloom.workload.base import Views, query


@query(
    "merge_left_dedup",
    """
with r as (
  select customer_ref, application_id, application_date, loan_amount, account_status as region,
    row_number() over (partition by customer_ref order by application_date desc, application_id desc) as rn
  from {application} a)
select d.customer_ref, d.employment_type, d.region, d.monthly_income, d.age,
  r.application_id, r.application_date, r.loan_amount, r.region as region_loan
from {demographics} d left join r on d.customer_ref = r.customer_ref and r.rn = 1""",
)
def merge_left_dedup(v: Views) -> DataFrame:
    right = v.application.select(
        "customer_ref", "application_id", "application_date", "loan_amount", F.col("account_status").alias("region")
    )
    return left_merge(v.demographics, right, ["customer_ref"], "loan", order=["application_date", "application_id"])


@query(
    "merge_coverage",
    """
with d as (select customer_ref from {demographics} x where age < 40),
h as (select distinct customer_ref, l_orderkey as application_id from {history} x where dpd >= 90)
select 'demographics' as name, round(avg(case when a.customer_ref in (select customer_ref from d) then 1.0 else 0.0 end), 6) as coverage,
  (select cast(count(*) as bigint) from d) as right_rows from {application} a
union all
select 'loan_details', round(avg(case when a.customer_ref in (select customer_ref from h) then 1.0 else 0.0 end), 6),
  (select cast(count(*) as bigint) from h) from {application} a""",
)
def coverage(v: Views) -> DataFrame:
    young = v.demographics.filter(F.col("age") < 40)
    late = v.history.filter(F.col("dpd") >= 90).select("customer_ref", F.col("l_orderkey").alias("application_id"))
    a = merge_coverage(v.application, young, ["customer_ref"], "demographics")
    b = merge_coverage(v.application, late, ["customer_ref", "application_id"], "loan_details")
    return a.unionByName(b).select("name", F.round("coverage", 6).alias("coverage"), F.col("right_rows").cast("bigint").alias("right_rows"))


@query(
    "star_join",
    """
with loans as (select l_orderkey as customer_ref, l_quantity as age, l_linenumber as line_no, l_partkey as part from lineitem)
select d.customer_ref, d.age, d.region, l.age as age_loan, l.line_no, l.part
from {demographics} d left join loans l on d.customer_ref = l.customer_ref""",
)
def star(v: Views) -> DataFrame:
    loans = v.lineitem.select(
        F.col("l_orderkey").alias("customer_ref"),
        F.col("l_quantity").alias("age"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part"),
    )
    base = v.demographics.select("customer_ref", "age", "region")
    return star_join(base, [(loans, "_loan")], "customer_ref")
