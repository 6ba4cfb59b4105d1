"""Query registry and the views the registered queries run on.

Each view is one SQL text.  Spark runs it over the Parquet tables, the check runs the same text as a
CTE, so both sides see the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.plans.session import tune

VIEW_SQL: dict[str, str] = {
    "bad": """
select l_orderkey as application_id,
       max(case when l_returnflag = 'R' and l_quantity >= 40 then 1 else 0 end) as bad
from {lineitem} group by l_orderkey""",
    "application": """
select o_orderkey as application_id, o_custkey as customer_ref, o_orderdate as application_date,
       o_totalprice as loan_amount, o_orderpriority as loan_purpose, o_orderstatus as account_status,
       coalesce(b.bad, 0) as default_flag
from {orders} o left join {bad} b on o_orderkey = b.application_id""",
    "demographics": """
select c_custkey as customer_ref, c_mktsegment as employment_type, r_name as region,
       case when c_acctbal < 0 then null else c_acctbal end as monthly_income,
       cast(18 + c_custkey % 50 as int) as age
from {customer} c join {nation} n on c_nationkey = n_nationkey join {region} r on n_regionkey = r_regionkey""",
    "history": """
select o_custkey as customer_ref, l_shipdate as statement_date,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_extendedprice as revolving_balance,
       case when l_linenumber = 3 then null else l_quantity * cast(500 as double) end as payment_amount,
       l_extendedprice * cast(0.1 as double) as min_payment,
       l_extendedprice * cast(0.1 as double) as due_amount,
       case when l_linenumber = 7 then cast(0 as double) else cast(110000 as double) end as credit_limit,
       case when l_linestatus = 'F' and <days> > 0 then cast(<days> % 120 as int) else 0 end as dpd
from {lineitem} l join {orders} o on l_orderkey = o_orderkey""",
    "scored": """
select application_id, customer_ref, application_date, default_flag as y,
       cast((application_id * 7919) % 1001 as double) / cast(1000 as double) as p
from {application} a""",
    "doc_risk": """
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "panel": """
select a.application_id, a.customer_ref, a.application_date, a.loan_amount, a.loan_purpose, a.account_status,
       a.default_flag, d.employment_type, d.region, d.monthly_income, d.age
from {application} a left join {demographics} d on a.customer_ref = d.customer_ref""",
    "event_flags": """
select event_id, user_id, ts, event_type, value, case when event_type = 'error' then 1 else 0 end as error_flag
from {events} e""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DAYS = {
    "spark": "date_diff(l_shipdate, o_orderdate)",
    "duckdb": "date_diff('day', o_orderdate, l_shipdate)",
}


class Views:
    """Lazy DataFrames over one data directory: raw tables and the views above."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = str(sf_dir).rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.dir}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEW_SQL:
            sql = VIEW_SQL[name].replace("<days>", DAYS["spark"])
            parts = {used: getattr(self, used) for used in _used(sql)}
            return self.spark.sql(sql, **parts)
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        raise AttributeError(name)


def _used(sql: str) -> list[str]:
    return [name for name in [*VIEW_SQL, *TABLES] if "{" + name + "}" in sql]


def _ctes(names: list[str], done: list[str]) -> None:
    for name in names:
        if name in VIEW_SQL and name not in done:
            _ctes(_used(VIEW_SQL[name]), done)
            done.append(name)


def oracle(sql: str) -> str:
    """Expand ``{view}`` references into leading CTEs; raw tables keep their own names."""
    needed: list[str] = []
    _ctes(_used(sql), needed)
    body = sql
    heads = []
    for name in needed:
        text = VIEW_SQL[name].replace("<days>", DAYS["duckdb"])
        heads.append(f"{name} as ({text})")
    text = ",\n".join(heads)
    body = sql.strip()
    if heads:
        if body.lower().startswith("with "):
            body = f"with {text},\n{body[5:]}"
        else:
            body = f"with {text}\n{body}"
    for name in [*VIEW_SQL, *TABLES]:
        body = body.replace("{" + name + "}", name)
    return body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with the SQL that must give the same rows."""

    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register
