"""Readers, sinks, inventories, identifier and cleaning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions import clean as C
from creditloom.plans.session import scratch_path
from creditloom.sources.inventory import inventory, scan_folder
from creditloom.sources.readers import SourceConfig, file_profile, load_master, read_dataset, write_output
from creditloom.workload.base import TABLES, VIEW_SQL, Views, query

DEMO = "select customer_ref, employment_type, region, monthly_income, cast(age as int) as age from {demographics} d"


def _typed(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("customer_ref").cast("bigint").alias("customer_ref"),
        "employment_type",
        "region",
        F.col("monthly_income").cast("double").alias("monthly_income"),
        F.col("age").cast("int").alias("age"),
    )


@query("src_csv_roundtrip", DEMO)
def src_csv_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "demo") + ".csv"
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    v.demographics.write.options(header=True, sep=";", encoding="cp1251").csv(path)
    return _typed(read_dataset(v.spark, path))


@query("src_jsonl_roundtrip", DEMO)
def src_jsonl_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "demo") + ".jsonl"
    v.demographics.write.json(path)
    return _typed(read_dataset(v.spark, path))


@query("src_xml_roundtrip", DEMO)
def src_xml_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "demo") + ".xml"
    v.demographics.write.option("rowTag", "row").xml(path)
    return _typed(read_dataset(v.spark, path))


@query(
    "src_parquet",
    "select cast(count(*) as bigint) as n, round(sum(l_extendedprice), 2) as total, min(l_shipdate) as first_date from lineitem",
)
def src_parquet(v: Views) -> DataFrame:
    df = read_dataset(v.spark, v.path("lineitem"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("l_shipdate").alias("first_date"))


@query("sink_roundtrip", "select application_id, customer_ref, application_date, loan_amount, default_flag from {application} a")
def sink_roundtrip(v: Views) -> DataFrame:
    df = v.application.select("application_id", "customer_ref", "application_date", "loan_amount", "default_flag")
    return v.spark.read.parquet(write_output(df, scratch_path(v.spark, "out") + ".parquet"))


@query("file_profile")
def file_profile_query(v: Views) -> DataFrame:
    base = scratch_path(v.spark, "profile")
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    v.demographics.write.options(header=True, sep=";", encoding="cp1251").csv(f"{base}/a.csv")
    v.demographics.write.options(header=True, sep="\t").csv(f"{base}/b.csv")
    v.demographics.write.json(f"{base}/c.jsonl")
    return file_profile(v.spark, base)


TARGET_RX = "'target|label|default|bad|overdue|dpd|delinq'"
DATE_RX = "'date|dt|report|issue|created|time'"
SCHEMAS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def _inventory_sql(dataset: str, columns: list[str], source: str) -> str:
    return "\nunion all\n".join(
        f"select '{dataset}' as dataset, cast(count(*) as bigint) as n_rows, {len(columns)} as n_cols, '{c}' as column_name, "
        f"round(1 - count({c}) / cast(count(*) as double), 4) as null_fraction, cast(count(distinct {c}) as bigint) as \"unique\", "
        f"cast(regexp_matches('{c.lower()}', {TARGET_RX}) as int) as target_candidate, cast(regexp_matches('{c.lower()}', {DATE_RX}) as int) as date_candidate from {source}"
        for c in columns
    )


INV = ["dataset", "n_rows", "n_cols", "column_name", "null_fraction", "unique", "target_candidate", "date_candidate"]
PANEL_COLS = "application_id customer_ref application_date loan_amount loan_purpose account_status default_flag employment_type region monthly_income age".split()


@query("inventory_columns", _inventory_sql("panel", PANEL_COLS, "{panel} x"))
def inventory_columns(v: Views) -> DataFrame:
    return inventory(v.panel.select(*PANEL_COLS), "panel").select(*INV)


@query("inventory_dir", "\nunion all\n".join(_inventory_sql(f"{t}.parquet", SCHEMAS[t].split(), t) for t in TABLES))
def inventory_dir(v: Views) -> DataFrame:
    return scan_folder(v.spark, v.dir).select(*INV)


FILES = {"a.csv": ("cp1251", ";"), "b.csv": ("utf-8", "\t"), "c.jsonl": ("utf-8", None)}
_FILE_COLUMNS = {
    ("a.csv", "customer_ref", "int"): "customer_ref", ("a.csv", "default_note", "string"): "region", ("b.csv", "customer_ref", "int"): "customer_ref",
    ("b.csv", "monthly_income", "double"): "monthly_income", ("c.jsonl", "age", "bigint"): "age",
}
INVENTORY_FILES = "\nunion all\n".join(
    f"select '{f}' as dataset, cast(count(*) as bigint) as n_rows, '{c}' as column_name, '{kind}' as dtype, "
    f"round(1 - count({source}) / cast(count(*) as double), 4) as null_fraction, cast(count(distinct {source}) as bigint) as \"unique\", "
    f"'{FILES[f][0]}' as encoding, {'null' if FILES[f][1] is None else chr(39) + FILES[f][1] + chr(39)} as delimiter, cast(null as varchar) as error from {{demographics}} d"
    for (f, c, kind), source in _FILE_COLUMNS.items()
) + "\nunion all\nselect 'd.parquet', null, null, null, null, null, 'utf-8', null, 'FAILED_READ_FILE'"


@query("inventory_files", INVENTORY_FILES)
def inventory_files(v: Views) -> DataFrame:
    """Files of several encodings and delimiters, and one that can't be read."""
    base = scratch_path(v.spark, "files")
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    people = v.demographics.withColumn("default_note", F.concat(F.col("region"), F.lit(" просрочка")))
    people.select("customer_ref", "default_note").write.options(header=True, sep=";", encoding="cp1251").csv(f"{base}/a.csv")
    people.select("customer_ref", "monthly_income").write.options(header=True, sep="\t").csv(f"{base}/b.csv")
    people.select("age").write.json(f"{base}/c.jsonl")
    people.select(F.col("customer_ref").cast("string").alias("value")).write.text(f"{base}/d.parquet")
    out = scan_folder(v.spark, base)
    return out.select("dataset", "n_rows", "column_name", "dtype", "null_fraction", "unique", "encoding", "delimiter", "error")


@query(
    "id_normalize",
    "select cast(customer_ref as varchar) as customer_ref, region, age from {demographics} d",
)
def id_normalize(v: Views) -> DataFrame:
    raw = v.demographics.select(F.concat(F.lit("  "), F.col("customer_ref").cast("string"), F.lit(" ")).alias("Cust_ID"), "region", "age")
    return C.normalize_id(raw, "demographics")


@query(
    "id_standardize",
    "select cast(customer_ref as varchar) as customer_ref, region from {demographics} d",
)
def id_standardize(v: Views) -> DataFrame:
    raw = v.demographics.select(F.col("customer_ref").alias("customer_number"), F.lit("x").alias("cust_num"), "region")
    return C.standardize_id(raw)


@query(
    "application_date",
    "select application_id, make_timestamp(extract(year from application_date), 6, 30, 0, 0, 0) as application_date from {application} a",
)
def application_date(v: Views) -> DataFrame:
    raw = v.application.select("application_id", F.year("application_date").alias("account_open_year"))
    return C.application_date(raw).select("application_id", "application_date")


VIEW_SQL["texts"] = """
select application_id, customer_ref, default_flag, application_date,
       case when application_id % 5 = 0 then null when application_id % 7 = 0 then 'n/a' else '$' || cast(cast(floor(loan_amount) as bigint) as string) || '.5' end as amount_text,
       case when application_id % 3 = 0 then '10+ years' when application_id % 3 = 1 then cast(customer_ref % 9 as string) || ' years' else '< 1 year' end as job_length,
       cast(cast(floor(loan_amount) as bigint) as string) || ' 200,50 so''m' as money,
       loan_purpose
from {application} a"""


@query(
    "auto_cast_numeric",
    """
select application_id, try_cast(nullif(regexp_replace(amount_text, '[^0-9.+-]', '', 'g'), '') as double) as amount_text,
  try_cast(nullif(regexp_replace(job_length, '[^0-9.+-]', '', 'g'), '') as double) as job_length,
  try_cast(nullif(regexp_replace(loan_purpose, '[^0-9.+-]', '', 'g'), '') as double) as loan_purpose
from {texts} t""",
)
def auto_cast_numeric(v: Views) -> DataFrame:
    return C.auto_cast_numeric(v.texts.select("application_id", "amount_text", "job_length", "loan_purpose"))


@query(
    "application_prepare",
    """
select cast(customer_ref as varchar) as customer_ref, application_id, application_date,
  case when application_id % 10 = 0 then 0 else default_flag end as "default" from {application} a""",
)
def application_prepare(v: Views) -> DataFrame:
    raw = v.application.select(
        F.concat(F.col("customer_ref").cast("string"), F.lit("  ")).alias("customer_ref"),
        "application_id",
        F.date_format("application_date", "yyyy-MM-dd").alias("application_date"),
        F.when(F.col("application_id") % 10 != 0, F.col("default_flag").cast("string")).alias("bad_flag"),
    )
    return C.prepare_applications(raw, date="application_date")


@query(
    "parse_dates",
    """
select application_id, case when application_id % 6 = 5 then null when application_id % 6 = 4 then date_trunc('year', application_date) else application_date end as parsed
from {application} a""",
)
def parse_dates(v: Views) -> DataFrame:
    d, k = F.col("application_date"), F.col("application_id") % 6
    text = (
        F.when(k == 0, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(d, "yyyy/MM/dd"))
        .when(k == 3, F.date_format(d, "yyyyMMdd"))
        .when(k == 4, F.date_format(d, "yyyy"))
        .otherwise(F.lit("unknown"))
    )
    return v.application.select("application_id", C.parse_dates(text).alias("parsed"))


@query("date_epoch", "select application_id, cast(epoch(application_date) as bigint) as seconds from {application} a")
def date_epoch(v: Views) -> DataFrame:
    return v.application.select("application_id", C.date_epoch(F.col("application_date")).alias("seconds"))


@query(
    "currency_normalize",
    "select application_id, try_cast(cast(cast(floor(loan_amount) as bigint) as varchar) || '200.50' as double) as money from {application} a",
)
def currency_normalize(v: Views) -> DataFrame:
    return v.texts.select("application_id", C.parse_currency(F.col("money")).alias("money"))


@query(
    "master_load",
    """
with d as (select customer_ref, employment_type, region, monthly_income, age from {demographics} x),
l as (select customer_ref, max(loan_amount) as loan_amount, cast(count(*) as bigint) as n_loans from {application} a group by customer_ref),
f as (select customer_ref, monthly_income * 12 as annual_income, age from {demographics} x where age < 60)
select cast(a.customer_ref as varchar) as customer_ref, a.application_id, a.application_date, a.loan_amount, a.default_flag,
  d.employment_type, d.monthly_income, d.age, l.loan_amount as loan_amount_loan, cast(l.n_loans as bigint) as n_loans, f.annual_income, f.age as age_fin
from {application} a left join d on a.customer_ref = d.customer_ref left join l on a.customer_ref = l.customer_ref left join f on a.customer_ref = f.customer_ref""",
)
def master_load(v: Views) -> DataFrame:
    base = scratch_path(v.spark, "sources")
    app = v.application.select("customer_ref", "application_id", "application_date", "loan_amount", "default_flag")
    write_output(app.withColumn("application_date", F.date_format("application_date", "yyyy-MM-dd")), f"{base}/application_metadata.csv")
    write_output(v.demographics.withColumnRenamed("customer_ref", "cust_id"), f"{base}/demographics.csv")
    loans = app.groupBy("customer_ref").agg(F.max("loan_amount").alias("loan_amount"), F.count(F.lit(1)).alias("n_loans"))
    write_output(loans.withColumnRenamed("customer_ref", "customer_id"), f"{base}/loan_details.parquet")
    ratios = v.demographics.filter("age < 60").select(F.col("customer_ref").alias("cust_num"), (F.col("monthly_income") * 12).alias("annual_income"), "age")
    ratios.write.json(f"{base}/financial_ratios.jsonl")
    master, _ = load_master(v.spark, SourceConfig(base))
    cols = "customer_ref application_id application_date loan_amount default_flag employment_type monthly_income age loan_amount_loan n_loans annual_income age_fin".split()
    ints = {"application_id": "bigint", "default_flag": "int", "age": "int", "n_loans": "bigint", "age_fin": "int"}
    dated = master.withColumn("application_date", F.col("application_date").cast("timestamp_ntz"))
    return dated.select(*[F.col(c).cast(ints[c]).alias(c) if c in ints else c for c in cols])
