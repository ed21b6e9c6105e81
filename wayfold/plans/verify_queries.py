"""Queries: report queries, comparisons, grading and staged workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import cells
from wayfold.operators import verify
from wayfold.plans import published
from wayfold.plans.fixtures import Views, check_sql
from wayfold.plans.registry import query


def half_up(top: str, bottom: str, digits: int) -> str:
    """Exact half-up division of integers in DuckDB, as DECIMAL(18, digits)."""
    t, b = f"CAST({top} AS HUGEINT)", f"CAST({bottom} AS HUGEINT)"
    whole = f"(2 * abs({t}) * {10 ** digits} + {b}) // (2 * {b})"
    scale = f"CAST({1 / 10 ** digits:.{digits}f} AS DECIMAL({digits + 1},{digits}))"
    return (
        f"CASE WHEN {b} = 0 THEN NULL ELSE CAST(CAST(sign({t}) * {whole} AS DECIMAL(18,0)) * {scale} AS DECIMAL(18,{digits})) END"
    )


def shop_orders(v: Views) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "SHIPPED").otherwise("OPEN")
    return v["orders"].select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,4)").alias("grand_total"),
        F.col("o_orderdate").alias("ordered_at"),
        status.alias("status"),
    )


def shop_addresses(v: Views) -> DataFrame:
    nations = v["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return v["customer"].join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_nationkey") != 7, F.col("n_name")).alias("state_province"),
        (F.col("c_custkey") % 10 != 9).alias("is_default_shipping"),
    )


@query(
    "geographic_daily_metrics",
    f"""SELECT state_province, order_date, order_count, {half_up('revenue', '10000', 2)} AS total_revenue,
    {half_up('revenue', 'n * 10000', 2)} AS avg_order_value, {half_up('revenue', 'customers * 10000', 2)} AS revenue_per_customer,
    {half_up('order_count', 'customers', 2)} AS orders_per_customer FROM (
    SELECT n_name AS state_province, CAST(o_orderdate AS DATE) AS order_date, count(DISTINCT o_orderkey) AS order_count,
    count(DISTINCT o_custkey) AS customers, count(*) AS n, sum(CAST(round(o_totalprice * 10000) AS HUGEINT)) AS revenue
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderstatus IN ('F', 'P') AND c_custkey % 10 <> 9 AND c_nationkey <> 7 AND CAST(o_orderdate AS DATE) >
      (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus IN ('F', 'P')) - INTERVAL 365 DAY
    GROUP BY 1, 2) x""",
)
def geographic_daily_metrics(v: Views):
    rows = published.geographic_daily(shop_orders(v), shop_addresses(v))
    money = ["total_revenue", "avg_order_value", "revenue_per_customer", "orders_per_customer"]
    return rows.select("state_province", "order_date", "order_count", *[F.col(m).cast("decimal(18,2)").alias(m) for m in money])


def shop_sales(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    date_key = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    price = F.col("o_totalprice").cast("decimal(18,4)")
    tenth = F.lit("0.1").cast("decimal(2,1)")
    sales = v["orders"].select(
        F.col("o_orderkey").alias("sale_key"),
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("customer_key"),
        date_key.alias("date_key"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 24).alias("time_key"),
        F.col("o_orderpriority").alias("channel_key"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("order_id"),
        price.alias("total_amount"),
        ((price - 100000) * tenth).cast("decimal(18,4)").alias("profit_amount"),
        F.when(F.col("o_orderkey") % 4 == 0, price * tenth).otherwise(0).cast("decimal(18,4)").alias("discount_amount"),
    )
    dates = v["orders"].filter(F.dayofmonth("o_orderdate") != 13).select(
        date_key.alias("date_key"), F.to_date("o_orderdate").alias("full_date")
    ).distinct()
    channels = v["orders"].filter("o_orderpriority <> '4-NOT SPECIFIED'").select(
        F.col("o_orderpriority").alias("channel_key"), F.lower("o_orderpriority").alias("channel_code")
    ).distinct()
    return sales, dates, channels


FIRSTS = """SELECT customer_key, channel_key, sale_date AS cohort_date FROM (SELECT *, row_number() OVER (PARTITION BY customer_key
 ORDER BY sale_date, time_key NULLS LAST, order_id NULLS LAST, sale_key) AS k FROM dated) x WHERE k = 1"""
DATED = """SELECT o_orderkey AS sale_key, o_custkey AS customer_key, CAST(o_orderdate AS DATE) AS sale_date,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 24 END AS time_key, o_orderpriority AS channel_key,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS order_id, CAST(round(o_totalprice * 100) AS HUGEINT) * 100 AS total,
 (CAST(round(o_totalprice * 100) AS HUGEINT) - 10000000) * 10 AS profit,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(round(o_totalprice * 100) AS HUGEINT) * 10 ELSE 0 END AS discount
 FROM orders WHERE o_orderkey % 50 <> 0 AND day(o_orderdate) <> 13"""
RETENTION = ", ".join(
    f"{half_up(f'day_{d}_customers', 'cohort_size', 6)} AS day_{d}_retention" for d in published.RETENTION_DAYS
)


@query("first_sale_attribution", check_sql(FIRSTS, dated=DATED))
def first_sale_attribution(v: Views):
    sales, dates, _ = shop_sales(v)
    dated = sales.filter("customer_key IS NOT NULL").join(dates.withColumnRenamed("full_date", "sale_date"), "date_key")
    return published.first_sales(dated)


@query(
    "acquisition_channel_cohorts",
    check_sql(
        f"""SELECT cohort_date, CAST(date_trunc('month', cohort_date) AS DATE) AS month_start, channel_key,
        CASE WHEN channel_key = '4-NOT SPECIFIED' THEN 'UNKNOWN' ELSE lower(channel_key) END AS channel_code, cohort_size, order_count,
        day_0_customers, day_7_customers, day_30_customers, day_90_customers,
        {half_up('revenue', '10000', 2)} AS revenue, {half_up('profit', '10000', 2)} AS profit, {half_up('discount', '10000', 2)} AS discount_amount,
        {half_up('profit', 'revenue', 6)} AS margin_rate, {half_up('revenue', 'order_count * 10000', 2)} AS avg_order_value,
        {half_up('discount', 'revenue', 6)} AS discount_rate, {RETENTION} FROM (
        SELECT f.cohort_date, f.channel_key, count(DISTINCT s.customer_key) AS cohort_size, count(DISTINCT s.order_id) AS order_count,
        count(DISTINCT CASE WHEN s.sale_date = f.cohort_date THEN s.customer_key END) AS day_0_customers,
        count(DISTINCT CASE WHEN s.sale_date = f.cohort_date + INTERVAL 7 DAY THEN s.customer_key END) AS day_7_customers,
        count(DISTINCT CASE WHEN s.sale_date = f.cohort_date + INTERVAL 30 DAY THEN s.customer_key END) AS day_30_customers,
        count(DISTINCT CASE WHEN s.sale_date = f.cohort_date + INTERVAL 90 DAY THEN s.customer_key END) AS day_90_customers,
        sum(total) AS revenue, sum(profit) AS profit, sum(discount) AS discount
        FROM firsts f JOIN dated s ON s.customer_key = f.customer_key AND s.sale_date BETWEEN f.cohort_date AND f.cohort_date + INTERVAL 90 DAY
        WHERE f.cohort_date <= (SELECT max(sale_date) FROM dated) - INTERVAL 90 DAY GROUP BY 1, 2) m""",
        dated=DATED, firsts=FIRSTS,
    ),
)
def acquisition_channel_cohorts(v: Views):
    return published.channel_cohorts(*shop_sales(v))


def order_results(v: Views) -> DataFrame:
    return v["orders"].select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price"), "o_orderdate")


@query(
    "multiset_compare",
    """SELECT 'same' AS case_name, true AS matches, 'equal' AS reason, count(*) AS actual_rows, count(*) AS expected_rows FROM orders UNION ALL
    SELECT 'one_row_twice', false, 'row values/multiplicities differ', count(*) + count(*) FILTER (o_orderkey = 5), count(*) FROM orders UNION ALL
    SELECT 'column_order', false, 'column names/order differ', NULL, NULL""",
)
def multiset_compare(v: Views):
    rows = order_results(v)
    cases = {
        "same": verify.multiset(rows.repartition(5, "price"), rows),
        "one_row_twice": verify.multiset(rows.unionByName(rows.filter("o_orderkey = 5")), rows),
        "column_order": verify.multiset(rows.select(*reversed(rows.columns)), rows),
    }
    whole = None
    for name, report in cases.items():
        part = report.select(F.lit(name).alias("case_name"), "*")
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(
    "multiset_differences",
    """SELECT 'int:' || o_orderkey AS o_orderkey, 'text:' || o_orderpriority AS o_orderpriority,
    CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 2 END AS actual_count, 1 AS expected_count
    FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 1 AND o_orderkey % 97 <> 0""",
)
def multiset_differences(v: Views):
    rows = v["orders"].select("o_orderkey", "o_orderpriority")
    actual = rows.filter("o_orderkey % 97 <> 0")
    return verify.multiset_difference(actual.unionByName(actual.filter("o_orderkey % 101 = 1")), rows)


@query(
    "ordered_compare",
    """SELECT 'same' AS case_name, true AS matches, 'equal' AS reason, count(*) AS actual_rows, count(*) AS expected_rows FROM orders UNION ALL
    SELECT 'reversed', false, 'row values/multiplicities differ', count(*), count(*) FROM orders""",
)
def ordered_compare(v: Views):
    rows = v["orders"].select("o_orderkey", F.col("o_orderkey").alias("place"), "o_orderpriority")
    backwards = rows.withColumn("place", -F.col("place"))
    same = verify.multiset(rows, rows, ordered_by="place").withColumn("case_name", F.lit("same"))
    other = verify.multiset(backwards, rows, ordered_by="place").withColumn("case_name", F.lit("reversed"))
    return same.unionByName(other)


@query(
    "tolerant_compare",
    """SELECT 'within' AS case_name, true AS matches, 'equal' AS reason, count(*) AS actual_rows, count(*) AS expected_rows FROM orders UNION ALL
    SELECT 'beyond', false, 'result differs; missing row', count(*), count(*) FROM orders UNION ALL
    SELECT 'shorter', false, 'row count mismatch', count(*) - 1, count(*) FROM orders""",
)
def tolerant_compare(v: Views):
    rows = v["orders"].select("o_orderpriority", F.col("o_totalprice").alias("price"))
    near = rows.withColumn("price", F.col("price") * (1 + 1e-9))
    odd = v["orders"].select(
        "o_orderpriority",
        F.when(F.col("o_orderkey") == 3, F.col("o_totalprice") + 900000).otherwise(F.col("o_totalprice")).alias("price"),
    )
    short = v["orders"].filter("o_orderkey <> 3").select("o_orderpriority", F.col("o_totalprice").alias("price"))
    whole = None
    for name, df in (("within", near), ("beyond", odd), ("shorter", short)):
        part = verify.tolerant(df, rows).select(F.lit(name).alias("case_name"), "*")
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query(
    "conflict_coverage",
    """SELECT doc_id, 'extra' AS side FROM labels WHERE doc_id % 10 = 3 UNION ALL
    SELECT doc_id, 'missing' FROM labels WHERE doc_id % 10 = 4""",
)
def conflict_coverage(v: Views):
    ids = v["labels"].select("doc_id")
    return verify.set_difference(ids.filter("doc_id % 10 <> 4"), ids.filter("doc_id % 10 <> 3"), "doc_id")


@query(
    "document_diff",
    """SELECT doc_id, '/meta/lang' AS path, '"' || lang || '"' AS before, CAST(NULL AS VARCHAR) AS after FROM documents WHERE doc_id % 3 = 0 UNION ALL
    SELECT doc_id, '/n', CAST(n_chars AS VARCHAR), CAST(n_chars + 1 AS VARCHAR) FROM documents WHERE doc_id % 4 = 1 UNION ALL
    SELECT doc_id, '/list', '[1,2]', '[2,1]' FROM documents WHERE doc_id % 5 = 2""",
)
def document_diff(v: Views):
    doc, n = F.col("doc_id"), F.col("n_chars")
    before = F.format_string('{"meta": {"lang": "%s", "x": null}, "n": %d, "list": [1, 2]}', "lang", n)
    kept = F.when(doc % 3 == 0, F.lit("{}")).otherwise(F.format_string('{"lang": "%s"}', "lang"))
    after = F.format_string(
        '{"list": %s, "n": %d, "meta": %s}',
        F.when(doc % 5 == 2, "[2, 1]").otherwise("[1, 2]"),
        F.when(doc % 4 == 1, n + 1).otherwise(n),
        kept,
    )
    rows = v["documents"].select("doc_id", before.alias("before"), after.alias("after"))
    return verify.document_diff(rows, "doc_id", "before", "after")


@query(
    "cell_canonical_forms",
    """SELECT o_orderkey, 'int:' || o_custkey AS o_custkey, 'temporal:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
    'decimal:' || regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '0+$', ''), '\\.$', '') AS price,
    CASE WHEN o_orderkey % 5 = 0 THEN 'null:' ELSE 'text:' || o_orderpriority END AS o_orderpriority,
    lower(hex(CAST(o_orderpriority AS BLOB))) AS raw FROM orders""",
)
def cell_canonical_forms(v: Views):
    rows = v["orders"].select(
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        F.col("o_totalprice").cast("decimal(18,4)").alias("price"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.col("o_orderpriority").cast("binary").alias("raw"),
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    named = ["o_custkey", "o_orderdate", "price", "o_orderpriority"]
    return rows.select(
        "o_orderkey", *[cells.typed(c, kinds[c]).alias(c) for c in named], cells.plain("raw", kinds["raw"]).alias("raw")
    )


def nation_revenue(v: Views) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    joined = v["orders"].join(v["customer"], F.col("o_custkey") == F.col("c_custkey")).join(
        v["nation"], F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.groupBy("n_name").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("orders"))


@query(
    "graded_submissions",
    """SELECT p_partkey AS submission_id, CASE WHEN p_partkey % 5 IN (0, 1) THEN 1 ELSE 0 END AS reward,
    CASE p_partkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'pass' WHEN 2 THEN 'result differs' WHEN 3 THEN 'row count mismatch'
    ELSE 'constraint fails: no empty name' END AS reason,
    (SELECT count(DISTINCT n_name) FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)
    - CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 0 END AS rows FROM part""",
)
def graded_submissions(v: Views):
    """One submission per part, each a variant of the revenue table; all graded at once."""
    expected = nation_revenue(v).select("n_name", F.col("cents").cast("double").alias("revenue"), "orders")
    last = expected.agg(F.max("n_name")).scalar()
    # One row per nation: a list of fixed size that every part repeats.
    answer = expected.agg(F.collect_list(F.struct("n_name", "revenue", "orders"))).scalar()
    kind = F.col("p_partkey") % 5
    spread = v["part"].select("p_partkey", last.alias("last"), answer.alias("answer"))
    rows = spread.select("p_partkey", "last", F.inline("answer")).filter((kind != 3) | (F.col("n_name") != F.col("last")))
    submissions = rows.select(
        F.col("p_partkey").alias("submission_id"),
        "n_name",
        F.when(kind == 1, F.col("revenue") * (1 + 1e-9))
        .when((kind == 2) & (F.col("n_name") == F.col("last")), F.col("revenue") * 1.5)
        .otherwise(F.col("revenue"))
        .alias("revenue"),
        "orders",
    )
    graded = verify.grade(
        expected,
        submissions,
        {"positive orders": F.bool_and(F.col("orders") > 0), "no empty name": F.max("submission_id") % 5 != 4},
    )
    return graded


WORKFLOW_STATUS = "('F', 'P')"


def workflow_spec(v: Views) -> dict:
    for name in ("orders", "customer", "nation"):
        v[name].createOrReplaceTempView(f"shop_{name}")
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return {
        "stages": [
            {"name": "sg_sold", "source_transition_ids": ["t1"], "sql": f"SELECT o_orderkey, o_custkey, {cents} AS cents FROM shop_orders WHERE o_orderstatus IN {WORKFLOW_STATUS}"},
            {"name": "sg_placed", "source_transition_ids": ["t1", "t2"], "sql": "SELECT c_nationkey, cents FROM sg_sold JOIN shop_customer ON c_custkey = o_custkey"},
        ],
        "final_sql": "SELECT n_name, sum(cents) AS cents, count(*) AS orders FROM sg_placed JOIN shop_nation ON n_nationkey = c_nationkey GROUP BY n_name",
        "alternate_sql": f"""SELECT n_name, sum({cents}) AS cents, count(o_orderkey) AS orders FROM shop_nation JOIN shop_customer ON c_nationkey = n_nationkey
            JOIN shop_orders ON o_custkey = c_custkey AND o_orderstatus IN {WORKFLOW_STATUS} GROUP BY n_name""",
        "output_columns": ["n_name", "cents", "orders"],
        "transitions": {"t1": "clean-orders", "t2": "map-customers"},
        "order_by": ["n_name"],
        "constraints": [
            {"description": "every nation once", "sql": "SELECT count(*) = count(DISTINCT n_name) AS ok FROM sg_result"},
            {"description": "no negative revenue", "sql": "SELECT bool_and(cents >= 0) AS ok FROM sg_result"},
        ],
    }


@query(
    "staged_workflow",
    f"""SELECT 'stage' AS "check", 'sg_sold' AS name, true AS passed, CAST(count(*) AS VARCHAR) AS value FROM orders WHERE o_orderstatus IN {WORKFLOW_STATUS} UNION ALL
    SELECT 'stage', 'sg_placed', true, CAST(count(*) AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN {WORKFLOW_STATUS} UNION ALL
    SELECT 'sample', 'sg_sold', true, CAST(to_json(list(x ORDER BY o_orderkey)) AS VARCHAR) FROM (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
      FROM orders WHERE o_orderstatus IN {WORKFLOW_STATUS} ORDER BY 1, 2, 3 LIMIT 3) x UNION ALL
    SELECT 'sample', 'sg_placed', true, CAST(to_json(list(x ORDER BY c_nationkey, cents)) AS VARCHAR) FROM (SELECT c_nationkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
      FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN {WORKFLOW_STATUS} ORDER BY 1, 2 LIMIT 3) x UNION ALL
    SELECT 'result', 'row_count', true, CAST(count(DISTINCT c_nationkey) AS VARCHAR) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN {WORKFLOW_STATUS} UNION ALL
    SELECT 'result', 'columns', true, 'n_name,cents,orders' UNION ALL SELECT 'alternate', 'agreement', true, 'equal' UNION ALL
    SELECT 'constraint', 'every nation once', true, '1' UNION ALL SELECT 'constraint', 'no negative revenue', true, '1'""",
)
def staged_workflow(v: Views):
    return verify.workflow(v.spark, workflow_spec(v))


@query(
    "validation_gate",
    """SELECT 'good' AS case_name, 'validated' AS status, CAST(NULL AS VARCHAR) AS reason, false AS before_matches, false AS starter_matches, true AS oracle_matches UNION ALL
    SELECT 'solved_starter', 'rejected', 'starting project already solves the task', false, true, true UNION ALL
    SELECT 'wrong_oracle', 'rejected', 'oracle result does not equal the reference', false, false, false""",
)
def validation_gate(v: Views):
    reference = nation_revenue(v)
    empty, wrong = reference.limit(0), reference.withColumn("cents", F.col("cents") + 1)
    cases = {"good": (empty, wrong, reference), "solved_starter": (empty, reference, reference), "wrong_oracle": (empty, wrong, wrong)}
    whole = None
    for name, runs in cases.items():
        part = verify.gate(*runs, reference).select(F.lit(name).alias("case_name"), "*")
        whole = part if whole is None else whole.unionByName(part)
    return whole
