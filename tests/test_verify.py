"""Comparisons, workflows, grading and report queries on hand-made rows."""

import datetime as dt
import decimal
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import cells
from wayfold.operators import pairing, verify
from wayfold.plans import published


def matches(report):
    return report.first()["matches"]


def test_multiset_counts_rows_and_reads_columns_in_order(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x int, y int")
    assert matches(verify.multiset(a.orderBy(F.col("x").desc()), a))
    report = verify.multiset(a.distinct(), a).first()
    assert not report["matches"] and (report["actual_rows"], report["expected_rows"]) == (2, 3)
    swapped = verify.multiset(a.select("y", "x"), a).first()
    assert not swapped["matches"] and swapped["reason"] == "column names/order differ"
    assert not matches(verify.multiset(a.select(F.col("x").cast("string"), "y"), a))
    nulls = spark.createDataFrame([(None, 1), (None, 1)], "x int, y int")
    assert matches(verify.multiset(nulls, nulls)) and not matches(verify.multiset(nulls.limit(1), nulls))


def test_ordered_compare_reads_the_sequence(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "i int, v string")
    turned = spark.createDataFrame([(1, "a"), (0, "b")], "i int, v string")
    assert matches(verify.multiset(rows, rows, ordered_by="i"))
    assert not matches(verify.multiset(turned, rows, ordered_by="i"))


def test_tolerant_compare(spark):
    shape = "k string, v double, w double"
    base = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 5.0), ("b", 1e9, 0.0)], shape)
    near = spark.createDataFrame([("b", 1e9 + 500, 0.0), ("a", 2.0000005, 5.0), ("a", 1.0, None)], shape)
    assert matches(verify.tolerant(near, base))
    far = spark.createDataFrame([("b", 1e9 + 5000, 0.0), ("a", 2.0, 5.0), ("a", 1.0, None)], shape)
    assert verify.tolerant(far, base).first()["reason"] == "result differs; missing row"
    assert verify.tolerant(base.limit(2), base).first()["reason"] == "row count mismatch"
    other_key = spark.createDataFrame([("c", 1.0, None), ("a", 2.0, 5.0), ("b", 1e9, 0.0)], shape)
    assert not matches(verify.tolerant(other_key, base))


def test_tolerant_compare_finds_a_pairing_behind_an_equal_row(spark):
    """Cancelling the equal rows first would leave two rows too far apart."""
    a = spark.createDataFrame([(1.0000009,), (1.0000018,)], "v double")
    b = spark.createDataFrame([(1.0,), (1.0000009,)], "v double")
    assert matches(verify.tolerant(a, b))


def test_document_diff(spark):
    rows = [(1, '{"a": {"x": 1, "y": [1, 2]}, "b": 1}', '{"b": 1, "a": {"y": [2, 1], "x": 1, "z": null}}'), (2, '{"a": {}}', "{}"), (3, "[1]", "[1]")]
    df = spark.createDataFrame(rows, "id int, before string, after string")
    found = [tuple(r) for r in verify.document_diff(df, "id", "before", "after").collect()]
    assert sorted(found) == [(1, "/a/y", "[1,2]", "[2,1]"), (2, "/a", "{}", None)]


def test_document_diff_goes_to_any_depth_in_one_job(spark):
    deep = lambda leaf, n: json.dumps(leaf) if n == 0 else '{"k": %s, "same": [1]}' % deep(leaf, n - 1)
    rows = [(1, deep(1, 20), deep(2, 20)), (None, deep(1, 400), deep(1, 400)), (3, "no json", '{"a": 1}'), (4, '{"a": 1, "é": "x"}', '{"a": 1.0, "é": null}'), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, before string, after string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("diff", "diff")
    found = sorted(map(tuple, verify.document_diff(df, "id", "before", "after").collect()))
    jobs = len(tracker.getJobIdsForGroup("diff"))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert found == [(1, "/k" * 20, "1", "2"), (3, "", None, '{"a":1}'), (4, "/é", '"x"', None)]
    assert jobs == 1


def test_cells_keep_their_type(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "1", decimal.Decimal("1.50"), dt.date(2024, 1, 2), b"\x01", True, None)],
        "i int, f double, s string, d decimal(9,2), t date, b binary, o boolean, n string",
    )
    row = df.select(*cells.typed_columns(df)).first()
    assert tuple(row) == ("int:1", "float:1.0", "text:1", "decimal:1.5", "temporal:2024-01-02", "bytes:01", "bool:true", "null:")


@pytest.fixture()
def shop(spark):
    spark.createDataFrame([(1, "US"), (2, "US"), (3, "DE")], "customer_id int, country string").createOrReplaceTempView("t_customers")
    spark.sql("SELECT * FROM VALUES (1, 20.00BD), (2, 30.00BD), (2, 0.00BD), (3, 5.00BD) AS t(customer_id, amount)").createOrReplaceTempView("t_orders")


def spec(**changes):
    base = {
        "stages": [
            {"name": "sg_joined", "sql": "SELECT country, amount FROM t_customers JOIN t_orders USING (customer_id)"},
            {"name": "sg_totals", "sql": "SELECT country, sum(amount) AS total FROM sg_joined GROUP BY country"},
        ],
        "final_sql": "SELECT country, total FROM sg_totals WHERE country = 'US'",
        "alternate_sql": "SELECT country, sum(amount) AS total FROM t_orders JOIN t_customers USING (customer_id) WHERE country = 'US' GROUP BY country",
        "output_columns": ["country", "total"],
        "constraints": [
            {"description": "one row", "sql": "SELECT count(*) = 1 AS ok FROM sg_result"},
            {"description": "positive", "sql": "SELECT bool_and(total > 0) AS ok FROM sg_result"},
        ],
    }
    return {**base, **changes}


def failed(spark, spec_value, **limits):
    return {(r["check"], r["name"]) for r in verify.workflow(spark, spec_value, **limits).collect() if not r["passed"]}


def test_workflow_checks(spark, shop):
    assert failed(spark, spec()) == set()
    samples = {r["name"]: r["value"] for r in verify.workflow(spark, spec()).collect() if r["check"] == "sample"}
    assert json.loads(samples["sg_totals"]) == [{"country": "DE", "total": 5.0}, {"country": "US", "total": 50.0}]
    assert [r["amount"] for r in json.loads(samples["sg_joined"])] == [5.0, 0.0, 20.0]
    assert ("result", "row_count") in failed(spark, spec(final_sql="SELECT country, total FROM sg_totals"), max_rows=1)
    empty = spec()["stages"]
    empty[0] = {**empty[0], "sql": empty[0]["sql"] + " WHERE country = 'FR'"}
    assert ("stage", "sg_joined") in failed(spark, spec(stages=empty))
    false = [{"description": "wrong", "sql": "SELECT false AS ok FROM sg_result"}, *spec()["constraints"]]
    assert failed(spark, spec(constraints=false)) == {("constraint", "wrong")}
    number = [{"description": "number", "sql": "SELECT count(*) AS ok FROM sg_result"}, *spec()["constraints"]]
    assert failed(spark, spec(constraints=number)) == {("constraint", "number")}
    assert failed(spark, spec(output_columns=["country"])) == {("result", "columns")}
    other = "SELECT 'US' AS country, 49.0BD AS total"
    assert failed(spark, spec(alternate_sql=other)) == {("alternate", "agreement")}


def test_workflow_shape():
    assert verify.workflow_shape(spec()) == []
    loose = spec()["stages"]
    loose[1] = {**loose[1], "sql": "SELECT country, 1 AS total FROM t_customers"}
    assert "must read sg_joined" in verify.workflow_shape(spec(stages=loose))[0]
    assert verify.workflow_shape(spec(alternate_sql="SELECT * FROM sg_totals"))
    cited = [{**s, "source_transition_ids": [t]} for s, t in zip(spec()["stages"], ("e1", "e2"))]
    known = {"e1": "task a", "e2": "task b", "e3": "task a"}
    assert verify.workflow_shape(spec(stages=cited, transitions=known)) == []
    assert verify.workflow_shape(spec(transitions=known)) == [
        "stage sg_joined must cite known transitions", "stage sg_totals must cite known transitions", "stages must rest on transitions of two source tasks"]
    assert verify.workflow_shape(spec(stages=cited, transitions={"e1": "task a", "e2": "task a"})) == ["stages must rest on transitions of two source tasks"]
    assert verify.workflow_shape(spec(constraints=spec()["constraints"][:1]))
    assert verify.workflow_shape(spec(stages=spec()["stages"][:1]))


def test_grading(spark):
    expected = spark.createDataFrame([("US", 50.0), ("DE", 5.0)], "country string, total double")
    rows = [("right", "DE", 5.0), ("right", "US", 50.00001), ("wrong", "US", 51.0), ("wrong", "DE", 5.0), ("short", "US", 50.0),
            ("twice", "US", 50.0), ("twice", "US", 50.0)]
    submissions = spark.createDataFrame(rows, "submission_id string, country string, total double")
    graded = {r["submission_id"]: (r["reward"], r["reason"]) for r in verify.grade(expected, submissions).collect()}
    assert graded == {
        "right": (1, "pass"), "wrong": (0, "result differs"), "short": (0, "row count mismatch"), "twice": (0, "result differs"),
    }
    strict = verify.grade(expected, submissions, {"cheap": F.max("total") < 50.000001})
    assert {r["submission_id"]: r["reason"] for r in strict.collect()}["right"] == "constraint fails: cheap"


def test_gate_names_the_first_failure(spark):
    good, bad = spark.range(3), spark.range(2)
    row = verify.gate(bad, bad, good, good).first()
    assert row["status"] == "validated" and row["reason"] is None
    assert verify.gate(good, good, good, good).first()["reason"].startswith("pristine")
    assert verify.gate(bad, bad, bad, good).first()["reason"].startswith("oracle")


def test_geographic_window_ends_before_the_address_join(spark):
    d = decimal.Decimal
    orders = spark.createDataFrame(
        [(1, 1, d("10.00"), "2024-01-01 05:00:00", "SHIPPED"), (2, 1, d("5.01"), "2024-01-01 23:00:00", "DELIVERED"),
         (3, 9, d("1.00"), "2024-12-30 00:00:00", "COMPLETED"), (4, 1, d("7.00"), "2023-12-31 00:00:00", "SHIPPED"),
         (5, 2, d("2.00"), "2024-01-01 01:00:00", "OPEN")],
        "order_id int, customer_id int, grand_total decimal(18,4), ordered_at string, status string",
    ).withColumn("ordered_at", F.to_timestamp("ordered_at"))
    addresses = spark.createDataFrame([(1, "CA", True), (1, "NY", False), (2, "CA", True)], "customer_id int, state_province string, is_default_shipping boolean")
    rows = published.geographic_daily(orders, addresses).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["state_province"], row["order_count"], float(row["total_revenue"]), float(row["avg_order_value"])) == ("CA", 2, 15.01, 7.51)
    assert (float(row["revenue_per_customer"]), float(row["orders_per_customer"])) == (15.01, 2.0)


def test_cohort_corner_cases(spark):
    d = decimal.Decimal
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    sales = spark.createDataFrame(
        [(2, 1, 0, None, "w", 10, d(100), d(10), d(0)), (1, 1, 0, 5, "v", 11, d(0), d(0), d(0)), (3, 1, 7, 1, "w", 11, d(50), d(5), d(5)),
         (4, 2, 50, 1, "zz", 12, d(0), d(0), d(0)), (5, 3, 200, 1, "v", 13, d(9), d(1), d(0)), (6, None, 0, 1, "v", 14, d(9), d(1), d(0)), (7, 1, 999, 1, "v", 15, d(9), d(1), d(0))],
        "sale_key int, customer_key int, date_key int, time_key int, channel_key string, order_id int, total_amount decimal(18,4), profit_amount decimal(18,4), discount_amount decimal(18,4)",
    )
    dates = spark.createDataFrame([(n, day(n)) for n in range(201)], "date_key int, full_date date")
    channels = spark.createDataFrame([("v", "VIP"), ("w", None)], "channel_key string, channel_code string")
    rows = {r["channel_key"]: r for r in published.channel_cohorts(sales, dates, channels).collect()}
    # Customer 3 is too young; the timed sale comes before the one without a time.
    assert set(rows) == {"v", "zz"}
    first = rows["v"]
    assert (first["channel_code"], first["cohort_size"], first["order_count"]) == ("VIP", 1, 2)
    assert (first["day_0_customers"], first["day_7_customers"], first["day_30_customers"]) == (1, 1, 0)
    assert (first["revenue"], first["margin_rate"], first["day_7_retention"]) == (d("150.00"), d("0.100000"), d("1.000000"))
    assert rows["zz"]["channel_code"] == "UNKNOWN" and rows["zz"]["margin_rate"] is None and rows["zz"]["revenue"] == d("0.00")


def plain_close(x, y):
    if x is None or y is None:
        return x is y
    if not (math.isfinite(x) and math.isfinite(y)):
        return x == y or (math.isnan(x) and math.isnan(y))
    return x == y or abs(x - y) <= max(1e-6, 1e-6 * max(abs(x), abs(y)))


def plain_pairing(left, right):
    """Rows a largest one-to-one pairing covers, by single augmenting steps."""
    fits = [[j for j, r in enumerate(right) if l[0] == r[0] and all(map(plain_close, l[1:], r[1:]))] for l in left]
    owner = {}

    def place(i, seen):
        for j in fits[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(left)))


def near_rows(rng, n):
    """Rows whose values crowd within a few tolerances of one another, also across 1 and with values that are no numbers."""
    base = [0.0, 1.0, -1.0, 123.456, 1e9, None, float("nan"), float("inf")]
    value = lambda: (lambda b: b if b is None or not math.isfinite(b) else b + rng.choice([0, 0.7, 1.4, -0.9]) * 1e-6 * max(1, abs(b)))(rng.choice(base))
    return [(rng.choice("ab"), value(), rng.choice([5.0, 3.0, 3.0000007, None])) for _ in range(n)]


def test_tolerant_compare_equals_a_plain_matching_on_random_rows(spark):
    rng, shape, seen = random.Random(8), "k string, v double, w double", set()
    groups = []
    for case in range(60):
        left = near_rows(rng, rng.randint(1, 9))
        right = [(k, v if v is None or rng.random() < 0.4 else v * (1 + 4e-7), w) for k, v, w in left]
        if case % 4 == 3:
            right[0] = near_rows(rng, 1)[0]
        rng.shuffle(right)
        groups.append((left, right, plain_pairing(left, right) == len(left)))
    for left, right, same in groups[:12]:
        report = verify.tolerant(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape)).first()
        assert report["matches"] == same, (left, right)
    # The same rule for many submissions at once: one expected table for all of equal size.
    for expected in (groups[0][1], groups[3][1]):
        rows = [(i, *r) for i, (left, right, _) in enumerate(groups) for r in (left if i % 2 else expected)]
        graded = verify.grade(spark.createDataFrame(expected, shape), spark.createDataFrame(rows, "submission_id int, " + shape))
        for r in graded.collect():
            mine = [x[1:] for x in rows if x[0] == r["submission_id"]]
            want = len(mine) == len(expected) and plain_pairing(mine, expected) == len(mine)
            seen.add(want)
            assert r["reward"] == int(want), (mine, expected)
    assert seen == {True, False}


def test_largest_pairing_with_counts_equals_single_rows():
    rng = random.Random(3)
    for _ in range(400):
        ln = {f"l{i}": rng.randint(1, 3) for i in range(rng.randint(1, 5))}
        rn = {f"r{i}": rng.randint(1, 3) for i in range(rng.randint(1, 5))}
        edges = [(a, b) for a in ln for b in rn if rng.random() < 0.5]
        left, right = [a for a in ln for _ in range(ln[a])], [b for b in rn for _ in range(rn[b])]
        owner = {}

        def place(i, seen):
            for j, b in enumerate(right):
                if (left[i], b) in edges and j not in seen:
                    seen.add(j)
                    if j not in owner or place(owner[j], seen):
                        owner[j] = i
                        return True
            return False

        want = sum(place(i, set()) for i in range(len(left)))
        used = {b for _, b in edges}
        assert pairing.largest_pairing(edges, {a: n for a, n in ln.items()}, {b: n for b, n in rn.items() if b in used}) == want


def test_tolerant_compare_pairs_rows_against_their_sorted_order(spark):
    shape = "v double, w double"
    a = spark.createDataFrame([(1.0000000001, 5.0), (1.0, 3.0)], shape)
    b = spark.createDataFrame([(1.0, 5.0), (1.0000000001, 3.0)], shape)
    assert matches(verify.tolerant(a, b)) and matches(verify.tolerant(a.unionByName(b), b.unionByName(a)))
    assert not matches(verify.tolerant(a, spark.createDataFrame([(1.0, 5.0), (None, 3.0)], shape)))
    odd = spark.createDataFrame([(float("inf"), 1.0), (float("nan"), None)], shape)
    assert matches(verify.tolerant(odd, odd)) and not matches(verify.tolerant(odd, odd.withColumn("v", F.lit(7.0))))


def test_tolerant_compare_of_crowded_values(spark):
    """Thousands of values within one tolerance: compared in sorted order, and, with a second column, refused beyond the limit."""
    rows = spark.range(3000).select((F.col("id") * 1e-10).alias("v"))
    assert verify._is_dense(rows.withColumn("_key", F.lit("")).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(1)), "v")
    assert matches(verify.tolerant(rows.select((F.col("v") + 1e-11).alias("v")), rows))
    far = rows.select(F.when(F.col("v") == 0, 1.0).otherwise(F.col("v") + 1e-11).alias("v"))
    assert not matches(verify.tolerant(far, rows))
    two = spark.range(40).select((F.col("id") * 1e-9).alias("v"), (F.col("id") % 2).cast("double").alias("w"))
    moved = two.select((F.col("v") + 5e-10).alias("v"), "w")
    assert matches(verify.tolerant(moved, two))
    # Two rows at one end against two at the other: every row has to move on by one.
    left, right = two.unionByName(two.limit(1)), two.unionByName(two.filter("v > 37.5e-9 AND w = 0"))
    assert matches(verify.tolerant(left, right))
    with pytest.raises(ValueError, match="hang together"):
        verify.tolerant(left, right, max_cluster=50)


def test_ordered_tolerant_compare_and_grading(spark):
    shape = "place int, k string, v double"
    expected = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], shape)
    near = spark.createDataFrame([(2, "b", 2.0000001), (1, "a", 1.0)], shape)
    turned = spark.createDataFrame([(1, "b", 2.0), (2, "a", 1.0)], shape)
    longer = expected.unionByName(spark.createDataFrame([(3, "c", 1.0)], shape))
    report = lambda df: verify.tolerant(df, expected, order_by=["place"]).first()["reason"]
    assert (report(near), report(turned), report(longer)) == ("equal", "ordered result differs", "row count mismatch")
    sent = None
    for name, df in (("near", near), ("turned", turned), ("longer", longer)):
        part = df.select(F.lit(name).alias("submission_id"), "*")
        sent = part if sent is None else sent.unionByName(part)
    ids = spark.createDataFrame([("near",), ("turned",), ("longer",), ("silent",)], "submission_id string")
    graded = verify.grade(expected, sent, {"positive": F.min("v") > 0}, ids=ids, order_by=["place"])
    assert {r["submission_id"]: (r["reward"], r["reason"], r["rows"]) for r in graded.collect()} == {
        "near": (1, "pass", 2), "turned": (0, "result differs", 2), "longer": (0, "row count mismatch", 3), "silent": (0, "row count mismatch", 0),
    }
    nothing = verify.grade(expected.limit(0), sent.limit(0), ids=ids.limit(1))
    assert nothing.first()["reason"] == "pass"


def test_workflow_with_an_ordered_alternate(spark, shop):
    ordered = spec(final_sql="SELECT country, total FROM sg_totals", alternate_sql="""SELECT country, sum(amount) AS total FROM t_orders
        JOIN t_customers USING (customer_id) GROUP BY country""", constraints=spec()["constraints"][1:] * 2, order_by=["total"])
    assert failed(spark, ordered) == set()
    swapped = "SELECT 'US' AS country, 5.00BD AS total UNION ALL SELECT 'DE', 50.00BD"
    assert ("alternate", "agreement") in failed(spark, {**ordered, "alternate_sql": swapped})
