"""The two published report queries over order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses and windows of the report definitions.
SOLD = ("COMPLETED", "DELIVERED", "SHIPPED")
REPORT_DAYS = 365
COHORT_DAYS = 90
RETENTION_DAYS = (0, 7, 30, 90)


def geographic_daily(orders: DataFrame, addresses: DataFrame, statuses=SOLD) -> DataFrame:
    """Daily metrics per state over the year that ends with the last qualifying order.

    The end date comes from all qualifying orders, before the address join.
    """
    eligible = orders.filter(F.col("status").isin(*statuses)).select(
        "order_id", "customer_id", "grand_total", F.to_date("ordered_at").alias("order_date")
    )
    last = eligible.agg(F.max("order_date")).scalar()
    recent = eligible.filter(
        F.col("order_date").between(F.date_sub(last, REPORT_DAYS - 1), last)
    )
    default = addresses.filter(
        F.col("is_default_shipping") & F.col("state_province").isNotNull()
    ).select("customer_id", "state_province")
    grouped = (
        recent.join(default, "customer_id")
        .groupBy("state_province", "order_date")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.count_distinct("customer_id").alias("_customers"),
            F.sum("grand_total").alias("_revenue"),
            F.count("grand_total").alias("_rows"),
        )
    )
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return grouped.select(
        "state_province",
        "order_date",
        "order_count",
        F.round("_revenue", 2).alias("total_revenue"),
        F.round(F.col("_revenue") / exact("_rows"), 2).alias("avg_order_value"),
        F.round(F.col("_revenue") / exact("_customers"), 2).alias("revenue_per_customer"),
        F.round(exact("order_count") / exact("_customers"), 2).alias("orders_per_customer"),
    )


def first_sales(sales: DataFrame) -> DataFrame:
    """First sale of every customer by date, time, order and sale key, NULLs last.

    A minimum over the sort keys, so a customer with very many sales is combined
    before the shuffle.
    """
    order = F.struct(
        "sale_date",
        F.col("time_key").isNull().alias("_t"), "time_key",
        F.col("order_id").isNull().alias("_o"), "order_id",
        "sale_key",
    )
    return sales.groupBy("customer_key").agg(
        F.min("sale_date").alias("cohort_date"),
        F.min_by(F.struct("channel_key"), order).alias("_first"),
    ).select("customer_key", "cohort_date", F.col("_first.channel_key").alias("channel_key"))


def channel_cohorts(sales: DataFrame, dates: DataFrame, channels: DataFrame) -> DataFrame:
    """Cohorts by acquisition channel: size, exact-day retention and 90-day money."""
    dated = sales.filter(F.col("customer_key").isNotNull()).join(
        dates.select("date_key", F.col("full_date").alias("sale_date")), "date_key"
    )
    last = dated.agg(F.max("sale_date")).scalar()
    cohorts = first_sales(dated).filter(
        F.col("cohort_date") <= F.date_sub(last, COHORT_DAYS)
    )
    activity = (
        dated.select("customer_key", "sale_date", "order_id", "total_amount", "profit_amount", "discount_amount")
        .join(cohorts, "customer_key")
        .withColumn("_day", F.date_diff("sale_date", "cohort_date"))
        .filter(F.col("_day").between(0, COHORT_DAYS))
    )
    group = ["cohort_date", "channel_key"]
    money = ["total_amount", "profit_amount", "discount_amount"]
    per_customer = activity.groupBy(*group, "customer_key").agg(
        *[F.max((F.col("_day") == d).cast("int")).alias(f"_d{d}") for d in RETENTION_DAYS],
        *[F.sum(m).alias(m) for m in money],
    )
    sized = per_customer.groupBy(*group).agg(
        F.count(F.lit(1)).alias("cohort_size"),
        *[F.sum(f"_d{d}").alias(f"day_{d}_customers") for d in RETENTION_DAYS],
        *[F.sum(m).alias(m) for m in money],
    )
    orders = activity.filter("order_id IS NOT NULL").select(*group, "order_id").distinct().groupBy(*group).agg(
        F.count(F.lit(1)).alias("order_count")
    )
    same = (sized["cohort_date"] == orders["cohort_date"]) & sized["channel_key"].eqNullSafe(orders["channel_key"])
    whole = (
        sized.join(orders, same, "left")
        .select(sized["*"], F.coalesce(orders["order_count"], F.lit(0)).alias("order_count"))
        .join(channels.select("channel_key", "channel_code"), "channel_key", "left")
    )
    exact = lambda c: F.col(c).cast("decimal(20,0)")

    def ratio(top, bottom, digits: int):
        value = F.round(top / F.nullif(bottom, F.lit(0).cast("decimal(20,0)")), digits)
        return value.cast(f"decimal(18,{digits})")

    revenue, profit, discount = (F.col(m).cast("decimal(28,4)") for m in money)
    return whole.select(
        "cohort_date",
        F.trunc("cohort_date", "month").alias("month_start"),
        "channel_key",
        F.coalesce("channel_code", F.lit("UNKNOWN")).alias("channel_code"),
        "cohort_size",
        "order_count",
        *[f"day_{d}_customers" for d in RETENTION_DAYS],
        F.round(revenue, 2).cast("decimal(18,2)").alias("revenue"),
        F.round(profit, 2).cast("decimal(18,2)").alias("profit"),
        F.round(discount, 2).cast("decimal(18,2)").alias("discount_amount"),
        ratio(profit, revenue, 6).alias("margin_rate"),
        ratio(revenue, exact("order_count"), 2).alias("avg_order_value"),
        ratio(discount, revenue, 6).alias("discount_rate"),
        *[ratio(exact(f"day_{d}_customers"), exact("cohort_size"), 6).alias(f"day_{d}_retention") for d in RETENTION_DAYS],
    )
