"""Queries on the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import exact_sum
from ..operators.global_order import ranked
from ..operators.quantiles import exact_quantiles
from ..operators.ranking import top_k
from ..operators.skewed_join import skewed_join
from ..operators.upkeep import KeptTotals
from ..sources.tables import table
from ..streaming.windows import shared_folder

# products of decimals are exact; those of doubles round differently in different engines
_NET = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"
_CHARGE = _NET + " * (1 + cast(l_tax as decimal(4,2)))"


def star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and revenue per region and order year.

    The fact tables meet on the order key; lines are not aggregated before, as the keys of the result come from orders.
    The dimensions are small beside them; whether one is broadcast is left to its measured size.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region", "r_regionkey", "r_name")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    dated = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name", F.year("o_orderdate").alias("o_year"))
    joined = lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("r_name", "o_year").agg(F.count("*").alias("n_lines"), exact_sum(F.expr(_NET)).alias("revenue"))


def order_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their value by segment, priority and status, with all subtotals; level tells which columns are summed over."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    # the finest groups come first, so that the eight groupings of the cube work on few rows
    fine = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority", "o_orderstatus")
    fine = fine.agg(F.count("*").alias("n"), exact_sum(F.col("o_totalprice"), 2).alias("v"))
    cube = fine.cube("c_mktsegment", "o_orderpriority", "o_orderstatus")
    return cube.agg(F.sum("n").alias("n_orders"), F.sum("v").cast("decimal(28,2)").alias("total"), F.grouping_id().cast("long").alias("level"))


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three parts of highest revenue of each brand. Lines are summed by part before the join, which is where they shrink."""
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice", "l_discount")
    part = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name")
    revenue = lines.groupBy("l_partkey").agg(exact_sum(F.expr(_NET)).alias("revenue"))
    joined = revenue.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey", "p_name", "revenue")
    return top_k(joined, "p_brand", [F.desc("revenue"), F.asc("p_partkey")], 3)


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that no line refers to."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


def large_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order of over 400,000."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").where(F.col("o_totalprice") > 400_000)
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities, prices and counts by return flag and line status, up to a shipping date."""
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = lines.where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        exact_sum(F.col("l_quantity"), 2).alias("sum_qty"),
        exact_sum(F.col("l_extendedprice"), 2).alias("sum_price"),
        exact_sum(F.expr(_NET)).alias("sum_net"),
        exact_sum(F.expr(_CHARGE), 6).alias("sum_charge"),
        F.count("*").alias("n_lines"),
    )


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its place by price over the whole table, dearest first, and the price of all up to it."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    found = ranked(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], {"upto": price})
    return found.select("o_orderkey", "row_number", F.col("upto").cast("decimal(28,2)").alias("upto"))


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that a quarter, half, seven eighths and all of the lines of each return flag don't pass."""
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_extendedprice")
    return exact_quantiles(lines, "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.875, 1.0])


def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantity by the supplier's nation; suppliers with very many lines are dealt over several groups."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").withColumnRenamed("l_suppkey", "s_suppkey")
    met = skewed_join(lines, table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), "s_suppkey", most=500)
    return met.groupBy("s_nationkey").agg(F.count("*").alias("n_lines"), exact_sum(F.col("l_quantity"), 2).alias("quantity"))


def kept_customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their price by customer, kept up over three batches: all orders with the price of open ones still missing,
    then the prices of those, then half of all orders once more, which changes nothing."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    price, open_ = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderstatus") == "O"
    kept = KeptTotals(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    parts = [(orders, F.when(~open_, price)), (orders.where(open_), price), (orders.where(price > 250_000), price)]
    for n, (batch, value) in enumerate(parts):
        kept.apply(n, batch, "o_orderkey", "o_custkey", value.cast("decimal(18,2)"), F.col("o_orderkey"))
    return kept.totals().select(F.col("group").alias("o_custkey"), "n", F.col("total").cast("decimal(28,2)").alias("total"))


QUERIES = {f.__name__: f for f in (star_revenue, order_subtotals, top_parts, orders_without_lines, large_customers, pricing_summary, ranked_orders, price_quantiles, nation_lines, kept_customer_totals)}
_SUM = "CAST(sum(CAST({} AS DECIMAL(18,{s}))) AS DECIMAL(28,{s}))"
_REVENUE = _SUM.format(_NET, s=4)
ORACLE_SQL = {
    "star_revenue": f"""
        SELECT r_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n_lines, {_REVENUE} AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY ALL""",
    "order_subtotals": f"""
        SELECT c_mktsegment, o_orderpriority, o_orderstatus, count(*) AS n_orders, {_SUM.format("o_totalprice", s=2)} AS total,
               CAST(grouping(c_mktsegment, o_orderpriority, o_orderstatus) AS BIGINT) AS level
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY CUBE (c_mktsegment, o_orderpriority, o_orderstatus)""",
    "top_parts": f"""
        SELECT p_brand, p_partkey, p_name, revenue, CAST(rank AS INTEGER) AS rank FROM (
            SELECT p_brand, p_partkey, p_name, revenue, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS rank
            FROM (SELECT l_partkey, {_REVENUE} AS revenue FROM lineitem GROUP BY l_partkey) JOIN part ON l_partkey = p_partkey)
        WHERE rank <= 3""",
    "orders_without_lines": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "large_customers": """
        SELECT c_custkey, c_name, c_mktsegment FROM customer
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""",
    "pricing_summary": f"""
        SELECT l_returnflag, l_linestatus, {_SUM.format("l_quantity", s=2)} AS sum_qty, {_SUM.format("l_extendedprice", s=2)} AS sum_price,
               {_REVENUE} AS sum_net, {_SUM.format(_CHARGE, s=6)} AS sum_charge, count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""",
    "ranked_orders": """
        SELECT o_orderkey, row_number() OVER w AS row_number, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DECIMAL(28,2)) AS upto
        FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "price_quantiles": """
        SELECT l_returnflag, share, n, quantile FROM (
            SELECT l_returnflag, count(*) AS n, unnest([0.25::DOUBLE, 0.5, 0.875, 1.0]) AS share, unnest(quantile_disc(l_extendedprice, [0.25, 0.5, 0.875, 1.0])) AS quantile
            FROM lineitem GROUP BY l_returnflag)""",
    "nation_lines": f"""
        SELECT s_nationkey, count(*) AS n_lines, {_SUM.format("l_quantity", s=2)} AS quantity
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""",
    "kept_customer_totals": f"""
        SELECT o_custkey, count(*) AS n, {_SUM.format("o_totalprice", s=2)} AS total FROM orders GROUP BY o_custkey""",
}
