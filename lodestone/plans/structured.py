"""Relational questions over orders: scans, aggregates, joins, as-of picks. Each entry is (query, SQL twin)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import customers_of, order_graph, order_graph_size
from ..operators.retrieval import nearest
from .common import read

ORDERS_SQL = """orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's name, nation and region. The small tables are dimension tables; Spark checks their size."""
    orders, customer, nation, region = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def row_documents(spark, sf):
    """One document per order, with the metadata that filters use as columns."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _orders(spark, sf).select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.col("c_name").alias("customer"),
        F.col("r_name").alias("region"),
        F.col("o_orderstatus").alias("status"),
        date.alias("order_date"),
        F.col("o_totalprice").cast("double").alias("total"),
    )


ROW_DOCUMENTS = f"""SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, c_name AS customer, r_name AS region, o_orderstatus AS status,
strftime(o_orderdate, '%Y-%m-%d') AS order_date, CAST(o_totalprice AS DOUBLE) AS total FROM {ORDERS_SQL}"""


def verbalize_orders(spark, sf):
    """Orders as prose by one template."""
    text = F.format_string(
        "Order %s was placed by %s from %s on %s. Order total: %.2f. Current status: %s.",
        F.col("o_orderkey").cast("string"), "c_name", "n_name", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_totalprice", "o_orderstatus",
    )
    return _orders(spark, sf).select("o_orderkey", text.alias("text"))


VERBALIZE = f"""SELECT o_orderkey, printf('Order %s was placed by %s from %s on %s. Order total: %.2f. Current status: %s.',
CAST(o_orderkey AS VARCHAR), c_name, n_name, strftime(o_orderdate, '%Y-%m-%d'), o_totalprice, o_orderstatus) AS text FROM {ORDERS_SQL}"""


def revenue_by_region(spark, sf):
    return _orders(spark, sf).groupBy(F.col("r_name").alias("region")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).orderBy(F.desc("revenue"))


REVENUE_BY_REGION = f"SELECT r_name AS region, round(sum(o_totalprice), 2) AS revenue FROM {ORDERS_SQL} GROUP BY r_name"


def count_returned(spark, sf):
    return read(spark, sf, "lineitem").filter("l_returnflag = 'R'").agg(F.count("*").alias("n"))


def orders_by_status(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


def revenue_by_category(spark, sf):
    sold = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return sold.groupBy(F.col("p_type").alias("category")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")).orderBy(F.desc("revenue"))


def order_count(spark, sf):
    return read(spark, sf, "orders").agg(F.count("*").alias("n"))


def revenue_rollup(spark, sf):
    """Revenue by region and status with subtotals."""
    rolled = _orders(spark, sf).rollup("r_name", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n"))
    return rolled.select(F.col("r_name").alias("region"), F.col("o_orderstatus").alias("status"), "revenue", "n")


ROLLUP = f"""SELECT r_name AS region, o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(*) AS n
FROM {ORDERS_SQL} GROUP BY ROLLUP (r_name, o_orderstatus)"""


def status_intents(spark, sf):
    """Vetted answers by intent: counts of returned and of open items, and of all."""
    items = read(spark, sf, "lineitem")
    return items.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open_items"), F.count("*").alias("n"))


def filtered_topk(spark, sf):
    """Nearest five other vectors of label 1 to each hundredth vector: the filter is pushed into the scan, before the ranking."""
    vectors = read(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return nearest(vectors.filter(F.col("label") == 1), queries, "vec_id", 5, others=True)


FILTERED_TOPK = """SELECT qid, vec_id, score FROM (SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label = 1 AND e.vec_id <> q.vec_id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 5"""


def multi_hop_customers(spark, sf):
    """Customers of region ASIA who bought Brand#11: two sets of orders meet, then their customers."""
    graph = order_graph(_orders(spark, sf), read(spark, sf, "lineitem"), read(spark, sf, "part"))
    return customers_of(graph, "region:ASIA", "product:Brand#11")


MULTI_HOP = f"""SELECT DISTINCT c_name AS customer FROM {ORDERS_SQL} WHERE r_name = 'ASIA' AND o_orderkey IN
(SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#11')"""


def other_orders(spark, sf):
    """For each customer of segment BUILDING, the orders."""
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    mine = orders.join(customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return mine.select("c_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))


def graph_size(spark, sf):
    """Nodes and edges of the order graph, counted from keys."""
    items = read(spark, sf, "lineitem")
    return order_graph_size(_orders(spark, sf), items, read(spark, sf, "part"), read(spark, sf, "orders").count() + items.count())


GRAPH_SIZE = f"""WITH o AS (SELECT * FROM {ORDERS_SQL}), e AS (
SELECT 'o' || o_orderkey AS s, 'c' || c_custkey AS d, 'placed_by' AS r FROM o UNION SELECT 'o' || o_orderkey, 'r' || r_name, 'in_region' FROM o
UNION SELECT 'o' || l_orderkey, 'p' || p_brand, 'contains' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN o ON o_orderkey = l_orderkey)
SELECT (SELECT count(*) FROM (SELECT s FROM e UNION SELECT d FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges"""


def as_of_current(spark, sf):
    """Each customer's last order on or before 1997-01-01; the greater key of orders of one moment."""
    past = read(spark, sf, "orders").filter(F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz"))
    last = F.max(F.struct("o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("status")))
    return past.groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.status").alias("status"))


AS_OF = """SELECT o_custkey, o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def latest_orders(spark, sf):
    """Each customer's three last orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, sf, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


QUERIES = {
    "row_documents": (row_documents, ROW_DOCUMENTS),
    "verbalize_orders": (verbalize_orders, VERBALIZE),
    "revenue_by_region": (revenue_by_region, REVENUE_BY_REGION),
    "count_returned": (count_returned, "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "orders_by_status": (orders_by_status, "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "revenue_by_category": (
        revenue_by_category,
        "SELECT p_type AS category, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
    "order_count": (order_count, "SELECT count(*) AS n FROM orders"),
    "revenue_rollup": (revenue_rollup, ROLLUP),
    "status_intents": (
        status_intents,
        "SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open_items, count(*) AS n FROM lineitem",
    ),
    "filtered_topk": (filtered_topk, FILTERED_TOPK),
    "multi_hop_customers": (multi_hop_customers, MULTI_HOP),
    "other_orders": (
        other_orders,
        "SELECT c_custkey, o_orderkey, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "graph_size": (graph_size, GRAPH_SIZE),
    "as_of_current": (as_of_current, AS_OF),
    "latest_orders": (
        latest_orders,
        """SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3""",
    ),
}
