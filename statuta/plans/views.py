"""The register, its graph and other inputs, derived from the given tables; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():  # noqa: ANN201
    return F.lit(AS_OF).cast("date")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One obligation per order: severity by priority, evidence by status, the order's date as deadline."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    kinds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obligation_id")).agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("intermediary_types"))
    level = F.substring("o_orderpriority", 1, 1)
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 4
    rows = orders.select(
        F.col("o_orderkey").alias("obligation_id"),
        F.col("o_custkey").alias("circular_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("System review of "), F.lower("o_orderpriority")).alias("description"),
        F.when(level.isin("1", "2"), "high").when(level.isin("3", "4"), "medium").otherwise("low").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "P", "yellow").otherwise("red").alias("evidence_status"),
        F.when(kind == 1, "within 30 days").when(kind == 2, "on a quarterly basis").otherwise(date).alias("deadline"),
        F.when(kind == 1, "relative").when(kind == 2, "recurring").otherwise("fixed").alias("deadline_type"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderkey") % 10 == 0, "superseded").otherwise("active").alias("status"),
        F.array(F.lower("o_orderpriority"), F.concat(F.lit("risk "), level)).alias("keywords"),
        F.array(F.lit("Ledger extract"), F.concat(F.lit("Report "), level)).alias("evidence_requirements"),
        F.array().cast("array<bigint>").alias("related_obligations"),
        F.array().cast("array<bigint>").alias("superseded_by"),
        F.lit("File the report").alias("required_action"),
        F.concat(F.lit("Clause "), level).alias("clause_reference"),
    )
    parties = customers.select(F.col("c_custkey").alias("circular_id"), F.concat(F.col("c_mktsegment"), F.lit(" desk")).alias("responsible_party"))
    return rows.join(kinds, "obligation_id", "left").withColumn("intermediary_types", F.coalesce("intermediary_types", F.array().cast("array<string>"))).join(parties, "circular_id", "left")


#: SQL of the register, to stand before a query.
REGISTER = f"""
kinds AS (SELECT l_orderkey k, list_sort(list(DISTINCT l_returnflag || l_linestatus)) t FROM lineitem GROUP BY 1),
register AS (
  SELECT o_orderkey AS obligation_id, o_custkey AS circular_id, 'Order ' || o_orderkey AS title, 'System review of ' || lower(o_orderpriority) AS description,
    CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'high' WHEN o_orderpriority[1] IN ('3','4') THEN 'medium' ELSE 'low' END AS severity,
    CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'P' THEN 'yellow' ELSE 'red' END AS evidence_status,
    CASE o_orderkey % 4 WHEN 1 THEN 'within 30 days' WHEN 2 THEN 'on a quarterly basis' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
    CASE o_orderkey % 4 WHEN 1 THEN 'relative' WHEN 2 THEN 'recurring' ELSE 'fixed' END AS deadline_type,
    CASE o_orderkey % 4 WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) END AS days_remaining,
    o_orderdate AS created_at, CASE WHEN o_orderkey % 10 = 0 THEN 'superseded' ELSE 'active' END AS status,
    [lower(o_orderpriority), 'risk ' || o_orderpriority[1]] AS keywords, ['Ledger extract', 'Report ' || o_orderpriority[1]] AS evidence_requirements,
    coalesce(t, []) AS intermediary_types, c_mktsegment || ' desk' AS responsible_party, 'Clause ' || o_orderpriority[1] AS clause_reference
  FROM orders LEFT JOIN kinds ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey
)"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each order to the same customer's next one by date."""
    from pyspark.sql.window import Window

    orders = table(spark, sf_dir, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders.select(F.col("o_orderkey").alias("src"), nxt.alias("dst")).filter("dst is not null").select("src", "dst", F.lit("related").alias("edge_type"), F.lit(1.0).alias("weight"))


ORDER_EDGES = "order_edges AS (SELECT * FROM (SELECT o_orderkey src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) dst FROM orders) WHERE dst IS NOT NULL)"

SCORED = (
    REGISTER
    + ", "
    + ORDER_EDGES
    + """, scored AS (
  SELECT r.*, coalesce(d.n, 0) dependents,
    CAST(least(CASE severity WHEN 'high' THEN 40 WHEN 'medium' THEN 20 WHEN 'low' THEN 5 ELSE 20 END + CASE evidence_status WHEN 'red' THEN 30 WHEN 'yellow' THEN 15 WHEN 'green' THEN 0 ELSE 30 END
      + CASE WHEN days_remaining < 0 THEN 20 WHEN days_remaining <= 7 THEN 15 WHEN days_remaining <= 30 THEN 10 WHEN days_remaining <= 90 THEN 5 ELSE 0 END
      + least(2 * coalesce(d.n, 0), 10), 100) AS DOUBLE) AS risk_score
  FROM register r LEFT JOIN (SELECT src, count(*) n FROM order_edges GROUP BY 1) d ON d.src = r.obligation_id
), ranked AS (SELECT *, CASE WHEN risk_score <= 30 THEN 'Low' WHEN risk_score <= 65 THEN 'Medium' ELSE 'High' END AS risk_label FROM scored)"""
)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges part -> supplier -> nation -> region, with prefixed ids."""
    pair = lambda a, x, b, y: (F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    parts = table(spark, sf_dir, "lineitem").select(*pair("p", "l_partkey", "s", "l_suppkey")).distinct()
    suppliers = table(spark, sf_dir, "supplier").select(*pair("s", "s_suppkey", "n", "s_nationkey"))
    nations = table(spark, sf_dir, "nation").select(*pair("n", "n_nationkey", "r", "n_regionkey"))
    return parts.unionByName(suppliers).unionByName(nations).withColumn("edge_type", F.lit("depends_on")).withColumn("weight", F.lit(1.0))


SUPPLY_EDGES = """supply_edges AS (
  SELECT DISTINCT 'p' || l_partkey src, 's' || l_suppkey dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
), supply_nodes AS (SELECT src id FROM supply_edges UNION SELECT dst FROM supply_edges)"""


def supply_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("obligation_id")).unionByName(edges.select(F.col("dst").alias("obligation_id"))).distinct()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents under the engine's names."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("circular_id"), F.col("text").alias("document_text"), "lang", "source")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("circular_id"), F.col("turn").alias("id"), "role", "text")
