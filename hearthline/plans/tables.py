"""The given star schema as listings, configurations, tenancies, jobs and events; PRELUDE says the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PART_BYTES = 4 << 20  # of a table's files for each task that its rows are dealt to


class Tables:
    """Lazy frames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Tasks for the rows of a table: those of the session, or as many as the table needs for each to stay of one size."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)

    def dealt(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` by ``key`` in as many tasks as the rows of table ``name`` need, if the session has fewer."""
        n = self.parts(name)
        return df.repartition(n, key) if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    @cached_property
    def listing(self) -> DataFrame:
        place = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.read("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("property_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"))

    @cached_property
    def tenancy(self) -> DataFrame:
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("config_name"), "p_brand", "p_type", "p_size", "p_retailprice")
        line = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
        unit = F.when(F.col("l_linenumber") % 2 == 1, " weeks").otherwise(" months")
        kind = F.when(F.col("l_returnflag") == "A", "per_week").when(F.col("l_returnflag") == "N", "per_month").otherwise("total")
        rows = self.dealt(line, "lineitem", "l_partkey").join(self.dealt(part, "lineitem", "l_partkey"), "l_partkey")
        return self.dealt(rows, "lineitem", "l_suppkey").select(
            F.col("l_suppkey").alias("property_id"), "config_name", F.concat(F.col("l_quantity").cast("int").cast("string"), unit).alias("length_text"), F.concat(F.lit("£"), F.floor("l_extendedprice").cast("string")).alias("price_text"), kind.alias("price_type"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate", "p_brand", "p_type", "p_size", "p_retailprice",
        )

    @cached_property
    def configuration(self) -> DataFrame:
        return self.tenancy.groupBy("property_id", "config_name").agg(F.min("p_size").alias("area"), F.max("p_size").alias("max_area"), F.min("p_retailprice").alias("price"), F.min("p_type").alias("unit_type"), F.count(F.lit(1)).alias("options"))

    @cached_property
    def feature(self) -> DataFrame:
        return self.tenancy.select("property_id", F.col("p_brand").alias("name"), F.col("p_type").alias("type")).distinct()

    @cached_property
    def job(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
        priority = F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("5"), "low").otherwise("normal")
        return self.read("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("customer"), status.alias("status"), priority.alias("priority"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"))

    @cached_property
    def node(self) -> DataFrame:
        line = self.read("lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
        status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "completed").when(F.col("l_returnflag") == "N", "running").otherwise("pending")
        return self.dealt(line, "lineitem", "job_id").join(self.dealt(self.job.select("job_id", "created_at"), "lineitem", "job_id"), "job_id").select(
            "job_id", ((F.col("l_linenumber") - 1) % 4 + 1).alias("node"), status.alias("status"), F.col("created_at").alias("start_time"),
            F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + (F.col("l_quantity") * 60000000).cast("long")).alias("end_time"), (1 - F.col("l_discount")).alias("confidence"),
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        )

    @cached_property
    def progress(self) -> DataFrame:
        kind = F.create_map(*(F.lit(x) for p in EVENT_KINDS.items() for x in p))
        return self.read("events").select("event_id", F.col("user_id").alias("job_id"), "ts", kind[F.col("event_type")].alias("event_type"), (F.col("event_id") % 4 + 1).alias("node"), "value", "props")


EVENT_KINDS = {"signup": "job_started", "view": "node_started", "click": "node_completed", "error": "node_failed", "purchase": "job_completed"}

PRELUDE = """
WITH listing AS (SELECT s_suppkey AS property_id, s_name AS name, n_name AS city, r_name AS region, s_acctbal AS balance
                 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
tenancy AS (SELECT l_suppkey AS property_id, p_name || ' ' || p_type AS config_name,
                   CAST(l_quantity AS INT)::VARCHAR || CASE WHEN l_linenumber % 2 = 1 THEN ' weeks' ELSE ' months' END AS length_text,
                   '£' || CAST(floor(l_extendedprice) AS BIGINT)::VARCHAR AS price_text,
                   CASE l_returnflag WHEN 'A' THEN 'per_week' WHEN 'N' THEN 'per_month' ELSE 'total' END AS price_type,
                   l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate, p_brand, p_type, p_size, p_retailprice
            FROM lineitem JOIN part ON l_partkey = p_partkey),
configuration AS (SELECT property_id, config_name, min(p_size) AS area, max(p_size) AS max_area, min(p_retailprice) AS price, min(p_type) AS unit_type, count(*) AS options FROM tenancy GROUP BY ALL),
feature AS (SELECT DISTINCT property_id, p_brand AS name, p_type AS type FROM tenancy),
job AS (SELECT o_orderkey AS job_id, o_custkey AS customer, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
               CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '5' THEN 'low' ELSE 'normal' END AS priority, o_orderdate AS created_at, o_totalprice AS cost FROM orders),
node AS (SELECT l_orderkey AS job_id, (l_linenumber - 1) % 4 + 1 AS node,
                CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'N' THEN 'running' ELSE 'pending' END AS status,
                o_orderdate AS start_time, o_orderdate + to_microseconds((l_quantity * 60000000)::BIGINT) AS end_time, 1 - l_discount AS confidence, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
progress AS (SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'job_started' WHEN 'view' THEN 'node_started' WHEN 'click' THEN 'node_completed' WHEN 'error' THEN 'node_failed' WHEN 'purchase' THEN 'job_completed' END AS event_type,
                    event_id % 4 + 1 AS node, value, props FROM events)
"""
