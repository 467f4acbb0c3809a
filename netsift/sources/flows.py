"""Flow scan (S1), live source (S3) and test-table adapters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.schema import FLOW_SCHEMA, PACKET_SCHEMA
from netsift.sources import fixtures as fx


def conform(df: DataFrame, schema=FLOW_SCHEMA) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present columns, add missing ones as NULL.

    The reference probes columns at run time and disables an operator when one
    is missing; here the schema is fixed and absent columns are typed NULLs.
    """
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            same = df.schema[f.name].dataType == f.dataType
            cols.append((F.col(f.name) if same else F.col(f.name).try_cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_flows(spark: SparkSession, path: str, fmt: str = "parquet",
               options: dict | None = None) -> DataFrame:
    """Scan a flow table. Empty input gives an empty frame with FLOW_SCHEMA.

    Parquet keeps its own schema (so column pruning and pushdown reach the
    files) and is conformed afterwards; text formats are read with the schema.
    """
    reader = spark.read.options(**(options or {}))
    if fmt == "parquet":
        return conform(reader.parquet(path))
    if fmt == "csv":
        # header names, not positions, decide the columns: read as text, cast by name
        return conform(reader.option("header", "true").option("inferSchema", "false").csv(path))
    if fmt == "json":
        return conform(reader.schema(FLOW_SCHEMA).json(path))
    return conform(reader.format(fmt).load(path))


def read_flow_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """S3: a flow stream over landed files (Kafka works the same way with a
    ``from_json`` projection). Always read with the fixed schema."""
    r = spark.readStream.schema(FLOW_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return conform(r.load(path))


def read_flow_stream_kafka(spark: SparkSession, bootstrap_servers: str, topic: str,
                           starting_offsets: str = "latest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """S3 over Kafka: JSON flow records in the message value, parsed with
    ``from_json`` against FLOW_SCHEMA. Needs the spark-sql-kafka connector on
    the cluster's classpath (not part of this image)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    raw = r.load()
    return conform(raw.select(F.from_json(F.col("value").cast("string"), FLOW_SCHEMA).alias("f")).select("f.*"))


# --- test-table adapters ------------------------------------------------------

def flows_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """FIXTURES B.1-B.3 as three narrow projections (no shuffle)."""
    w = lineitem.selectExpr(*fx.select_list(fx.LINEITEM_WORK, "spark"))
    b = w.selectExpr("*", *fx.select_list(fx.LINEITEM_BYTES, "spark"))
    return conform(b.selectExpr(*fx.select_list(fx.FLOW_EXPRS, "spark")))


def packets_from_events(events: DataFrame) -> DataFrame:
    return conform(events.selectExpr(*fx.select_list(fx.PACKET_EXPRS, "spark")), PACKET_SCHEMA)


def ip_reputation_from_customer(customer: DataFrame) -> DataFrame:
    return (customer.selectExpr(*fx.select_list(fx.IP_REPUTATION_EXPRS, "spark")))


def domain_reputation_from_part(part: DataFrame) -> DataFrame:
    return (part.selectExpr(*fx.select_list(fx.DOMAIN_REPUTATION_EXPRS, "spark")))


@dataclass
class Tables:
    """Lazy handles on the driver's test tables and their flow-analytics views."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        key = ("raw", name)
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[key]

    @property
    def flows(self) -> DataFrame:
        return flows_from_lineitem(self.raw("lineitem"))

    @property
    def packets(self) -> DataFrame:
        return packets_from_events(self.raw("events"))

    @property
    def ip_reputation(self) -> DataFrame:
        return ip_reputation_from_customer(self.raw("customer"))

    @property
    def domain_reputation(self) -> DataFrame:
        return domain_reputation_from_part(self.raw("part"))

    @property
    def urls(self) -> DataFrame:
        return self.raw("pages").select("page_id", "url")

    def literal(self, values: list[str], col: str) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{col} string")

    @property
    def threat_domains(self) -> DataFrame:
        return self.literal(fx.THREAT_DOMAINS, "value")

    @property
    def threat_cidrs(self) -> DataFrame:
        return self.literal(fx.THREAT_CIDRS, "value")

    @property
    def threat_urls(self) -> DataFrame:
        return self.urls.where(fx.THREAT_URL_RULE).select(F.col("url").alias("value"))


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
