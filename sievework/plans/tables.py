"""Guide, genome and repair tables that Spark derives from the given tables, and the same as SQL."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOOLS = ("tool_price", "tool_disc", "tool_tax")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where a session on one machine names none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.gettempdir()
    return os.path.join(top, f"files-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in a new shared folder, read again: made once, however often it is read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_KEY = "md5(concat_ws('|', cast(l_orderkey as {s}), cast(l_partkey as {s}), cast(l_suppkey as {s}), cast(l_linenumber as {s}), cast(cast(l_quantity as bigint) as {s}), cast(cast(round(l_extendedprice * 100) as bigint) as {s})))"
_GUIDES = (
    "{key} as guide_id", "concat('G', cast(l_orderkey as {s})) as gene", "cast(l_quantity * 2 as double) as efficacy",
    "cast(l_extendedprice as double) as tool_price", "cast(l_discount as double) as tool_disc", "case when l_linenumber = 7 then null else cast(l_tax as double) end as tool_tax",
    "concat('chr', cast(l_suppkey % 24 as {s})) as chromosome", "cast(l_partkey as bigint) as position", "case when l_returnflag = 'R' then '-' else '+' end as strand",
)


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """guide_id, gene, efficacy (2..100), three tool scores (few ties, many ties, nulls), chromosome, position, strand."""
    return read(spark, sf_dir, "lineitem").selectExpr(*(x.format(key=_KEY.format(s="string"), s="string") for x in _GUIDES))


GUIDES = "guides as (select " + ", ".join(_GUIDES).format(key=_KEY.format(s="varchar"), s="varchar") + " from lineitem)"


def long_guides(spark: SparkSession, sf_dir: str, ids: tuple[str, ...] = ("guide_id", "gene", "efficacy"), together: str | None = None) -> DataFrame:
    from sievework.operators import columns

    return columns.to_long(guides(spark, sf_dir), ids, TOOLS, together=together)


LONG = GUIDES + ", long as (" + " union all ".join(f"select guide_id, gene, efficacy, '{t}' as tool, {t} as score from guides" for t in TOOLS) + ")"


def essential(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    top = orders.agg(F.min("o_orderpriority").alias("p"))
    return orders.join(F.broadcast(top), F.col("o_orderpriority") == F.col("p")).select(F.concat(F.lit("G"), F.col("o_orderkey").cast("string")).alias("gene")).distinct()


ESSENTIAL = "essential as (select distinct concat('G', cast(o_orderkey as varchar)) as gene from orders where o_orderpriority = (select min(o_orderpriority) from orders))"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), F.regexp_replace(F.upper("text"), "[^ACGT]+", "").alias("seq"))


DNA = "dna as (select doc_id as contig, regexp_replace(upper(text), '[^ACGT]', '', 'g') as seq from documents)"


#: Lines of the largest table in one partition of the exons, at most about so many: what a task sorts doesn't grow with the table.
EXONS_A_TASK = 250_000


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, tx, strand, exon_start, exon_end: one row an exon. Exons of a gene come together, so what groups by gene and
    others needs no further shuffle; the number of partitions follows from the number of lines, which Parquet's footers have."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + l.count() // EXONS_A_TASK)
    o, l = o.select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey"), l.select("l_orderkey", "l_partkey", "l_quantity").repartition(parts, "l_orderkey")
    met = o.join(l, o.o_orderkey == l.l_orderkey).selectExpr("o_custkey", "o_orderkey", "cast(l_partkey * 10 as bigint) as exon_start", "cast(l_partkey * 10 + cast(l_quantity as bigint) as bigint) as exon_end").distinct()  # before keys are cast: no shuffle
    return met.selectExpr("concat('C', cast(o_custkey as string)) as gene", "cast(o_orderkey as string) as tx", "case when o_orderkey % 2 = 0 then '+' else '-' end as strand", "exon_start", "exon_end").repartition(parts, "gene")


EXONS = """exons as (select distinct concat('C', cast(o_custkey as varchar)) as gene, cast(o_orderkey as varchar) as tx, case when o_orderkey % 2 = 0 then '+' else '-' end as strand,
 cast(l_partkey * 10 as bigint) as exon_start, cast(l_partkey * 10 + cast(l_quantity as bigint) as bigint) as exon_end from orders join lineitem on o_orderkey = l_orderkey)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    total = e.groupBy("user_id").agg(F.sum("value").alias("total"))
    return e.join(total, "user_id").selectExpr("cast(user_id as bigint) as guide", "case when event_type in ('click','view') then 'del' else 'ins' end as category", "cast(1 + event_id % 59 as bigint) as len", "value / total as freq")


OUTCOMES = "outcomes as (select cast(user_id as bigint) as guide, case when event_type in ('click','view') then 'del' else 'ins' end as category, cast(1 + event_id % 59 as bigint) as len, value / sum(value) over (partition by user_id) as freq from events)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*(x.format(key=_KEY.format(s="string"), s="string") for x in _COUNTS))


_COUNTS = (
    "{key} as guide_id", "concat('E', cast(l_suppkey % 5 as {s})) as experiment", "cast(l_quantity as bigint) as t0_r1", "cast(l_linenumber + 10 as bigint) as t0_r2",
    "cast(floor(l_quantity * (1 - l_discount * 8)) as bigint) as t12_r1", "concat('{{', cast(cast(l_quantity as bigint) as {s}), ',', cast(l_linenumber + 10 as {s}), '}}') as packed",
)
COUNTS = "counts as (select " + ", ".join(_COUNTS).format(key=_KEY.format(s="varchar"), s="varchar") + " from lineitem)"


def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").selectExpr("doc_id", "quality as label", "cast(n_chars as double) as score")


BINARY = "binary_labels as (select doc_id, quality as label, cast(n_chars as double) as score from labels join documents using (doc_id))"
