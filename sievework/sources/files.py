"""Readers and writers of screen, annotation, genome and report files, on Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """With a header; types are given, or inferred."""
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_txt(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return read_csv(spark, path, schema, "\t")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A prepared table, by the ending of its name."""
    return spark.read.parquet(path) if path.endswith(".parquet") else read_txt(spark, path) if path.endswith((".tsv", ".txt")) else read_csv(spark, path)


def repaired_names(names: Sequence[str]) -> list[str]:
    """Blank names become column_i, a repeated name gets its count."""
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"column_{i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def read_annotation(spark: SparkSession, path: str, positions: Sequence[str] = ("STARTpos", "ENDpos")) -> DataFrame:
    """Tab-separated strings without quoting; longer lines are cut, shorter ones filled with null; positions become longs."""
    lines = spark.read.text(path)
    names = repaired_names(lines.first()[0].split("\t"))
    head = lines.first()[0]
    cells = F.split("value", "\t")
    rows = lines.where(F.col("value") != head).select(*[F.get(cells, i).alias(n) for i, n in enumerate(names)])
    return rows.withColumns({c: F.col(c).try_cast("long") for c in positions if c in names})


def read_counts(spark: SparkSession, path: str, pattern: str = r"_R\d+$") -> DataFrame:
    """Columns whose name fits become longs: blank 0, no number null, fractions cut; others stay strings."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.col(c).try_cast("double").cast("long"))
    return raw.withColumns({c: number(c) for c in raw.columns if re.search(pattern, c)})


def load_table(spark: SparkSession, path: str, efficacy: str = "efficacy") -> DataFrame:
    """Comma if the first line has one, else tab; what is no number in the efficacy column becomes null."""
    sep = "," if "," in (spark.read.text(path).first() or [""])[0] else "\t"
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.withColumn(efficacy, F.col(efficacy).try_cast("double")) if efficacy in df.columns else df


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq, valid): valid is false where a letter outside ACGTN stands."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name, seq = F.split("value", "\n", 2)[0], F.regexp_replace(F.get(F.split("value", "\n", 2), 1), r"\s", "")
    return raw.select(F.trim(name).alias("id"), seq.alias("seq")).withColumn("valid", ~F.col("seq").rlike("[^ACGTN]"))


def write_fasta(df: DataFrame, path: str, name: Column, seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), name.cast("string"), F.lit("\n"), F.col(seq))).write.text(path)


HITS = "name string, flag int, contig string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, xa string, md string, nm string"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Alignments, 14 columns."""
    return spark.read.option("sep", "\t").schema(HITS).csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("chrom string, start long, end long, name string, score double, strand string").csv(path)


def write_bed(df: DataFrame, path: str) -> None:
    df.select("chrom", "start", "end", "name", "score", "strand").write.option("sep", "\t").csv(path)


def ranked_bed(df: DataFrame, bounds: Sequence[tuple[float, str]], other: str) -> DataFrame:
    """BED rows with a colour: that of the first bound which the score is below."""
    colour = F.lit(other)
    for bound, name in sorted(bounds, reverse=True):
        colour = F.when(F.col("score") < bound, name).otherwise(colour)
    return df.select("chrom", "start", "end", "name", "score", "strand", F.col("start").alias("thick_start"), F.col("end").alias("thick_end"), colour.alias("colour"))


def amplicon_bed(df: DataFrame) -> DataFrame:
    """One BED12 line for forward primer, guide and reverse primer: rows (chrom, fwd_start, fwd_end, guide_start, guide_end, rev_start, rev_end, name)."""
    sizes = F.concat_ws(",", *[(F.col(f"{x}_end") - F.col(f"{x}_start")).cast("string") for x in ("fwd", "guide", "rev")])
    starts = F.concat_ws(",", *[(F.col(f"{x}_start") - F.col("fwd_start")).cast("string") for x in ("fwd", "guide", "rev")])
    cells = [F.col("chrom"), F.col("fwd_start").cast("string"), F.col("rev_end").cast("string"), F.col("name"), F.lit("0"), F.lit("+"), F.col("fwd_start").cast("string"), F.col("rev_end").cast("string"), F.lit("0"), F.lit("3"), sizes, starts]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def read_gene_model(spark: SparkSession, path: str) -> DataFrame:
    """One row an exon from genePred columns with comma-ended lists."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    ends = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    exons = F.arrays_zip(ends("exonStarts").alias("s"), ends("exonEnds").alias("e"))
    rows = raw.select("name", "name2", "chrom", "strand", F.col("cdsStart").cast("long").alias("cds_start"), F.col("cdsEnd").cast("long").alias("cds_end"), F.explode(exons).alias("x"))
    return rows.select("name", "name2", "chrom", "strand", "cds_start", "cds_end", F.col("x.s").cast("long").alias("exon_start"), F.col("x.e").cast("long").alias("exon_end"))


def named_genes(model: DataFrame, genes: Sequence[str]) -> DataFrame:
    """Rows whose name or name2 is asked for, whatever the case."""
    wanted = [g.upper() for g in genes]
    return model.where(F.upper("name").isin(wanted) | F.upper("name2").isin(wanted))


def first_catalog(catalogs: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of the first catalog that has the key."""
    out = None
    for c in catalogs:
        out = c if out is None else out.unionByName(c.join(out.select(key).distinct(), key, "left_anti"))
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """The same rows as CSV and as JSON records."""
    write_csv(df, f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def with_thresholds(df: DataFrame, presets: DataFrame) -> DataFrame:
    return df.join(F.broadcast(presets), "tool")


#: A target's rows as they are written.
TARGET_HITS = "rank int, guide string, hit string, locus string, hit_strand string, mismatches int, target long"


def _folder(target: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(target.cast("long")), F.lit(folders)).cast("int")


def write_hits(hits: DataFrame, path: str, folders: int | None = None) -> None:
    """A folder of off-targets for each target: rows are dealt by target first, so a folder is written by one task.

    With ``folders`` there are so many for all targets, dealt by a hash, and a target's rows stand together in the one file of its folder: a
    folder for each of many targets costs more than what is in it.
    """
    order = ["target", "rank", "mismatches"]
    if folders is None:
        hits.repartition("target").sortWithinPartitions(*order).write.partitionBy("target").option("sep", "\t").csv(path)
        return
    columns = [c.split()[0] for c in TARGET_HITS.split(", ")]
    rows = hits.select(*columns, _folder(F.col("target"), folders).alias("folder")).repartition("folder").sortWithinPartitions("folder", *order)
    rows.write.partitionBy("folder").option("sep", "\t").csv(path)


def read_target_hits(spark: SparkSession, path: str, target=None, folders: int | None = None) -> DataFrame:
    """The off-targets of one target, whose folder alone is read, or of all; ``folders`` as they were written."""
    schema = TARGET_HITS if folders is None else TARGET_HITS + ", folder int"
    df = spark.read.option("sep", "\t").schema(schema).csv(path)
    if target is not None:
        df = df.where(F.col("target") == target)
        df = df if folders is None else df.where(F.col("folder") == _folder(F.lit(target), folders))
    return df.drop("folder")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Ranked guides by white space: header and short lines go, an unreadable MM3 is 999."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.size(cells) >= 11) & ~F.col("value").startswith("Rank"))
    n = lambda i, kind: F.get(cells, i).try_cast(kind)
    return rows.select(n(0, "int").alias("rank"), F.get(cells, 1).alias("target"), F.get(cells, 2).alias("locus"), F.get(cells, 3).alias("strand"), n(4, "double").alias("gc"), n(5, "int").alias("self"), *[n(6 + i, "long").alias(f"mm{i}") for i in range(3)], F.coalesce(n(9, "long"), F.lit(999)).alias("mm3"), n(10, "double").alias("efficiency"))


def report_lines(df: DataFrame) -> DataFrame:
    """Ranked guides as tab-separated lines; a capped count is shown as >=n."""
    shown = [F.when(F.col("capped"), F.concat(F.lit(">="), F.col(f"mm{i}").cast("string"))).otherwise(F.col(f"mm{i}").cast("string")) for i in range(4)]
    return df.select(F.concat_ws("\t", F.col("rank").cast("string"), "target", *shown).alias("value"))
