"""Queries for projections, filters and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import columns as C
from sievework.plans import tables as t
from sievework.plans.registry import query

G = "with " + t.GUIDES


@query("p01_rename", G + " select guide_id, gene as symbol, efficacy as effect from guides")
def _(s, d):
    return C.rename(t.guides(s, d), {"gene": "symbol", "efficacy": "effect", "absent": "x"}).select("guide_id", "symbol", "effect")


@query("p02_cast_present", "select event_id, try_cast(properties as double) as properties, cast(value as double) as value from (select event_id, event_type as properties, value from events)")
def _(s, d):
    return C.cast_present(t.read(s, d, "events").selectExpr("event_id", "event_type as properties", "value"), ["properties", "value", "absent"])


@query("p03_require_columns", G + " select chromosome, strand, position, efficacy from guides")
def _(s, d):
    need = ["chromosome", "strand", "position", "efficacy"]
    return C.require_columns(t.guides(s, d), need).select(*need)


@query("p04_minimal_slice", G + " select gene, efficacy, guide_id from guides")
def _(s, d):
    return t.guides(s, d).select("gene", "efficacy", "guide_id")


@query("p05_tool_columns", G + " select count(tool_price)::bigint as tool_price, count(tool_disc)::bigint as tool_disc, count(tool_tax)::bigint as tool_tax from guides")
def _(s, d):
    g = t.guides(s, d)
    return g.agg(*[F.count(c).alias(c) for c in C.tool_columns(g, ("position", "start", "end"), ("efficacy",))])


@query("p06_strip_suffix", "select c_custkey, c_name || '#' as gene from customer")
def _(s, d):
    raw = t.read(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit("#"), F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(")")).alias("raw"))
    return raw.select("c_custkey", C.strip_parenthesised(F.col("raw")).alias("gene"))


@query("p07_split_alignment", G + " select guide_id, chromosome, position, strand from guides")
def _(s, d):
    raw = t.guides(s, d).select("guide_id", F.concat_ws("_", "chromosome", F.col("position").cast("string"), "strand").alias("raw"))
    return raw.select("guide_id", *[c.alias(n) for n, c in C.split_alignment(F.col("raw")).items()])


@query("p08_split_gene_guide", G + " select gene, guide_id || '_x' as guide from guides")
def _(s, d):
    a, b = C.split_first(F.col("raw"))
    return t.guides(s, d).select(F.concat_ws("_", "gene", "guide_id", F.lit("x")).alias("raw")).select(a.alias("gene"), b.alias("guide"))


@query("p09_strand_window", G + " select guide_id, case when strand = '+' then position - 16 else position - 5 end as start, case when strand = '+' then position - 15 else position - 4 end as stop from guides")
def _(s, d):
    a, b = C.strand_window(F.col("position"), F.col("strand"))
    return t.guides(s, d).select("guide_id", a.alias("start"), b.alias("stop"))


@query("p10_cut_site", G + " select guide_id, case when strand = '+' then position + 17 else position + 23 - 6 end as cut from guides")
def _(s, d):
    return t.guides(s, d).select("guide_id", C.cut_site(F.col("position"), F.col("position") + 23, F.col("strand")).alias("cut"))


@query("p11_scale_efficacy", G + " select guide_id, round(tool_disc * 100, 6) as efficacy from guides")
def _(s, d):
    return t.guides(s, d).select("guide_id", F.round(F.col("tool_disc") * 100, 6).alias("efficacy"))


@query("p12_depletion_efficacy", G + " select guide_id, round(case when tool_disc - 0.05 < 0 then (tool_disc - 0.05) / -10 * 100 else 0 end, 6) as efficacy from guides")
def _(s, d):
    return t.guides(s, d).select("guide_id", F.round(C.depletion_efficacy(F.col("tool_disc") - 0.05), 6).alias("efficacy"))


@query("p13_chr_prefix", G + " select guide_id, chromosome from guides")
def _(s, d):
    mixed = F.when(F.col("strand") == "+", F.col("chromosome")).otherwise(F.expr("substring(chromosome, 4)"))
    return t.guides(s, d).select("guide_id", C.with_prefix(mixed).alias("chromosome"))


@query("p14_upper_sequences", G + " select guide_id, upper(lower(gene)) as sgrna_sequence, lower(chromosome) as name from guides")
def _(s, d):
    return C.upper_sequences(t.guides(s, d).selectExpr("guide_id", "lower(gene) as sgrna_sequence", "lower(chromosome) as name"))


@query("p15_constant", G + " select guide_id, 'screen-1' as screen from guides")
def _(s, d):
    return t.guides(s, d).select("guide_id", F.lit("screen-1").alias("screen"))


@query("p16_row_key", G + " select md5(concat_ws('|', gene, cast(position as varchar), strand)) as guide_key, count(*)::bigint as n from guides group by 1")
def _(s, d):
    return C.row_key(t.guides(s, d), ["gene", "position", "strand"], "guide_key").groupBy("guide_key").agg(F.count(F.lit(1)).alias("n"))


@query("p17_drop_nulls", G + " select guide_id, tool_tax from guides where tool_tax is not null")
def _(s, d):
    return C.without_nulls(t.guides(s, d), ["tool_tax"]).select("guide_id", "tool_tax")


@query("p18_drop_helpers", G + " select guide_id, gene from guides")
def _(s, d):
    g = t.guides(s, d)
    return g.drop(*[c for c in g.columns if c not in ("guide_id", "gene")])


@query("p19_min_max", G + " select guide_id, round((tool_tax - (select min(tool_tax) from guides)) / (select max(tool_tax) - min(tool_tax) from guides) * 100, 6) as scaled from guides")
def _(s, d):
    return C.min_max_100(t.guides(s, d), "tool_tax", "scaled").select("guide_id", F.round("scaled", 6).alias("scaled"))


@query("p20_z_score", G + " select guide_id, round((tool_price - (select avg(tool_price) from guides)) / (select greatest(stddev_samp(tool_price), 1e-9) from guides), 6) as tool_price_z from guides")
def _(s, d):
    return C.z_scores(t.guides(s, d), ["tool_price"]).select("guide_id", F.round("tool_price_z", 6).alias("tool_price_z"))


@query("p21_unpivot", "with " + t.LONG + " select guide_id, tool, score from long")
def _(s, d):
    return t.long_guides(s, d, ("guide_id",))


@query("p21_pivot", G + " select guide_id, min(tool_price) as tool_price, min(tool_disc) as tool_disc, min(tool_tax) as tool_tax from guides group by 1")
def _(s, d):
    return C.to_wide(t.long_guides(s, d, ("guide_id",)), ["guide_id"], t.TOOLS)


@query("f01_viability", "select event_id, event_type from events where event_type in ('click', 'purchase') and value is not null")
def _(s, d):
    named = F.when(F.col("event_type") == "click", C.VIABILITY[0]).when(F.col("event_type") == "purchase", C.VIABILITY[1]).otherwise("other")
    return C.viability_screens(t.read(s, d, "events").withColumn("condition", named), final="value").select("event_id", "event_type")


@query("f02_key_columns", G + " select guide_id from guides where tool_tax is not null and gene is not null and chromosome is not null")
def _(s, d):
    return C.without_nulls(t.guides(s, d), ["tool_tax", "gene", "chromosome"]).select("guide_id")


@query("f03_labelled", "select d.doc_id, l.quality from documents d left join labels l using (doc_id) where l.quality is not null")
def _(s, d):
    return t.read(s, d, "documents").join(t.read(s, d, "labels"), "doc_id", "left").where("quality is not null").select("doc_id", "quality")


@query("f04_no_margin", G + " select guide_id, case when efficacy < 85 then 'poor' else 'good' end as bucket from guides where efficacy < 85 or efficacy > 95")
def _(s, d):
    return C.without_margin(t.guides(s, d).withColumn("bucket", C.margin_classes(F.col("efficacy"), 85, 95))).select("guide_id", "bucket")


@query("f05_group_size", G + " select guide_id, gene from guides where gene in (select gene from guides group by gene having count(*) >= 4)")
def _(s, d):
    return C.groups_of_at_least(t.guides(s, d), "gene", 4).select("guide_id", "gene")


@query("f09_tools_with_points", "with " + t.LONG + " select tool, count(*)::bigint as n from long where score is not null group by tool having count(*) >= 10")
def _(s, d):
    return C.tools_with_points(t.long_guides(s, d))


def _bucket(name, column, sql):
    query(name, G + f" select bucket, count(*)::bigint as n, round(coalesce(sum(efficacy), 0), 6) as total from (select *, {sql} as bucket from guides) group by bucket")(
        lambda s, d: t.guides(s, d).groupBy(column(F.col("efficacy")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("efficacy"), F.lit(0.0)), 6).alias("total"))
    )


_bucket("b01_two_classes", lambda e: C.two_classes(e, 90), "case when efficacy >= 90 then 'good' else 'other' end")
_bucket("b02_margin", lambda e: C.margin_classes(e, 85, 95), "case when efficacy < 85 then 'poor' when efficacy > 95 then 'good' else 'ignore' end")
_bucket("b03_three_classes", C.three_classes, "case when efficacy < 60 then 'Poor' when efficacy >= 90 then 'Good' when efficacy is not null then 'Moderate' end")
_bucket("b04_three_bins", C.three_bins, "case when efficacy <= 60 then 'Poor' when efficacy <= 90 then 'Moderate' when efficacy is not null then 'Good' end")
_bucket("b05_bands", C.efficacy_band, "case when efficacy >= 90 then 'Severe' when efficacy >= 70 then 'Strong' when efficacy >= 40 then 'Moderate' when efficacy >= 20 then 'Weak' when efficacy > 0 then 'Minimal' else 'None' end")
_bucket("b06_deciles", C.decile, "least(floor(efficacy / 10), 9)::bigint")


@query("b07_class_bins", G + """, b as (select least(floor(efficacy / 2) * 2, 98)::double as bin, case when efficacy < 60 then 'Poor' when efficacy >= 90 then 'Good' else 'Moderate' end as class from guides)
select bin, class, count(*)::bigint as n, round(count(*) * 100.0 / sum(count(*)) over (partition by class), 6) as share from b group by bin, class""")
def _(s, d):
    from sievework.operators import metrics

    return metrics.class_bins(t.guides(s, d))


@query("b08_histogram", G + """, e as (select min(tool_price) as low, max(tool_price) as high from guides)
select least(floor((tool_price - low) / ((high - low) / 30)), 29)::bigint as bin, count(*)::bigint as n from guides, e group by 1""")
def _(s, d):
    return C.histogram(t.guides(s, d), "tool_price", 30)
