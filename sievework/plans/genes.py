"""Queries for balancing and within-gene evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievework.operators import columns as C
from sievework.operators import genes as g
from sievework.operators import metrics as M
from sievework.plans import tables as t
from sievework.plans.registry import query

def margin():
    return C.margin_classes(F.col("efficacy"), 85, 95)

B = "with " + t.GUIDES + ", b as (select *, case when efficacy < 85 then 'poor' when efficacy > 95 then 'good' else 'ignore' end as bucket from guides), c as (select * from b where bucket <> 'ignore')"
L = "with " + t.LONG
def bad():
    return F.col("efficacy") < 60

SMALL = L + ", g as (select gene from guides group by gene having count(*) = 4 and count(*) filter (efficacy < 60) = 1), l4 as (select * from long where gene in (select gene from g))"


def _b(s, d):
    return t.guides(s, d).withColumn("bucket", margin())


def _c(s, d):
    return C.without_margin(_b(s, d))


def _l4(s, d):
    return C.to_long(g.one_bad_of(t.guides(s, d), bad()), ("guide_id", "gene", "efficacy"), t.TOOLS)


@query("a01_two_class_genes", B + " select guide_id, gene from c where gene in (select gene from c group by gene having count(distinct bucket) > 1)")
def _(s, d):
    return g.drop_one_class_genes(_c(s, d)).select("guide_id", "gene")


@query("a02_gap_genes", B + " select gene, max(efficacy) filter (bucket = 'good') as max_good, min(efficacy) filter (bucket = 'poor') as min_poor from c group by gene having max_good - min_poor > 40")
def _(s, d):
    return g.gap_genes(_c(s, d), 40)


@query("a03_class_counts", B + " select gene, count(*)::bigint as total, count(*) filter (bucket = 'ignore')::bigint as margin, count(*) filter (bucket = 'good')::bigint as good, count(*) filter (bucket = 'poor')::bigint as poor, round(count(*) filter (bucket = 'ignore') / count(*), 6) as margin_share from b group by gene")
def _(s, d):
    return g.class_counts(_b(s, d)).withColumn("margin_share", M.r6("margin_share"))


@query("a04_smallest_class", B + " select min(n)::bigint as smallest from (select count(*) as n from c group by bucket)")
def _(s, d):
    return g.smallest_class(_c(s, d))


@query("a05_bad_counts", "with " + t.GUIDES + ", x as (select gene, count(*)::bigint as total, count(*) filter (efficacy < 60)::bigint as bad from guides group by gene) select total, bad, count(*)::bigint as genes from x group by 1, 2")
def _(s, d):
    return g.bad_counts(t.guides(s, d), bad()).groupBy("total", "bad").agg(F.count(F.lit(1)).alias("genes"))


@query("a05_one_bad_of_four", SMALL + " select guide_id, gene from guides where gene in (select gene from g)")
def _(s, d):
    return g.one_bad_of(t.guides(s, d), bad()).select("guide_id", "gene")


@query("w01_lowest_scored", SMALL + " select tool, gene, guide_id, efficacy < 60 as bad from (select *, row_number() over (partition by tool, gene order by score nulls first, guide_id) as k from l4) where k = 1")
def _(s, d):
    return g.lowest_scored(_l4(s, d)).select("tool", "gene", "guide_id", bad().alias("bad"))


ENDS = """, v as (select * from long where score is not null and efficacy is not null), e as (select tool, gene, first(guide_id order by score desc, guide_id) as top_score, first(guide_id order by efficacy desc, guide_id) as top_efficacy,
 first(guide_id order by score, guide_id) as bottom_score, first(guide_id order by efficacy, guide_id) as bottom_efficacy, count(*)::bigint as n from v group by 1, 2)"""


@query("w02_top_and_bottom", L + ENDS + " select * from e")
def _(s, d):
    return g.top_and_bottom(t.long_guides(s, d, together="gene"))


@query("w03_problem_guides", L + ", x as (select *, min(score) over (partition by tool, gene) as low from long) select tool, count(*)::bigint as bad, count(*) filter (score > low)::bigint as problems, round(count(*) filter (score > low) / count(*), 6) as failed_share from x where efficacy < 60 group by tool")
def _(s, d):
    return g.problem_guides(t.long_guides(s, d), bad()).withColumn("failed_share", M.r6("failed_share"))


@query("w04_ranks_within_gene", "with " + t.GUIDES + " select guide_id, rank() over (partition by gene order by tool_disc desc) + (count(*) over (partition by gene, tool_disc) - 1) / 2 as r from guides")
def _(s, d):
    return g.ranks_within(t.guides(s, d), ("gene",), "tool_disc", "r").select("guide_id", "r")


@query("w05_balanced_sample", B + """, n as (select gene, bucket, count(*) as n from c group by 1, 2), k as (select gene, min(n) as k from n group by 1 having count(*) > 1),
r as (select c.*, row_number() over (partition by gene, bucket order by md5(concat('42', guide_id)), guide_id) as r from c) select guide_id, gene, bucket from r join k using (gene) where r <= k""")
def _(s, d):
    return g.balanced_sample(_c(s, d)).select("guide_id", "gene", "bucket")


@query("w06_undersampled", B + """, k as (select min(n) as k from (select count(*) as n from c group by bucket)), r as (select *, row_number() over (partition by bucket order by md5(concat('42', guide_id)), guide_id) as r from c) select guide_id, bucket from r, k where r <= k""")
def _(s, d):
    return g.undersampled(_c(s, d)).select("guide_id", "bucket")


@query("w07_six_to_four", "with " + t.GUIDES + """, c as (select *, case when efficacy < 50 then 'poor' else 'good' end as bucket from guides), n as (select gene from c group by gene having (count(*) filter (bucket = 'good'), count(*) filter (bucket = 'poor')) in ((3, 3), (4, 2), (2, 4))),
r as (select *, row_number() over (partition by gene, bucket order by md5(concat('42', guide_id)), guide_id) as r from c where gene in (select gene from n)) select guide_id, gene, bucket from r where r <= 2""")
def _(s, d):
    return g.six_to_four(t.guides(s, d).withColumn("bucket", F.when(F.col("efficacy") < 50, "poor").otherwise("good"))).select("guide_id", "gene", "bucket")


@query("j09_kept_genes", B + " select guide_id from guides where gene in (select gene from c where bucket = 'good')")
def _(s, d):
    return t.guides(s, d).join(_c(s, d).where("bucket = 'good'").select("gene").distinct(), "gene", "left_semi").select("guide_id")


@query("j10_kept_status", B + " select b.gene, count(distinct b.guide_id)::bigint as before, (select count(*) from c where c.gene = b.gene)::bigint as after, case when (select count(*) from c where c.gene = b.gene) > 0 then 'kept' else 'dropped' end as status from b group by b.gene")
def _(s, d):
    return g.kept_status(_b(s, d), _c(s, d))


@query("j11_derived_genes", SMALL + " select tool, guide_id, round(score, 6) as score from l4")
def _(s, d):
    return _l4(s, d).select("tool", "guide_id", M.r6("score").alias("score"))


@query("u03_dropped_genes", B + " select distinct gene from guides except select gene from c")
def _(s, d):
    return t.guides(s, d).select("gene").distinct().join(_c(s, d).select("gene").distinct(), "gene", "left_anti")


@query("e16_within_gene_ranking", L + ENDS + """, y as (select tool, gene from long group by 1, 2 having count(*) >= 2 and count(score) = count(*) and count(distinct score) > 1 and count(distinct efficacy) > 1),
r as (select tool, gene, rank() over (partition by tool, gene order by score desc) + (count(*) over (partition by tool, gene, score) - 1) / 2 as x, rank() over (partition by tool, gene order by efficacy desc) + (count(*) over (partition by tool, gene, efficacy) - 1) / 2 as y2 from long semi join y using (tool, gene)),
h as (select tool, count(*) as high from (select tool, gene, corr(x, y2) as s from r group by 1, 2) where round(s, 9) > 0.5 group by 1)
select tool, count(*)::bigint as genes, round(avg((top_score = top_efficacy)::int), 6) as top_agreement, round(avg((bottom_score = bottom_efficacy)::int), 6) as bottom_agreement, round(coalesce(any_value(high), 0) / count(*), 6) as high_spearman_share from e left join h using (tool) where n > 1 group by tool""")
def _(s, d):
    r = g.within_gene_ranking(t.long_guides(s, d, together="gene"))
    return r.select("tool", "genes", *[M.r6(c).alias(c) for c in ("top_agreement", "bottom_agreement", "high_spearman_share")])


@query("e17_within_gene_agreement", L + ENDS + """, y as (select tool, gene from long group by 1, 2 having count(*) >= 3 and count(score) = count(*) and count(distinct score) > 1 and count(distinct efficacy) > 1),
r as (select tool, gene, rank() over (partition by tool, gene order by score) + (count(*) over (partition by tool, gene, score) - 1) / 2 as x, rank() over (partition by tool, gene order by efficacy) + (count(*) over (partition by tool, gene, efficacy) - 1) / 2 as y2 from long semi join y using (tool, gene)),
c as (select tool, gene, corr(x, y2) as s from r group by 1, 2),
q as (select tool, gene, sign(a.score - b.score) * sign(a.efficacy - b.efficacy) as s, a.score <> b.score as dx, a.efficacy <> b.efficacy as dy from long a join long b using (tool, gene) semi join y using (tool, gene) where a.guide_id < b.guide_id),
k as (select tool, gene, sum(s) / sqrt(count(*) filter (dx)::double * count(*) filter (dy)) as tau from q group by 1, 2)
select tool, count(*)::bigint as genes, round(avg(s), 6) as mean_spearman, round(avg(tau), 6) as mean_kendall, round(avg((top_score = top_efficacy)::int), 6) as best_agreement, round(avg((bottom_score = bottom_efficacy)::int), 6) as worst_agreement from c join k using (tool, gene) join e using (tool, gene) group by tool""")
def _(s, d):
    r = g.agreement_within(t.long_guides(s, d, together="gene"))
    return r.select("tool", "genes", *[M.r6(c).alias(c) for c in ("mean_spearman", "mean_kendall", "best_agreement", "worst_agreement")])


AUROC = L + """, a as (select tool, gene, count(*) filter (efficacy >= 60) as p, count(*) filter (not efficacy >= 60) as n from long where score is not null group by 1, 2),
w as (select x.tool, x.gene, count(*) as w from long x join long y on x.tool = y.tool and x.gene = y.gene and x.efficacy >= 60 and not y.efficacy >= 60 and x.score > y.score group by 1, 2),
z as (select tool, gene, (p + n)::bigint as guides, case when p * n > 0 then coalesce(w, 0) / (p * n) end as auroc from a left join w using (tool, gene))"""


def _auroc(s, d):
    return g.strict_auroc(t.long_guides(s, d), F.col("efficacy") >= 60)


@query("e19_strict_auroc", AUROC + " select tool, gene, guides, round(auroc, 6) as auroc from z")
def _(s, d):
    return _auroc(s, d).withColumn("auroc", M.r6("auroc"))


@query("a10_auroc_by_guides", AUROC + " select tool, guides, count(auroc)::bigint as n, round(avg(auroc), 6) as mean, round(stddev_samp(auroc), 6) as std, round(min(auroc), 6) as low, round(max(auroc), 6) as high from z where auroc is not null group by 1, 2")
def _(s, d):
    a = F.col("auroc")
    return _auroc(s, d).where("auroc is not null").groupBy("tool", "guides").agg(F.count(a).alias("n"), M.r6(F.avg(a)).alias("mean"), M.r6(F.stddev_samp(a)).alias("std"), M.r6(F.min(a)).alias("low"), M.r6(F.max(a)).alias("high"))


@query("a11_ranked_means", AUROC + ", m as (select tool, avg(auroc) as mean from z group by tool) select tool, round(mean, 6) as mean, row_number() over (order by mean desc)::integer as place from m")
def _(s, d):
    m = _auroc(s, d).groupBy("tool").agg(F.avg("auroc").alias("mean"))
    return m.select("tool", M.r6("mean").alias("mean"), F.row_number().over(W.Window.partitionBy(F.lit(1)).orderBy(F.col("mean").desc())).alias("place"))


@query("a12_perfect_share", AUROC + " select tool, guides, round(avg((auroc = 1)::int), 6) as share from z where auroc is not null group by 1, 2")
def _(s, d):
    return _auroc(s, d).where("auroc is not null").groupBy("tool", "guides").agg(M.r6(F.avg((F.col("auroc") == 1).cast("int"))).alias("share"))


@query("a13_value_matrix", AUROC + """, v as (select unnest([0, 0.25, 0.5, 0.75, 1.0]) as value), k as (select distinct tool from z), c as (select tool, round(auroc, 6) as value, count(*) as n from z where guides = 4 and auroc is not null group by 1, 2),
s as (select tool, count(*) as total from z where guides = 4 and auroc is not null group by 1)
select k.tool, v.value::double as value, coalesce(c.n, 0)::bigint as n, round(coalesce(c.n, 0) * 100 / s.total, 6) as percent, round(sqrt(coalesce(c.n, 0) * 100 / s.total * (100 - coalesce(c.n, 0) * 100 / s.total) / s.total), 6) as standard_error
from k, v left join c on c.tool = k.tool and c.value = v.value left join s on s.tool = k.tool""")
def _(s, d):
    z = _auroc(s, d).where("guides = 4 and auroc is not null").select("tool", M.r6("auroc").alias("value"))
    legal = s.createDataFrame([(x / 4,) for x in range(5)], "value double")
    counted = z.groupBy("tool", "value").agg(F.count(F.lit(1)).alias("n"))
    total = z.groupBy("tool").agg(F.count(F.lit(1)).alias("total"))
    p = F.col("n") * 100 / F.col("total")
    grid = total.crossJoin(F.broadcast(legal)).join(counted, ["tool", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.select("tool", "value", "n", M.r6(p).alias("percent"), M.r6(F.sqrt(p * (100 - p) / F.col("total"))).alias("standard_error"))


@query("j13_group_size", AUROC + " select tool, gene, guides, count(*) over (partition by tool, guides)::bigint as genes_alike from z")
def _(s, d):
    return _auroc(s, d).select("tool", "gene", "guides", F.count(F.lit(1)).over(W.Window.partitionBy("tool", "guides")).alias("genes_alike"))


@query("e20_integrity", B + " select gene, count(*)::bigint as guides, count(*) filter (bucket = 'good')::bigint as good from c group by gene having count(*) not in (2, 4, 6) or count(*) filter (bucket = 'good') * 2 <> count(*)")
def _(s, d):
    return g.integrity_offenders(_c(s, d))


DETECT = SMALL + ", x as (select tool, gene, efficacy < 60 as bad, row_number() over (partition by tool, gene order by score nulls first, guide_id) as k from l4), c as (select tool, count(*) as n, count(*) filter (bad) as f from x where k = 1 group by tool)"


@query("e21_bad_guide_detection", DETECT + """ select tool, n::bigint as genes, f::bigint as found, round(f / n, 6) as rate, round((f / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(f / n * (1 - f / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
 round((f / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(f / n * (1 - f / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high, round(sqrt(f / n * (1 - f / n) / n), 6) as standard_error from c""")
def _(s, d):
    r = g.bad_guide_detection(_l4(s, d), bad())
    return r.select("tool", "genes", "found", *[M.r6(c).alias(c) for c in ("rate", "low", "high", "standard_error")])


@query("e22_guides_per_gene", "with " + t.GUIDES + " select guides, count(*)::bigint as genes from (select count(*)::bigint as guides from guides group by gene) group by guides")
def _(s, d):
    return g.guides_per_gene(t.guides(s, d))


@query("e23_two_proportions", DETECT + """ select a.tool as tool_a, b.tool as tool_b, round((a.f / a.n - b.f / b.n) / sqrt((a.f + b.f) / (a.n + b.n) * (1 - (a.f + b.f) / (a.n + b.n)) * (1 / a.n + 1 / b.n)), 6) as z,
 case when z > 3.290527 then '***' when z > 2.575829 then '**' when z > 1.959964 then '*' else 'ns' end as stars from c a join c b on a.f / a.n > b.f / b.n or (a.f / a.n = b.f / b.n and a.tool < b.tool)""")
def _(s, d):
    return g.two_proportions(g.bad_guide_detection(_l4(s, d), bad())).withColumn("z", M.r6("z"))
