"""Queries for the evaluation metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievework.operators import columns as C
from sievework.operators import metrics as M
from sievework.plans import tables as t
from sievework.plans.registry import query

L = "with " + t.LONG
def good():
    return F.col("efficacy") >= 90

def kind():
    return C.three_classes(F.col("efficacy"))

KIND_SQL = "case when efficacy < 60 then 'Poor' when efficacy >= 90 then 'Good' when efficacy is not null then 'Moderate' end"
TOTALS = f", totals as (select count(*) filter (k = 'Good') as g, count(*) filter (k = 'Moderate') as m, count(*) filter (k = 'Poor') as p from (select {KIND_SQL} as k from guides))"


def _auc_sql(where: str) -> str:
    return f"""r as (select tool, {where} as pos, rank() over (partition by tool order by score) + (count(*) over (partition by tool, score) - 1) / 2.0 as rk from long where score is not null),
a as (select tool, sum(case when pos then rk end) as s, count(*) filter (pos) as p, count(*) filter (not pos) as n from r group by tool)"""


ROC = L + """, s as (select tool, score, count(*) filter (efficacy >= 90) as p, count(*) filter (not efficacy >= 90) as n from long where score is not null group by 1, 2),
c as (select *, sum(p) over w as cp, sum(n) over w as cn, sum(p) over (partition by tool) as ap, sum(n) over (partition by tool) as an from s window w as (partition by tool order by score desc))"""


@query("e01_roc_points", ROC + " select tool, round(score, 6) as threshold, round(cp / ap, 6) as tpr, round(cn / an, 6) as fpr from c")
def _(s, d):
    return M.roc_points(t.long_guides(s, d), good()).select("tool", *[M.r6(c).alias(c) for c in ("threshold", "tpr", "fpr")])


@query("e02_auc", L + ", " + _auc_sql("efficacy >= 90") + " select tool, round((s - p * (p + 1) / 2.0) / (p * n), 6) as auc, p::bigint as pos, n::bigint as neg from a")
def e02_auc(s, d):
    return M.auc(t.long_guides(s, d), good()).select("tool", M.r6("auc").alias("auc"), "pos", "neg")


@query("e02_auc_binary", "with " + t.BINARY + ", x as (select 'n_chars' as tool, score, label from binary_labels), " + _auc_sql("label = 1").replace("from long", "from x") + " select tool, round((s - p * (p + 1) / 2.0) / (p * n), 6) as auc, p::bigint as pos, n::bigint as neg from a")
def _(s, d):
    x = t.binary_labels(s, d).withColumn("tool", F.lit("n_chars"))
    return M.auc(x, F.col("label") == 1).select("tool", M.r6("auc").alias("auc"), "pos", "neg")


@query("e03_auc_by_cutoff", L + ", l2 as (select tool || '@' || c::integer::varchar as tool, score, efficacy, c from long, (values (60.0), (90.0)) v(c)), " + _auc_sql("efficacy >= c").replace("from long", "from l2")
       + " select split_part(tool, '@', 1) as tool, split_part(tool, '@', 2)::double as cutoff, round((s - p * (p + 1) / 2.0) / (p * n), 6) as auc, p::bigint as pos, n::bigint as neg from a")
def _(s, d):
    x = M.at_cutoffs(t.long_guides(s, d), [60, 90])
    return M.auc(x, F.col("good"), ("tool", "cutoff")).select("tool", "cutoff", M.r6("auc").alias("auc"), "pos", "neg")


@query("e04_average_precision", ROC + " select tool, round(sum(p / ap * cp / (cp + cn)), 6) as average_precision from c group by tool")
def _(s, d):
    return M.average_precision(t.long_guides(s, d), good()).select("tool", M.r6("average_precision").alias("average_precision"))


def _sweep(n: int) -> str:
    return L + TOTALS + f""", e as (select tool, min(score) as low, max(score) as high from long group by tool),
g as (select tool, i, case when i = {n - 1} then high else low + i * (high - low) / {n - 1} end as threshold from e, range({n}) r(i)),
d as (select tool, score, {KIND_SQL} as k, count(*) as n from long where score is not null group by 1, 2, 3),
c as (select g.tool, g.i, g.threshold, coalesce(sum(n) filter (k = 'Good'), 0)::double as cg, coalesce(sum(n) filter (k = 'Moderate'), 0)::double as cm, coalesce(sum(n) filter (k = 'Poor'), 0)::double as cp
      from g join d on d.tool = g.tool and d.score >= g.threshold group by 1, 2, 3),
r as (select tool, i, threshold, cg as tp, totals.g - cg as fn, cm + cp as fp, totals.m + totals.p - cm - cp as tn from c, totals),
q as (select *, tp / (tp + fn) as tpr, tn / (tn + fp) as specificity from r)"""


RATES = ", ".join(f"{c}::bigint as {c}" for c in ("tp", "fn", "fp", "tn")) + ", round(tpr, 6) as tpr, round(specificity, 6) as specificity, round(tpr + specificity - 1, 6) as youden, round(case when fp = 0 then 'inf'::double else tpr / (1 - specificity) end, 6) as lr_plus"


def _rates(df, *more):
    return df.select("tool", *more, M.r6("threshold").alias("threshold"), *[F.col(c).cast("long").alias(c) for c in ("tp", "fn", "fp", "tn")], *[M.r6(c).alias(c) for c in ("tpr", "specificity", "youden", "lr_plus")])


@query("e05_best_threshold", _sweep(500) + f""", b as (select *, row_number() over (partition by tool order by least(tpr, specificity) desc, i) as k from q),
v as (select tool, threshold, 'good_vs_rest' as comparison, cg as tp, totals.g - cg as fn, cm + cp as fp, totals.m + totals.p - cm - cp as tn from b join c using (tool, i, threshold), totals where k = 1
 union all select tool, threshold, 'not_poor_vs_poor', cg + cm, totals.g + totals.m - cg - cm, cp, totals.p - cp from b join c using (tool, i, threshold), totals where k = 1),
o as (select *, tp / (tp + fn) as tpr, tn / (tn + fp) as specificity from v) select tool, comparison, round(threshold, 6) as threshold, {RATES} from o""")
def _(s, d):
    totals = M.class_totals(t.guides(s, d), kind())
    both = M.both_comparisons(M.best_threshold(t.long_guides(s, d), kind(), totals), totals)
    return _rates(both, "comparison")


PRESET = (("tool_price", 40000.0), ("tool_disc", 0.05), ("tool_tax", 0.04))
PRESET_SQL = "preset(tool, threshold) as (values " + ", ".join(f"('{a}', {b}::double)" for a, b in PRESET) + ")"


def _preset(s):
    return s.createDataFrame(PRESET, "tool string, threshold double")


def _preset_sql(good: str) -> str:
    return L + ", " + PRESET_SQL + f""", x as (select l.tool, threshold, {KIND_SQL} as k, l.score >= threshold as hit from long l join preset using (tool)),
a as (select count(*) filter (k in ({good})) as pos, count(*) filter (k not in ({good})) as neg from (select {KIND_SQL} as k from guides)),
r as (select tool, threshold, count(*) filter (hit and k in ({good}))::double as tp, count(*) filter (hit and k not in ({good}))::double as fp from x group by 1, 2),
f as (select tool, threshold, tp, pos - tp as fn, fp, neg - fp as tn, tp / pos as tpr, (neg - fp) / neg as specificity from r, a)"""


@query("e06_preset_thresholds", _preset_sql("'Good'") + f" select tool, round(threshold, 6) as threshold, {RATES} from f")
def _(s, d):
    return _rates(M.at_thresholds(t.long_guides(s, d), _preset(s), kind(), M.class_totals(t.guides(s, d), kind())))


@query("e07_lr_report", _preset_sql("'Good'").replace("), f as", "), f as") + ", two as (select tool, 'good_vs_rest' as comparison, tpr / (1 - specificity) as lr_plus from f) select tool, comparison, round(lr_plus, 6) as lr_plus from two union all select * from ("
       + _preset_sql("'Good', 'Moderate'") + " select tool, 'not_poor_vs_poor' as comparison, round(tpr / (1 - specificity), 6) as lr_plus from f)")
def _(s, d):
    l, p, n = t.long_guides(s, d), _preset(s), M.class_totals(t.guides(s, d), kind())
    a = M.at_thresholds(l, p, kind(), n).select("tool", F.lit("good_vs_rest").alias("comparison"), M.r6("lr_plus").alias("lr_plus"))
    return a.unionByName(M.at_thresholds(l, p, kind(), n, ("Good", "Moderate")).select("tool", F.lit("not_poor_vs_poor").alias("comparison"), M.r6("lr_plus").alias("lr_plus")))


@query("e08_misclassification", _preset_sql("'Good'") + ", w as (select tool, count(*) filter (hit and k = 'Poor')::double as bp, count(*) filter (hit and k = 'Moderate')::double as bm from x group by 1), n as (select count(*) filter (k = 'Poor') as p, count(*) filter (k = 'Moderate') as m from (select "
       + KIND_SQL + " as k from guides)) select tool, round(tpr, 6) as coverage, round(bp / n.p, 6) as poor_as_good, round(bm / n.m, 6) as moderate_as_good, round(tpr - bp / n.p, 6) as quality from f join w using (tool), n")
def _(s, d):
    r = M.at_thresholds(t.long_guides(s, d), _preset(s), kind(), M.class_totals(t.guides(s, d), kind()))
    poor, moderate = F.col("Poor") / F.col("all_Poor"), F.col("Moderate") / F.col("all_Moderate")
    return r.select("tool", M.r6("tpr").alias("coverage"), M.r6(poor).alias("poor_as_good"), M.r6(moderate).alias("moderate_as_good"), M.r6(F.col("tpr") - poor).alias("quality"))


@query("e09_confusion", "with " + t.GUIDES + """, e as (select min(tool_price) as low, max(tool_price) as high from guides),
x as (select case when efficacy <= 60 then 'Poor' when efficacy <= 90 then 'Moderate' else 'Good' end as true_class, (tool_price - low) / (high - low) * 100 as v from guides, e),
y as (select true_class, case when v <= 60 then 'Poor' when v <= 90 then 'Moderate' else 'Good' end as predicted, count(*)::bigint as n from x group by 1, 2)
select 'tool_price' as tool, true_class, predicted, n, round(n * 100.0 / sum(n) over (partition by true_class), 6) as percent from y""")
def _(s, d):
    x = C.min_max_100(t.guides(s, d), "tool_price", "v").withColumn("tool", F.lit("tool_price"))
    c = M.confusion(x, C.three_bins(F.col("efficacy")), C.three_bins(F.col("v")))
    return c.select("tool", "true_class", "predicted", "n", M.r6("percent").alias("percent"))


@query("e10_pearson", L + " select tool, round(corr(score, efficacy), 6) as pearson, count(*)::bigint as n from long where score is not null group by tool")
def _(s, d):
    return M.pearson(t.long_guides(s, d)).select("tool", M.r6("pearson").alias("pearson"), "n")


RANKS = """, r as (select tool, rank() over (partition by tool order by score) + (count(*) over (partition by tool, score) - 1) / 2.0 as x,
 rank() over (partition by tool order by efficacy) + (count(*) over (partition by tool, efficacy) - 1) / 2.0 as y from long where score is not null)"""


@query("e11_spearman", L + RANKS + " select tool, round(corr(x, y), 6) as spearman, count(*)::bigint as n from r group by tool")
def _(s, d):
    return M.spearman(t.long_guides(s, d)).select("tool", M.r6("spearman").alias("spearman"), "n")


@query("e11_spearman_p")
def _(s, d):
    """Spearman with its two-sided p value by Student's t."""
    return M.spearman_p(M.spearman(t.long_guides(s, d))).select("tool", "n", M.r6("spearman").alias("spearman"), M.r6("p").alias("p"))


@query("e12_kendall", "with " + t.BINARY + """, p as (select sign(a.score - b.score) * sign(a.label - b.label) as s, a.score = b.score as tx, a.label = b.label as ty from binary_labels a join binary_labels b on a.doc_id < b.doc_id)
select round(sum(s) / sqrt(count(*) filter (not tx)::double * count(*) filter (not ty)), 6) as tau_b, (select count(*) from binary_labels)::bigint as n from p""")
def _(s, d):
    return M.kendall(t.binary_labels(s, d), "score", "label").select(M.r6("tau_b").alias("tau_b"), "n")


@query("e13_tool_correlations", "with " + t.GUIDES + ", w as (" + " union all ".join(f"select '{a}' as tool_a, '{b}' as tool_b, {a} as x, {b} as y from guides where {a} is not null and {b} is not null" for a in t.TOOLS for b in t.TOOLS if a != b) + """),
k as (select tool_a, tool_b, x, y, rank() over (partition by tool_a, tool_b order by x) + (count(*) over (partition by tool_a, tool_b, x) - 1) / 2.0 as rx, rank() over (partition by tool_a, tool_b order by y) + (count(*) over (partition by tool_a, tool_b, y) - 1) / 2.0 as ry from w)
select tool_a, tool_b, count(*)::bigint as n, round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman from k group by 1, 2""")
def _(s, d):
    return M.tool_correlations(t.guides(s, d), t.TOOLS).withColumns({"pearson": M.r6("pearson"), "spearman": M.r6("spearman")})


@query("e14_best_f1", _sweep(100) + RANKS.replace("r as (", "ranks as (") + """, sp as (select tool, round(corr(x, y), 6) as spearman from ranks group by tool), """ + _auc_sql("efficacy >= 90").replace("r as (", "ra as (").replace("from r ", "from ra ") + """, f as (select *, tp / (tp + fp) as precision, tpr as recall, coalesce(2 * tp / (2 * tp + fp + fn), 0) as f1 from q),
best as (select *, row_number() over (partition by tool order by round(f1, 12) desc, i) as k from f) select tool, round(threshold, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round((s - p * (p + 1) / 2.0) / (p * n), 6) as auc, spearman from best join a using (tool) join sp using (tool) where k = 1""")
def _(s, d):
    l = t.long_guides(s, d)
    best = M.best_f1(l, kind(), M.class_totals(t.guides(s, d), kind())).join(M.auc(l, good()).select("tool", "auc"), "tool").join(M.spearman(l).drop("n"), "tool")
    return best.select("tool", *[M.r6(c).alias(c) for c in ("threshold", "precision", "recall", "f1", "auc", "spearman")])


@query("e15_poor_detection", L + """, x as (select tool, score, efficacy < 60 as poor from long where score is not null),
o as (select tool, score, row_number() over (partition by tool order by score) - 1 as i, avg(poor::int) over (partition by tool) * (count(*) over (partition by tool) - 1) as place from x),
th as (select tool, max(score) filter (i = floor(place)) + (max(score) filter (i = ceil(place)) - max(score) filter (i = floor(place))) * (max(place) - floor(max(place))) as threshold from o group by tool),
c as (select tool, threshold, count(*)::double as n, count(*) filter (poor)::double as pos, count(*) filter (score <= threshold + 1e-12)::double as called, count(*) filter (poor and score <= threshold + 1e-12)::double as tp from x join th using (tool) group by 1, 2)
select tool, round(threshold, 6) as threshold, round(tp / called, 6) as precision, round(tp / pos, 6) as recall, round(2 * tp / (called + pos), 6) as f1, round((n - called - pos + 2 * tp) / n, 6) as accuracy from c""")
def _(s, d):
    return M.poor_detection(t.long_guides(s, d), F.col("efficacy") < 60).select("tool", *[M.r6(c).alias(c) for c in ("threshold", "precision", "recall", "f1", "accuracy")])


THREE = "case when {v} <= 60 then 'Poor' when {v} <= 90 then 'Moderate' else 'Good' end"


#: Kendall's pairs are counted in SQL over the distinct scores and the few distinct efficacies.
@query("e18_dashboard", L + RANKS + """, sp as (select tool, corr(x, y) as spearman, count(*) as n from r group by tool),
cl as (select tool, score, efficacy as e, count(*) as n from long where score is not null group by 1, 2, 3), ef as (select distinct e from cl),
gr as (select x.tool, x.score, ef.e, coalesce(cl.n, 0) as n from (select distinct tool, score from cl) x cross join ef left join cl on cl.tool = x.tool and cl.score = x.score and cl.e = ef.e),
cu as (select *, sum(n) over (partition by tool, e order by score) - n as below, sum(n) over (partition by tool, e) as level from gr),
lo as (select *, sum(below) over (partition by tool, score order by e) - below as lower, sum(level - below - n) over (partition by tool, score order by e) - (level - below - n) as upper from cu),
ke as (select tool, sum(n * lower)::double as c, sum(n * upper)::double as d from lo group by 1),
tx as (select tool, sum(m::double * (m - 1) / 2) as tx from (select tool, score, sum(n) as m from cl group by 1, 2) group by 1), ty as (select tool, sum(m::double * (m - 1) / 2) as ty from (select tool, e, sum(n) as m from cl group by 1, 2) group by 1),
ra as (select tool, min(score) as low, max(score) as high from long group by 1),
ca as (select tool, avg((""" + THREE.format(v="efficacy") + " = " + THREE.format(v="(score - low) / (high - low) * 100") + """)::int) as agreement from long join ra using (tool) where score is not null group by 1),
px as (select tool, score, efficacy < 60 as poor from long where score is not null),
po as (select tool, score, row_number() over (partition by tool order by score) - 1 as i, avg(poor::int) over (partition by tool) * (count(*) over (partition by tool) - 1) as place from px),
th as (select tool, max(score) filter (i = floor(place)) + (max(score) filter (i = ceil(place)) - max(score) filter (i = floor(place))) * (max(place) - floor(max(place))) as threshold from po group by tool),
pf as (select tool, 2 * count(*) filter (poor and score <= threshold + 1e-12)::double / (count(*) filter (poor) + count(*) filter (score <= threshold + 1e-12)) as poor_f1 from px join th using (tool) group by 1),
ev as (select tool, gene, first(guide_id order by score desc, guide_id) as a, first(guide_id order by efficacy desc, guide_id) as b, count(*) as n from long where score is not null and efficacy is not null group by 1, 2),
ta as (select tool, avg((a = b)::int) as top_accuracy from ev where n > 1 group by 1)
select tool, round(spearman, 6) as spearman, round((c - d) / sqrt((sp.n::double * (sp.n - 1) / 2 - tx) * (sp.n::double * (sp.n - 1) / 2 - ty)), 6) as kendall, round(agreement, 6) as category_agreement, round(poor_f1, 6) as poor_f1, round(top_accuracy, 6) as top_accuracy
from sp join ke using (tool) join tx using (tool) join ty using (tool) join ca using (tool) join pf using (tool) join ta using (tool)""")
def _(s, d):
    from sievework.operators import genes as g

    l = t.long_guides(s, d)
    low_high = l.groupBy("tool").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = l.where("score is not null").join(F.broadcast(low_high), "tool").withColumn("v", (F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) * 100)
    agree = scaled.groupBy("tool").agg(F.avg((C.three_bins(F.col("efficacy")) == C.three_bins(F.col("v"))).cast("int")).alias("category_agreement"))
    taus = [M.kendall(l.where(F.col("tool") == tool), "score", "efficacy").select(F.lit(tool).alias("tool"), F.col("tau_b").alias("kendall")) for tool in t.TOOLS]
    tau = taus[0].unionByName(taus[1]).unionByName(taus[2])
    poor = M.poor_detection(l, F.col("efficacy") < 60).select("tool", F.col("f1").alias("poor_f1"))
    top = g.within_gene_ranking(t.long_guides(s, d, together="gene")).select("tool", F.col("top_agreement").alias("top_accuracy"))
    both = M.spearman(l).drop("n").join(tau, "tool").join(agree, "tool").join(poor, "tool").join(top, "tool")
    return both.select("tool", *[M.r6(c).alias(c) for c in ("spearman", "kendall", "category_agreement", "poor_f1", "top_accuracy")])


@query("e24_class_shares", "with " + t.GUIDES + f" select class, n, round(n * 100.0 / sum(n) over (), 6) as percent from (select {KIND_SQL} as class, count(*)::bigint as n from guides group by 1)")
def _(s, d):
    c = t.guides(s, d).groupBy(kind().alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("class", "n", M.r6(F.col("n") * 100 / F.sum("n").over(W.Window.partitionBy(F.lit(1)))).alias("percent"))


@query("e25_score_ranges", L + " select tool, round(min(score), 6) as low, round(max(score), 6) as high, count(score)::bigint as n from long group by tool")
def _(s, d):
    return t.long_guides(s, d).groupBy("tool").agg(M.r6(F.min("score")).alias("low"), M.r6(F.max("score")).alias("high"), F.count("score").alias("n"))


@query("e26_efficacy_distribution", "with " + t.GUIDES + f" select least(floor(efficacy / 2) * 2, 98)::double as bin, {KIND_SQL} as class, count(*)::bigint as n from guides group by 1, 2")
def _(s, d):
    return M.class_bins(t.guides(s, d)).select("bin", "class", "n")
