"""Scoring queries: gold labels against two rule predictors, and boxes derived from integer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import score
from .registry import query, table

#: The two predictors: words that an instruction may hold, in the order of priority.
ROUTER_SQL = """case when text is null or text = '' then 'clarify' when contains(lower(text), '%%%') or contains(lower(text), '!!') then 'reject'
  when contains(lower(text), ' | ') then 'fallback' else 'act' end"""


def routed(docs: DataFrame) -> DataFrame:
    t = F.lower("text")
    route = F.when(F.col("text").isNull() | (F.col("text") == ""), "clarify").when(t.contains("%%%") | t.contains("!!"), "reject").when(t.contains(" | "), "fallback").otherwise("act")
    return docs.withColumn("route", route)


@query(f"""
select doc_id, route, route in ('reject', 'fallback') as terminal, case route when 'act' then 'executed' when 'clarify' then 'asked' when 'reject' then 'refused' else 'fell_back' end as expected_result, route = 'reject' as requires_approval
from (select doc_id, {ROUTER_SQL} as route from documents)""")
def rule_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword router, then the decision that follows from the route."""
    r = F.col("route")
    result = F.when(r == "act", "executed").when(r == "clarify", "asked").when(r == "reject", "refused").otherwise("fell_back")
    return routed(table(spark, sf_dir, "documents")).select("doc_id", "route", r.isin("reject", "fallback").alias("terminal"), result.alias("expected_result"), (r == "reject").alias("requires_approval"))


SCORED_SQL = f"""
scored as (
  select l.doc_id, l.quality, l.toxic, case when route in ('reject', 'fallback') then 0 when route = 'act' then 1 end as p1, case when n_chars > 40 then 1 else 0 end as p2, d.lang
  from labels l join (select *, {ROUTER_SQL} as route from documents) d using (doc_id)
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = routed(table(spark, sf_dir, "documents")).select("doc_id", "lang", F.when(F.col("route").isin("reject", "fallback"), 0).when(F.col("route") == "act", 1).alias("p1"), F.when(F.col("n_chars") > 40, 1).otherwise(0).alias("p2"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


CONFUSION_SQL = f"""with {SCORED_SQL}, k(label) as (values (0), (1), (2)), c as (
  select label, count(*) filter (quality is not distinct from label and p1 is not distinct from label)::bigint as tp, count(*) filter (quality is distinct from label and p1 is not distinct from label)::bigint as fp,
    count(*) filter (quality is not distinct from label and p1 is distinct from label)::bigint as fn from k, scored group by label)"""


@query(CONFUSION_SQL + " select * from c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9's table; label 2 is absent."""
    return score.confusion(scored(spark, sf_dir), "quality", "p1", [0, 1, 2])


@query(CONFUSION_SQL + " select avg(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0)::double, 1.0::double)) as macro_f1 from c")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9."""
    return score.macro_f1(confusion(spark, sf_dir))


@query(f"""with {SCORED_SQL}, f as (
  select 'quality:' || quality as g, case when p1 is not null then 'quality:' || p1 end as p from scored union all select 'lang:' || lang, case when p1 is not null then 'lang:' || case when p2 = 1 then lang else 'en' end end from scored
), t as (select count(*) filter (g = p)::bigint as tp, count(*) filter (p is not null and g <> p)::bigint as fp, count(*) filter (p is null or g <> p)::bigint as fn from f),
r as (select *, coalesce(tp::double / nullif(tp + fp, 0)::double, 1.0) as precision, coalesce(tp::double / nullif(tp + fn, 0)::double, 1.0) as recall from t)
select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1 from r""")
def micro_field_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 over two fields; no prediction misses both."""
    pairs = lambda q, lang: F.create_map(F.lit("quality"), q.cast("string"), F.lit("lang"), lang)
    guess = F.when(F.col("p1").isNotNull(), pairs(F.col("p1"), F.when(F.col("p2") == 1, F.col("lang")).otherwise("en")))
    rows = scored(spark, sf_dir).select(pairs(F.col("quality"), F.col("lang")).alias("gold"), guess.alias("guess"))
    return score.field_f1(rows, "gold", "guess")


@query(f"""with {SCORED_SQL} select
  count(*) filter (p1 = quality)::bigint as accuracy_n, count(*)::bigint as accuracy_of, count(*) filter (p1 = quality)::double / nullif(count(*), 0)::double as accuracy,
  count(*) filter (quality = 0 and p1 = 0)::bigint as rejection_recall_n, count(*) filter (quality = 0)::bigint as rejection_recall_of, coalesce(count(*) filter (quality = 0 and p1 = 0)::double / nullif(count(*) filter (quality = 0), 0)::double, 1.0) as rejection_recall,
  count(*) filter (quality = 1 and p1 = 0)::bigint as false_refusal_n, count(*) filter (quality = 1)::bigint as false_refusal_of, coalesce(count(*) filter (quality = 1 and p1 = 0)::double / nullif(count(*) filter (quality = 1), 0)::double, 0.0) as false_refusal,
  count(*) filter (quality = 9 and p1 = 0)::bigint as absent_n, count(*) filter (quality = 9)::bigint as absent_of, count(*) filter (quality = 9 and p1 = 0)::double / nullif(count(*) filter (quality = 9), 0)::double as absent from scored""")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, each with its own default."""
    q, p, every = F.col("quality"), F.coalesce(F.col("p1"), F.lit(-1)), F.lit(True)
    return score.rates(scored(spark, sf_dir), accuracy=(p == q, every, None), rejection_recall=(p == 0, q == 0, 1.0), false_refusal=(p == 0, q == 1, 0.0), absent=(p == 0, q == 9, None))


@query(f"""with {SCORED_SQL}, e as (select doc_id, case when p1 is null then 'NO_PREDICTION' when toxic = 1 and p1 = 1 then 'DANGEROUS_ACTION' when quality = 1 and p1 = 0 then 'FALSE_REFUSAL' when quality = 0 and p1 = 1 then 'MISSED_REJECTION' end as code from scored)
select code, count(*)::bigint as n from e group by code""")
def semantic_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a prediction breaks, as a histogram."""
    p, q = F.col("p1"), F.col("quality")
    code = score.first_rule(("NO_PREDICTION", p.isNull()), ("DANGEROUS_ACTION", (F.col("toxic") == 1) & (p == 1)), ("FALSE_REFUSAL", (q == 1) & (p == 0)), ("MISSED_REJECTION", (q == 0) & (p == 1)))
    return scored(spark, sf_dir).groupBy(code.alias("code")).agg(F.count("*").alias("n"))


BOX_SQL = """boxes as (
  select l_orderkey, l_linenumber, (l_partkey % 40)::bigint as ax, (l_suppkey % 40)::bigint as ay, 20 + (l_quantity::bigint % 30) as aw, (l_partkey % 37)::bigint as bx, (l_suppkey % 41)::bigint as b_y, (l_linenumber * 9 - 8)::bigint as bw from lineitem
), f as (
  select l_orderkey, l_linenumber, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + aw, b_y + bw) - greatest(ay, b_y)) as shared, aw * aw + bw * bw as total from boxes
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda name, m: (F.col(name) % m).cast("long")
    box = lambda x, y, w: F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2"))
    a = box(c("l_partkey", 40), c("l_suppkey", 40), 20 + F.col("l_quantity").cast("long") % 30)
    b = box(c("l_partkey", 37), c("l_suppkey", 41), (F.col("l_linenumber") * 9 - 8).cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.iou(a, b).alias("iou"))


@query(f"with {BOX_SQL} select l_orderkey, l_linenumber, shared::bigint as shared, (total - shared)::bigint as union_area, round(shared::double / (total - shared)::double, 12) as iou from f")
def grounding_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I10."""
    return boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("iou.shared").alias("shared"), F.col("iou.union").alias("union_area"), F.round(F.col("iou.shared").cast("double") / F.col("iou.union").cast("double"), 12).alias("iou"))


@query(f"""with {BOX_SQL}, s as (select l_orderkey, l_linenumber, shared, total - shared as u, (shared::decimal(20,0) * 1000000000000000000::decimal(19,0) / (total - shared)) as q from f),
e as (select *, (shared::hugeint * 1000000000000000000 * 1000000 * 2 + u) // (2 * u) as score from s),
t as (select l_orderkey, l_linenumber, shared, u, score from e qualify score = max(score) over (partition by l_orderkey))
select l_orderkey, case when count(*) = 1 and bool_and(2 * shared >= u) then min(l_linenumber) end as best, count(*)::bigint as ties from t group by l_orderkey""")
def unique_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.G: the one best box of an order, if it covers half."""
    rows = boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("iou.shared").alias("shared"), F.col("iou.union").alias("u"))
    return score.unique_best(rows, "l_orderkey", "l_linenumber", "shared", "u")


@query(f"""with {BOX_SQL} select l_linenumber as mode, count(*)::bigint as cases, count(*) filter (2 * shared >= total - shared)::bigint as grounded_n, round(sum(round(shared::double / (total - shared)::double, 9)::decimal(18,9))::double / count(*), 6) as mean_iou,
  count(*) filter (shared = 0)::bigint as missed from f group by l_linenumber""")
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional ratios and a mean of exact fractions, summed as decimals."""
    s, u = F.col("iou.shared"), F.col("iou.union")
    return boxes(spark, sf_dir).groupBy(F.col("l_linenumber").alias("mode")).agg(F.count("*").alias("cases"), F.count_if(2 * s >= u).alias("grounded_n"), F.round(F.sum(F.round(s.cast("double") / u.cast("double"), 9).cast("decimal(18,9)")).cast("double") / F.count("*"), 6).alias("mean_iou"), F.count_if(s == 0).alias("missed"))


@query(f"""with {SCORED_SQL}, c as (
  select doc_id, 'accepted' as dimension, coalesce(p1 = quality, false) as r, coalesce(p2 = quality, false) as c from scored union all select doc_id, 'safe', coalesce(not (toxic = 1 and p1 = 1), false), coalesce(not (toxic = 1 and p2 = 1), false) from scored)
select doc_id, dimension, case when r then 'regression' else 'improvement' end as event from c where r <> c""")
def regression_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate against a reference predictor, by record and dimension."""
    q = F.col("quality")
    safe = lambda p: ~((F.col("toxic") == 1) & (F.col(p) == 1))
    return score.events_of_change(scored(spark, sf_dir), "doc_id", {"accepted": (F.col("p1") == q, F.col("p2") == q), "safe": (safe("p1"), safe("p2"))})


@query(f"""with {SCORED_SQL}, m as (
  select lang as metric, count(*) filter (p1 = quality)::double / count(*)::double as before, count(*) filter (p2 = quality)::double / count(*)::double as after from scored group by lang union all select 'none', null, 1.0)
select metric, before, after, after - before as delta, case when after - before is null then 'not_applicable' when after > before then 'improved' when after < before then 'regressed' else 'equal' end as class from m""")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E27, E38."""
    q, n = F.col("quality"), F.count("*").cast("double")
    m = scored(spark, sf_dir).groupBy(F.col("lang").alias("metric")).agg((F.count_if(F.col("p1") == q).cast("double") / n).alias("before"), (F.count_if(F.col("p2") == q).cast("double") / n).alias("after"))
    none = spark.range(1).select(F.lit("none").alias("metric"), F.lit(None).cast("double").alias("before"), F.lit(1.0).alias("after"))
    return score.metric_deltas(m.unionByName(none), "before", "after")


CLASSES_SQL = f"""with {SCORED_SQL}, e as (select doc_id, case when p1 = quality then 'exact' when quality = 0 and p1 = 1 then 'reject_to_act' when quality = 1 and p1 = 0 then 'act_to_reject' else 'unclassified' end as class from scored)"""


@query(f"{CLASSES_SQL} select * from e")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered CASE over gold and prediction, a row for each record."""
    from ..operators.gates import classified

    p, q = F.col("p1"), F.col("quality")
    kind = F.when(p == q, "exact").when((q == 0) & (p == 1), "reject_to_act").when((q == 1) & (p == 0), "act_to_reject").otherwise("unclassified")
    return classified(scored(spark, sf_dir), kind, "doc_id")


@query(f'{CLASSES_SQL} select class, count(*)::bigint as n, min(doc_id) as "first" from e group by class')
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each class, and the first of them."""
    from ..operators.gates import taxonomy

    return taxonomy(failure_classes(spark, sf_dir), "doc_id")
