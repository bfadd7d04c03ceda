"""Trace, reference and window queries: a run is a user's events in the order of (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces
from .registry import query, table

KINDS = ["click", "error", "purchase", "signup", "view"]
KIND_COUNTS_SQL = ", ".join(f"count(*) filter (event_type = '{k}')::bigint as n_{k}" for k in KINDS)


@query(f"select user_id, {KIND_COUNTS_SQL} from events group by user_id")
def run_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1."""
    return traces.kind_counts(table(spark, sf_dir, "events"), "user_id", "event_type", KINDS)


@query("""
with r as (select user_id, coalesce(bool_or(event_type = 'error'), false) as failed, coalesce(bool_or(event_type = 'purchase' and value > 90), false) as over_limit, coalesce(bool_or(event_type = 'signup'), false) as registered, max_by(event_type, (ts, event_id)) as phase from events group by user_id)
select user_id, failed, over_limit, registered, case phase when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'started' else 'open' end as outcome,
  list_filter([case when failed then 'failed' end, case when over_limit then 'over_limit' end, case when not registered then 'anonymous' end], lambda x: x is not null) as tags from r""")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups, outcome class of the last event, and tags in fixed order."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    runs = e.groupBy("user_id").agg(traces.any_of(kind == "error").alias("failed"), traces.any_of((kind == "purchase") & (F.col("value") > 90)).alias("over_limit"), traces.any_of(kind == "signup").alias("registered"), F.max_by("event_type", F.struct("ts", "event_id")).alias("phase"))
    outcome = F.when(F.col("phase") == "purchase", "completed").when(F.col("phase") == "error", "failed").when(F.col("phase") == "signup", "started").otherwise("open")
    return runs.select("user_id", "failed", "over_limit", "registered", outcome.alias("outcome"), traces.tags(failed=F.col("failed"), over_limit=F.col("over_limit"), anonymous=~F.col("registered")).alias("tags"))


@query("select user_id, count(*) filter (event_type = 'error')::bigint as n, sha256(coalesce(string_agg(event_id::varchar, ',' order by ts, event_id) filter (event_type = 'error'), '')) as errors, sha256(string_agg(event_type, ',' order by ts, event_id)) as kinds from events group by user_id")
def run_tool_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered lists of a run, as digests."""
    order = ["ts", "event_id"]
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(traces.ordered("event_id", order=order, where=F.col("event_type") == "error").alias("e"), traces.ordered("event_type", order=order).alias("k"))
    join = lambda c, f: F.sha2(F.array_join(F.transform(c, lambda x: x[f].cast("string")), ","), 256)
    return runs.select("user_id", F.size("e").cast("long").alias("n"), join("e", "event_id").alias("errors"), join("k", "event_type").alias("kinds"))


BUDGETS = {"steps": ("events", 70), "errors": ("errors", 12), "purchases": ("purchases", 15), "views": ("views", 0)}


@query("""
with r as (select user_id, count(*) as events, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase') as purchases, count(*) filter (event_type = 'view') as views from events group by user_id)
select user_id, dimension, used::bigint as used, cap::bigint as cap, cap > 0 and used >= cap as hit
from r, lateral (values ('steps', events, 70), ('errors', errors, 12), ('purchases', purchases, 15), ('views', views, 0)) b(dimension, used, cap)""")
def budget_limit_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four budgets of a run."""
    kind = F.col("event_type")
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), *(F.count_if(kind == k).alias(f"{k}s") for k in ("error", "purchase", "view")))
    cells = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("used"), F.lit(cap).cast("long").alias("cap")) for d, (c, cap) in BUDGETS.items()))
    return r.select("user_id", F.inline(cells)).withColumn("hit", traces.limit_hit("used", "cap"))


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::bigint as expected from conversations where turn <> 1 or length(text) % 5 <> 0 qualify expected <> turn")
def sequence_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of some conversations the second turn is missing."""
    kept = table(spark, sf_dir, "conversations").where((F.col("turn") != 1) | (F.length("text") % 5 != 0))
    return traces.sequence_gaps(kept.select("conv_id", "turn"), "conv_id", "turn", first=0)


@query("select * from (select conv_id, arg_min(role, turn) as first_role from conversations where turn <> 0 or length(text) % 7 <> 0 group by conv_id) where first_role not in ('system', 'user')")
def first_event_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations whose first turn is of the wrong kind, as some have lost theirs."""
    first = table(spark, sf_dir, "conversations").where((F.col("turn") != 0) | (F.length("text") % 7 != 0)).groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))
    return first.where(~F.col("first_role").isin("system", "user"))


@query("""
select block, doc_id, start, expected_start from (
  select block, doc_id, start, coalesce(lag(start + size) over (partition by block order by start), 0)::bigint as expected_start
  from (select doc_id // 50 as block, doc_id, (doc_id % 50) * 10 as start, case when doc_id % 11 = 0 then 9 else 10 end::bigint as size from documents)
) where start <> expected_start""")
def range_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fifty byte ranges a block, one in eleven a byte short."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.floor(i / 50).cast("long").alias("block"), "doc_id", (i % 50 * 10).alias("start"), F.when(i % 11 == 0, 9).otherwise(10).cast("long").alias("size"))
    return traces.range_gaps(rows, "block", "start", "size").select("block", "doc_id", "start", "expected_start")


@query("""
select o_orderkey, o_custkey, case when c_custkey is null then 'UNKNOWN_ARTIFACT_REF' else 'ARTIFACT_ROLE_MISMATCH' end as issue
from (select o_orderkey, o_custkey + case when o_orderkey % 97 = 0 then 1000000 else 0 end as o_custkey from orders) o left join customer on o_custkey = c_custkey where c_custkey is null or c_mktsegment <> 'BUILDING'""")
def fk_role_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customers, which are to be of one segment."""
    edges = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 97 == 0, 1000000).otherwise(0)).alias("o_custkey"), F.lit("BUILDING").alias("expected"))
    return traces.reference_issues(edges, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c_mktsegment", "expected").select("o_orderkey", "o_custkey", "issue")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no urgent order names."""
    return traces.orphans(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")


@query("""
with e as (select doc_id, sha256(source) as sha from documents), d as (select doc_id, case when doc_id % 50 = 0 then sha256('') else sha256(source) end as sha from documents where doc_id % 77 <> 0)
select doc_id, sha, 'missing' as issue from (select * from e except select * from d) union all select doc_id, sha, 'unexpected' from (select * from d except select * from e)""")
def deletion_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a receipt leaves out or adds."""
    docs = table(spark, sf_dir, "documents")
    episode = docs.select("doc_id", F.sha2("source", 256).alias("sha"))
    receipt = docs.where("doc_id % 77 <> 0").select("doc_id", F.when(F.col("doc_id") % 50 == 0, F.sha2(F.lit(""), 256)).otherwise(F.sha2("source", 256)).alias("sha"))
    return traces.set_difference(episode, receipt, ["doc_id", "sha"])


@query("""
select l_orderkey, l_linenumber, case when l_shipdate < o_orderdate then 'l_shipdate before o_orderdate' else 'late_by before l_shipdate' end as issue
from (select *, o_orderdate + interval 90 days as late_by from lineitem join orders on l_orderkey = o_orderkey) where l_shipdate < o_orderdate or late_by < l_shipdate""")
def temporal_window_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped after the order and within 90 days."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = joined.withColumn("late_by", F.expr("o_orderdate + interval 90 days"))
    return traces.outside_window(rows, ["o_orderdate", "l_shipdate", "late_by"]).select("l_orderkey", "l_linenumber", "issue")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where (o_orderstatus, o_orderpriority) not in (('F', '1-URGENT'), ('F', '2-HIGH'), ('O', '1-URGENT'), ('O', '3-MEDIUM'), ('P', '5-LOW'))")
def state_machine_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C19."""
    allowed = spark.createDataFrame([("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "1-URGENT"), ("O", "3-MEDIUM"), ("P", "5-LOW")], "o_orderstatus string, o_orderpriority string")
    return traces.illegal_states(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), allowed, ["o_orderstatus", "o_orderpriority"])


@query("select l_orderkey, sum(l_quantity)::double as total, sum(l_quantity) > 200 as over from lineitem group by l_orderkey")
def sum_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21."""
    total = F.sum("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(total.cast("double").alias("total"), (total > 200).alias("over"))


@query("select event_type as mode, count(*)::bigint as cases, count(*) filter (value > 50)::bigint as correct, round(sum(value::decimal(18,4))::double, 4) as total, round(min(value), 6) as least, round(max(value), 6) as most from events group by event_type")
def mode_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and a latency summary by mode; sums are decimal, so their order doesn't show."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("cases"), F.count_if(v > 50).alias("correct"), F.round(F.sum(v.cast("decimal(18,4)")).cast("double"), 4).alias("total"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"))


@query("select lang, min(n)::bigint as least, max(n)::bigint as most, round(sum(n)::double / count(*), 6) as mean, count(*) filter (n > 512)::bigint as truncated from (select lang, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as n from documents) group by lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18."""
    from ..functions.text import tokens

    n = table(spark, sf_dir, "documents").select("lang", F.size(tokens(F.col("text"))).cast("long").alias("n"))
    return n.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.sum("n").cast("double") / F.count("*"), 6).alias("mean"), F.count_if(F.col("n") > 512).alias("truncated"))


@query("""
with d as (select user_id, strftime(ts, '%Y-%m-%d') as day, sum(value::decimal(18,4))::double as total from events group by all)
select user_id, count(*)::bigint as steps, bool_and(previous is null or previous > total) as decreasing, arg_min(day, (total, day)) as best_step, min(total) as best, arg_max(total, day) as last, arg_max(total, day) > min(total) as overfit
from (select *, lag(total) over (partition by user_id order by day) as previous from d) group by user_id""")
def decreasing_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of a user."""
    from ..operators.diverge import strictly_decreasing

    daily = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    out = strictly_decreasing(daily, ["user_id"], "day", "total")
    return out.join(daily.groupBy("user_id").agg(F.count("*").alias("steps")), "user_id").select("user_id", "steps", "decreasing", "best_step", "best", "last", "overfit")


@query("""
select user_id, event_id, before, previous_after from (
  select user_id, event_id, before, lag(after) over (partition by user_id order by event_id) as previous_after from (select user_id, event_id, event_id % 3 as before, (event_id + 1) % 3 as after from events)
) where previous_after is not null and previous_after <> before""")
def run_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    from ..operators.diverge import discontinuities

    runs = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("before"), ((F.col("event_id") + 1) % 3).alias("after"))
    return discontinuities(runs, "user_id", "event_id", "before", "after").select("user_id", "event_id", "before", "previous_after")


@query("""
with r as (
  select user_id, user_id % 4 as p, count(*) filter (event_type = 'click') as calls, count(*) filter (event_type = 'view') as observations,
    coalesce(bool_or(event_type = 'purchase' and value > 90), false) as unknown, coalesce(bool_or(event_type = 'error' and value > 50), false) as denied from events group by user_id
), l as (
  select user_id, ['success', 'failure', 'unknown_outcome', 'in_progress'][p + 1] as outcome_class, p in (1, 2) as is_failure, p = 2 or unknown as is_unknown_outcome, denied as policy_denied, calls >= 15 as budget_limit_hit, calls, observations from r
)
select user_id::varchar as run_id, outcome_class, is_failure, is_unknown_outcome, policy_denied, budget_limit_hit, calls::bigint as calls, observations::bigint as observations,
  list_filter([case when is_failure then 'failure' end, case when is_unknown_outcome then 'unknown_outcome' end, case when policy_denied then 'policy_denial' end, case when budget_limit_hit then 'budget_limit' end, case when calls > 0 then 'tool_sequence_available' end], lambda x: x is not null) as verifier_tags from l""")
def reliability_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 end to end: run exports written as JSON from each user's events, then mapped to records."""
    from ..operators.reliability import BUDGETS
    from ..operators.reliability import reliability_records as records

    kind, value = F.col("event_type"), F.col("value")
    name = F.when(kind == "click", "tool_call").when(kind == "purchase", "tool_result").when(kind == "error", "policy_decision").when(kind == "signup", "recovery").otherwise("observation")
    status = F.when(kind == "purchase", F.when(value > 90, "unknown_outcome").otherwise("ok")).when(kind == "signup", "ready")
    event = F.struct("ts", "event_id", name.alias("kind"), kind.alias("tool"), status.alias("status"), F.when(kind == "purchase", "dispatched").alias("dispatch"), F.when(kind == "error", F.when(value > 50, "deny").otherwise("allow")).alias("decision"))
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(event)).alias("e"), F.count_if(kind == "click").alias("calls"))
    events = F.transform("e", lambda x, i: F.struct((i + 1).cast("long").alias("sequence"), *(x[f].alias(f) for f in ("kind", "tool", "status", "dispatch", "decision"))))
    budgets = F.struct(*(F.lit(15 if b == "tool_calls" else 0).alias(f"max_{b}") for b in BUDGETS), *((F.col("calls") if b == "tool_calls" else F.lit(0)).alias(f"{b}_used") for b in BUDGETS))
    phase = F.element_at(F.array(*map(F.lit, ("SUCCESS", "FAILED", "UNKNOWN_OUTCOME", "RUNNING"))), (F.col("user_id") % 4 + 1).cast("int"))
    point = F.struct(F.lit(1).alias("checkpoint_version"), phase.alias("phase"), F.lit("trace-v1").alias("policy_version"), F.lit("ready").alias("recovery_status"), F.lit("none").alias("recovery_action"), F.size("e").alias("event_count"), budgets.alias("budgets"))
    export = F.to_json(F.struct(F.lit(1).alias("run_export_version"), F.lit("sha256:none").alias("manifest_digest"), F.col("user_id").cast("string").alias("run_id"), F.lit("redacted").alias("data_class"), F.lit("verifier").alias("training_use"), point.alias("checkpoint"), events.alias("events")))
    found = records(runs.select(export.alias("raw")))
    counts = F.col("features.event_kind_counts")
    return found.select(F.col("source.run_id").alias("run_id"), "labels.outcome_class", "labels.is_failure", "labels.is_unknown_outcome", "labels.policy_denied", "labels.budget_limit_hit", F.size("features.tool_sequence").cast("long").alias("calls"), counts["observation"].alias("observations"), "labels.verifier_tags")
