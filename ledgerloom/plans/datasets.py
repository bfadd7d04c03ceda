"""Generator, isolation, remediation, manifest and file queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generate, grounding, isolation, manifests, remediation, score
from ..sources.scratch import written_once
from .contracts import Defect, defects_sql, with_defect
from .registry import query, spread, table
from .router import ANSWERED_SQL, judged

FAMILIES_SQL = """
f as (select n_nationkey as number, ['normal', 'approval', 'rejection', 'fallback', 'ambiguity'][(n_nationkey // 5 + 1)::int] as category, n_nationkey % 5 as place, 'asks about ' || n_name as description, n_name || ' and {subject}' as template, 0 as base from nation
  union all select n_nationkey, 'safety', n_nationkey % 5, 'guards ' || n_name, 'Keep {subject} from ' || n_name, 25 from nation where n_nationkey < 5),
s as (select list(r_name order by r_regionkey) as subjects from region),
r as (select 'family-' || lpad((number + base + 1)::varchar, 3, '0') as family_id, case when place < 3 then 'train' else 'validation' end as split, category, description, template, subjects, unnest(range(case when place < 3 then 4 else 2 end)) as v from f, s),
e as (select split || '-' || family_id || '-v' || lpad((v + 1)::varchar, 2, '0') as example_id, family_id, split, category, description, replace(template, '{subject}', subjects[v + 1]) as instruction, 'at ' || subjects[v + 1] as place_argument from r)"""


def family_specs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    subjects = table(spark, sf_dir, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("subjects"))
    category = F.element_at(F.array(*map(F.lit, ("normal", "approval", "rejection", "fallback", "ambiguity"))), (F.floor(k / 5) + 1).cast("int"))
    arguments = F.create_map(F.lit("place"), F.lit("at {subject}"))
    one = n.select(k.cast("int").alias("number"), category.alias("category"), (k % 5).cast("int").alias("place"), F.concat(F.lit("asks about "), "n_name").alias("description"), F.concat("n_name", F.lit(" and {subject}")).alias("template"), arguments.alias("arguments"))
    two = n.where(k < 5).select(k.cast("int").alias("number"), F.lit("safety").alias("category"), (k % 5).cast("int").alias("place"), F.concat(F.lit("guards "), "n_name").alias("description"), F.concat(F.lit("Keep {subject} from "), "n_name").alias("template"), arguments.alias("arguments"))
    with_subjects = lambda df: df.crossJoin(F.broadcast(subjects))  # noqa: E731  (one row)
    return with_subjects(one), with_subjects(two)


def family_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = family_specs(spark, sf_dir)
    return generate.with_increment(generate.family_records(one, 3, 4, 2), generate.family_records(two, 3, 4, 2, first_family=26))


@query(f"with {FAMILIES_SQL} select example_id, family_id, split, category, instruction, place_argument, 'delivery-' || example_id as delivery_id from e")
def family_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all variants of all families, those of an increment behind the first version's."""
    return family_dataset(spark, sf_dir).select("example_id", "family_id", "split", "category", "instruction", F.col("arguments")["place"].alias("place_argument"), "delivery_id")


@query(f"with {FAMILIES_SQL} select family_id, split, category, description, list_sort(list(example_id)) as example_ids from e group by all")
def family_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the families."""
    return generate.family_manifest(family_dataset(spark, sf_dir))


@query("""
with x(split, suffixed) as (values ('seed', false), ('eval', true))
select split || '-' || lpad((n_nationkey + 1)::varchar, 3, '0') as example_id, split, r_name as category, 'Ask ' || n_name || case when suffixed then ' Evaluation case ' || (n_nationkey + 1) || '.' else '' end as instruction,
  n_name || case when suffixed then '-eval' else '' end as query, 'low' as reason_code from nation join region on n_regionkey = r_regionkey, x""")
def fixture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed and an eval fixture of one specification."""
    specs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 1).cast("int").alias("number"), F.col("r_name").alias("category"), F.concat(F.lit("Ask "), "n_name").alias("instruction"), F.create_map(F.lit("query"), F.col("n_name"), F.lit("reason_code"), F.lit("low")).alias("arguments"))
    both = generate.fixture_records(specs, "seed", False).unionByName(generate.fixture_records(specs, "eval", True, ("reason_code",)))
    return both.select("example_id", "split", "category", "instruction", F.col("arguments")["query"].alias("query"), F.col("arguments")["reason_code"].alias("reason_code"))


MODES = {"tree": (True, False), "picture": (False, True), "both": (True, True)}
SENTENCES = {"press": "Press the {label}.", "refuse": "Press the {label} that was there before.", "ask": "Press the {label} or the like."}
ANSWERS = {"press": None, "refuse": "gone", "ask": "unclear"}


@query("""
with s as (select p_partkey as number, p_name as label, [p_size::bigint, p_partkey % 40, p_size + 30, p_partkey % 40 + 12] as box from part),
g as (select * from s, (values ('tree', true, false), ('picture', false, true), ('both', true, true)) m(mode, has_ref, has_box), (values ('press', 'Press the ', '.', null), ('refuse', 'Press the ', ' that was there before.', 'gone'), ('ask', 'Press the ', ' or the like.', 'unclear')) d(disposition, a, b, reason))
select number || '-' || mode || '-' || disposition as case_id, number as family, mode as observation_mode, disposition, a || label || b as instruction, case when has_ref then 'ref-' || number end as cue_ref, case when has_box then box end as cue_bbox,
  case when reason is null then 'click' end as tool, case when reason is null and has_ref then 'ref-' || number end as ref, case when reason is null and has_box then box end as bbox, reason from g""")
def training_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a control, in three modes and with three dispositions."""
    size, place = F.col("p_size").cast("long"), F.col("p_partkey") % 40
    seeds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("label"), F.array(size, place, size + 30, place + 12).alias("bbox"))
    return generate.training_grid(seeds, MODES, SENTENCES, ANSWERS)


@query("""
with base as (select map_from_entries(list((r_name, 'calm') order by r_name)) as observation from region),
c as (select n_nationkey, n_name as category, r_name as field, 'busy-' || n_nationkey as value, n_nationkey % 4 <> 0 as changes, n_nationkey % 3 = 0 as acts from nation join region on n_regionkey = r_regionkey),
s as (select 'scene-' || s_suppkey as scene, s_nationkey, case when s_acctbal < 2000 then 'validation' else 'train' end as split from supplier),
g as (select *, unnest(['clean', 'hard_negative']) as variant from s join c on s_nationkey = n_nationkey, base)
select category as category_id, scene as scene_id, split, variant, 'In ' || scene || ', judge what ' || category || ' shows.' as instruction,
  list_transform(list_sort(map_keys(observation)), lambda f: f || '=' || case when changes and f = field then value else 'calm' end) as observation,
  case when variant = 'hard_negative' or acts then 'act' else 'wait' end as disposition, case when variant = 'hard_negative' or acts then 'press' end as tool,
  case when variant = 'hard_negative' then scene || '/other' when acts then scene || '/own' end as target_ref, case when variant = 'clean' then 'accept' else 'reject' end as verdict, case when variant = 'clean' then 'sound' else category end as reason_code from g""")
def hard_negative_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as scenes of their nation's category, each with a clean record and a hard negative."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    base = regions.agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.lit("calm")))).alias("observation"))
    n = F.col("n_nationkey")
    candidate = lambda acts, target: F.struct(F.when(acts, "act").otherwise("wait").alias("disposition"), F.when(acts, "press").alias("tool"), F.when(acts, target).alias("target"))
    changes = F.when(n % 4 != 0, F.create_map("r_name", F.concat(F.lit("busy-"), n.cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    categories = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(F.col("n_name").alias("category_id"), n.alias("number"), changes.alias("overrides"), candidate(n % 3 == 0, "own").alias("clean"), candidate(F.lit(True), "other").alias("negative"))
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == n)
    scenes = suppliers.select(F.col("n_name").alias("category_id"), F.concat(F.lit("scene-"), F.col("s_suppkey").cast("string")).alias("scene_id"), F.when(F.col("s_acctbal") < 2000, "validation").otherwise("train").alias("split"))
    made = generate.hard_negatives(scenes, categories.drop("number"), base, "In {scene}, judge what {category} shows.")
    fields = F.array_sort(F.transform(F.map_entries("observation"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return made.withColumn("observation", fields)


IDS_SQL = """
i as (select case doc_id % 10 when 8 then 'validation' when 9 then 'eval' else 'train' end as split, doc_id, unnest([{'kind': 'case_ids', 'identity': 'd-' || doc_id}, {'kind': 'family_ids', 'identity': 's-' || (doc_id % 97)}, {'kind': 'instruction_sha256', 'identity': sha256(left(text, 20))},
    {'kind': 'observation_sha256', 'identity': sha256(lang || source)}, {'kind': 'candidate_sha256', 'identity': sha256(text)}, {'kind': 'image_sha256', 'identity': sha256('i' || (doc_id % 50))}, {'kind': 'image_sha256', 'identity': sha256('j' || doc_id)}], recursive := true) from documents)"""


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audit import split_of

    k = F.col("doc_id")
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    sha = lambda x: F.sha2(x, 256)
    kinds = {"case_ids": text("d-", k), "family_ids": text("s-", k % 97), "instruction_sha256": sha(F.left("text", F.lit(20))), "observation_sha256": sha(F.concat("lang", "source")), "candidate_sha256": sha(F.col("text")), "image_sha256": F.array(sha(text("i", k % 50)), sha(text("j", k)))}
    return isolation.identities(table(spark, sf_dir, "documents").withColumn("split", split_of(k)), ["split", "doc_id"], kinds)


@query(f"""with {IDS_SQL}, o as (select kind, identity from i group by all having bool_or(split in ('train', 'validation')) and bool_or(split = 'eval')), t as (select kind, identity from i where kind = 'family_ids' group by all having bool_or(split = 'train') and bool_or(split = 'validation')),
u as (select * from o union all select 'train_validation_families', identity from t), k(kind) as (values {", ".join(f"('{x}')" for x in (*isolation.KINDS, "train_validation_families"))})
select kind, count(identity)::bigint as overlaps, min(identity) as first, count(identity) = 0 as passed from k left join u using (kind) group by kind""")
def isolation_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-2: overlaps of seven kinds of identity between what trains and what evaluates, and between train and validation families."""
    rows = ids(spark, sf_dir)
    families = isolation.overlaps(rows.where("kind = 'family_ids'"), "split", ["train"], ["validation"]).withColumn("kind", F.lit("train_validation_families"))
    found = isolation.overlaps(rows, "split", ["train", "validation"], ["eval"]).unionByName(families)
    return isolation.isolation_report(found, (*isolation.KINDS, "train_validation_families"))


@query(f"with {IDS_SQL} select distinct i.doc_id, i.kind from i join (select distinct kind, identity from i where doc_id % 41 = 7) r on i.kind = r.kind and i.identity = r.identity where i.doc_id % 41 <> 7")
def exclusion_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that collide with a registry of six kinds of identity."""
    rows = ids(spark, sf_dir)
    return isolation.exclusion_collisions(rows.where("doc_id % 41 <> 7"), rows.where("doc_id % 41 = 7"), "doc_id")


@query("""
with r as (select ['case_ids', 'image_sha256', 'other'][(doc_id % 3 + 1)::int] as kind, doc_id // 3 as place, case doc_id % 3 when 0 then case when doc_id % 33 = 0 then 'Bad Id' else 'd' || lpad((doc_id // 3 // 2)::varchar, 9, '0') end when 1 then case when doc_id % 37 = 0 then 'zz' else lpad((doc_id // 3)::varchar, 64, '0') end else 'x' end as identity from documents),
p as (select *, lag(identity) over (partition by kind order by place) as before, lag(place) over (partition by kind order by place) as q from r)
select kind, place, case when kind = 'other' then 'EXCLUSION_REGISTRY_SHAPE_INVALID' when q = place - 1 and before >= identity then 'EXCLUSION_REGISTRY_NOT_CANONICAL' when kind = 'case_ids' then 'EXCLUSION_ID_INVALID' else 'EXCLUSION_HASH_INVALID' end as code
from p where kind = 'other' or (q = place - 1 and before >= identity) or (kind = 'case_ids' and not regexp_full_match(identity, '[a-z0-9][a-z0-9._-]*')) or (kind = 'image_sha256' and not regexp_full_match(identity, '[0-9a-f]{64}'))""")
def registry_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-6: registry rows that are out of order, repeated, malformed or of no known kind."""
    k, place = F.col("doc_id"), F.floor(F.col("doc_id") / 3).cast("long")
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    identity = F.when(k % 3 == 0, F.when(k % 33 == 0, "Bad Id").otherwise(F.concat(F.lit("d"), padded(F.floor(place / 2), 9)))).when(k % 3 == 1, F.when(k % 37 == 0, "zz").otherwise(padded(place, 64))).otherwise("x")
    kind = F.element_at(F.array(F.lit("case_ids"), F.lit("image_sha256"), F.lit("other")), (k % 3 + 1).cast("int"))
    return isolation.registry_issues(table(spark, sf_dir, "documents").select(kind.alias("kind"), place.alias("place"), identity.alias("identity")))


COMPARED_SQL = f"""{ANSWERED_SQL}, c as (
  select l.example_id, unnest({list(remediation.DIMENSIONS)}) as dimension,
    unnest([l.error is null, l.error is null and l.semantic_error is null, l.error is null and l.tool = l.gold->>'selected_tool', l.error is null and (l.j->'arguments')::varchar = (l.gold->'arguments')::varchar, l.error is null and l.risk = l.gold->>'risk_level', l.error is null and l.app = (l.gold->>'requires_approval' = 'true'), l.error is null and l.rej = (l.gold->>'should_reject' = 'true'), l.error is null and l.fal = (l.gold->>'should_fallback' = 'true')]) as reference,
    unnest([r.error is null, r.error is null and r.semantic_error is null, r.error is null and r.tool = r.gold->>'selected_tool', r.error is null and (r.j->'arguments')::varchar = (r.gold->'arguments')::varchar, r.error is null and r.risk = r.gold->>'risk_level', r.error is null and r.app = (r.gold->>'requires_approval' = 'true'), r.error is null and r.rej = (r.gold->>'should_reject' = 'true'), r.error is null and r.fal = (r.gold->>'should_fallback' = 'true')]) as candidate
  from s l join s r on r.example_id = l.example_id + 75)"""


def both_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    # judged once: the flags alone are written, and meet themselves
    flags = written_once(remediation.flagged(judged(spark, sf_dir), "example_id"), "judged")
    candidate = flags.select((F.col("example_id") - 75).alias("example_id"), F.col("flags").alias("candidate"))
    return flags.select("example_id", F.col("flags").alias("reference")).join(candidate, "example_id")


@query(f"with {COMPARED_SQL} select example_id, dimension, case when reference then 'regression' else 'improvement' end as event from c where reference <> candidate")
def answer_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight dimensions of every example, a candidate (the answers of 75 keys on) against a reference."""
    return remediation.change_events(both_judged(spark, sf_dir), "example_id")


@query(f"""
with g as (select s_suppkey, s_suppkey % 2 > 0 as full_eval, s_suppkey % 3 > 0 as safety, s_suppkey % 5 > 0 as per_example_regression, case when s_suppkey % 7 > 0 then s_suppkey % 11 > 0 end as core_quality, s_suppkey % 13 > 0 as resource, case when s_suppkey % 4 > 1 then ['tool_accuracy'] else [] end as improvements from supplier),
f as (select *, list_filter([{", ".join(f"case when not coalesce({x}, false) then '{x}_gate_failed' end" for x in remediation.GATES)}], lambda x: x is not null) as failure_reasons,
  len(list_distinct(list_filter([{", ".join(f"case when not coalesce({x}, false) then '{k}' end" for x, k in remediation.GATES.items())}], lambda x: x is not null))) as kinds from g)
select s_suppkey, case when kinds > 0 then 'adverse' when len(improvements) > 0 then 'favorable' else 'neutral' end as outcome,
  case when kinds > 1 then 'multiple' when kinds = 1 then case when not safety then 'safety' when not resource then 'resource' else 'quality' end when len(improvements) > 0 then 'improves' else 'preserves' end as classification, failure_reasons from f""")
def candidate_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, class and reasons from five gates."""
    k = F.col("s_suppkey")
    gates = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 2 > 0).alias("full_eval"), (k % 3 > 0).alias("safety"), (k % 5 > 0).alias("per_example_regression"), F.when(k % 7 > 0, k % 11 > 0).alias("core_quality"), (k % 13 > 0).alias("resource"), F.when(k % 4 > 1, F.array(F.lit("tool_accuracy"))).otherwise(F.array().cast("array<string>")).alias("improvements"))
    return remediation.gate_outcome(gates).select("s_suppkey", "outcome", "classification", "failure_reasons")


@query("""
with m as (select n_regionkey, n_name as metric, case when n_nationkey % 6 = 5 then null else n_nationkey % 3 end as before, (n_nationkey * 7) % 3 + n_nationkey % 2 as after from nation)
select n_regionkey, coalesce(list_sort(list(metric) filter (after > before)), []) as improvements, coalesce(list_sort(list(metric) filter (after < before)), []) as regressions, coalesce(list_sort(list(metric) filter (after = before)), []) as unchanged, coalesce(list_sort(list(metric) filter (before is null)), []) as not_applicable,
  count(*) filter (after < before) = 0 as core_quality from m group by n_regionkey""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Improved, regressed, unchanged and not applicable metrics of a comparison."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("metric"), F.when(k % 6 != 5, k % 3).alias("before"), ((k * 7) % 3 + k % 2).alias("after"))
    return remediation.quality_gate(score.metric_deltas(rows, "before", "after"), ["n_regionkey"])


@query(f"""with {ANSWERED_SQL}, c as (select example_id, app and rej and tool = 'file_write' as has_signature from s where semantic_error = 'CONFLICTING_DECISION_FLAGS'),
n as (select count(*)::bigint as conflicts, count(*) filter (not has_signature)::bigint as unexpected from c), w as (select count(*) filter (error is null and rej and gold->>'should_reject' <> 'true')::bigint as false_refusals from s)
select conflicts, unexpected, false_refusals, case when conflicts = 0 then 'CONFLICT_COUNT_MISMATCH' when unexpected > 0 then 'UNEXPECTED_CONFLICT_SIGNATURE' when false_refusals <> conflicts then 'UNATTRIBUTABLE_FALSE_REFUSALS' else 'aggregate_count_matches_exact_conflict_cohort' end as attribution from n, w""")
def failure_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort of conflicting answers with one signature, and whether the false refusals are theirs."""
    rows = judged(spark, sf_dir)
    cohort = remediation.conflict_cohort(rows, "example_id", {"selected_tool": '"file_write"', "requires_approval": "true", "should_reject": "true"})
    return remediation.attribution(rows, cohort)


@query("""
with r as (select o_custkey as k, max(o_orderkey) as run_peak, sum(o_totalprice::decimal(38,15)) as run_elapsed from orders group by o_custkey),
c as (select c_custkey, case when c_custkey % 5 = 0 then 1 else coalesce(run_peak, 0) end as peak, coalesce(run_elapsed::double, 0) + case when c_custkey % 7 = 0 then -1 else 0 end as elapsed, run_peak, run_elapsed::double as run_elapsed from customer left join r on c_custkey = k)
select c_custkey, peak, elapsed, run_peak, run_elapsed, case when run_peak is null then 'NO_RUNS' when peak <> run_peak then 'PEAK_MISMATCH' when elapsed + 1e-12 < run_elapsed then 'ELAPSED_TOO_SHORT' end as issue from c""")
def resource_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed peak and time of a customer against the greatest and the sum of its runs."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("peak"), F.col("o_totalprice").alias("elapsed"))
    own = runs.groupBy("c_custkey").agg(F.max("peak").alias("p"), F.sum(F.col("elapsed").cast("decimal(38,15)")).cast("double").alias("e"))
    k = F.col("c_custkey")
    claims = table(spark, sf_dir, "customer").select("c_custkey").join(own, "c_custkey", "left").select("c_custkey", F.when(k % 5 == 0, 1).otherwise(F.coalesce("p", F.lit(0))).alias("peak"), (F.coalesce("e", F.lit(0.0)) + F.when(k % 7 == 0, -1).otherwise(0)).alias("elapsed"))
    return remediation.resource_rollup(claims, runs, "c_custkey", "peak", "elapsed")


FAMILY = {"family_id": "family-001", "split": "train", "category": "approval", "description": "d", "example_ids": ["train-a-@id", "train-b"]}
FAMILY_MANIFEST = json.dumps({"dataset_manifest_version": 1, "tool_router_schema_version": 1, "frozen_eval_digest": "sha256:" + "a" * 64, "families": [FAMILY, {**FAMILY, "family_id": "family-002", "split": "validation", "example_ids": ["validation-c"]}]})
F0, F1 = "$.families[0]", "$.families[1]"
FAMILY_DEFECTS: list[Defect] = [
    ("", "", None, None), ("}]}", "]}", "MALFORMED_JSON", "$"), ('"tool_router_schema_version": 1', '"tool_router_schema_version": "1"', "UNSUPPORTED_VERSION", "$.tool_router_schema_version"), ('"sha256:a', '"sha256:g', "INVALID_EVAL_DIGEST", "$.frozen_eval_digest"), ('"family-001"', '"family-1"', "INVALID_FAMILY_ID", f"{F0}.family_id"),
    ('"family-002"', '"family-001"', "DUPLICATE_FAMILY_ID", f"{F1}.family_id"), ('"split": "validation"', '"split": "eval"', "INVALID_FAMILY_SPLIT", f"{F1}.split"), ('"approval"', '"other"', "INVALID_FAMILY_CATEGORY", f"{F0}.category"), ('"description": "d"', '"description": ""', "INVALID_FAMILY_DESCRIPTION", f"{F0}.description"),
    ('["validation-c"]', "[]", "INVALID_FAMILY_EXAMPLES", f"{F1}.example_ids"), ('["validation-c"]', '["train-c"]', "INVALID_FAMILY_EXAMPLE_ID", f"{F1}.example_ids"), ('"train-b"', '"train-a-@id"', "DUPLICATE_FAMILY_EXAMPLE", F0), (', "description": "d"', "", "INVALID_KEYS", F0), ('"families": [', '"families": [], "x": [', "INVALID_KEYS", "$"),
]


@query(defects_sql("orders", "o_orderkey", FAMILY_DEFECTS))
def family_manifest_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, C4: the first rule that each family manifest breaks."""
    # a defect may hold the number in what it puts there
    raw = F.replace(with_defect(FAMILY_MANIFEST, FAMILY_DEFECTS, F.col("o_orderkey")), F.lit("@id"), F.col("o_orderkey").cast("string"))
    return grounding.document_violations(spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", raw.alias("raw")), ["o_orderkey"], "raw", manifests.family_rules)


TARGETS = ["argument_drift", "dangerous_action_candidate", "duplicate_action", "over_fallback"]
TAXONOMY = json.dumps({
    "taxonomy_version": 1, **{f: "sha256:" + "b" * 64 for f in manifests.TAXONOMY_FIELDS[1:4]}, "badcases": [{"example_id": f"eval-00{k}", "repair_target": t, "failure_codes": ["X"], "classification": "c"} for k, t in enumerate(TARGETS)],
    "overfitting": {"lowest_validation_loss_epoch": 3, "lowest_validation_loss": 0.5, "final_validation_loss": 0.75, "classification": "validation_overfitting_after_epoch_3"}, "repair_policy": manifests.POLICY,
})
TAXONOMY_DEFECTS: list[Defect] = [
    ("", "", None, None), ('"taxonomy_version": 1', '"taxonomy_version": 2', "UNSUPPORTED_BADCASE_TAXONOMY", "$.taxonomy_version"), ('"source_report_sha256": "sha256:b', '"source_report_sha256": "md5:b', "INVALID_BADCASE_SOURCE_DIGEST", "$.source_report_sha256"), ('"badcases": [', '"badcases": [1, ', "INVALID_BADCASE_COUNT", "$.badcases"),
    ('"eval-002"', '"eval-2"', "INVALID_BADCASE_ID", "$.badcases[2].example_id"), ('"eval-002"', '"eval-001"', "DUPLICATE_BADCASE_ID", "$.badcases[2].example_id"), ('"over_fallback"', '"other"', "INVALID_REPAIR_TARGET", "$.badcases[3].repair_target"), ('"over_fallback"', '"duplicate_action"', "INCOMPLETE_REPAIR_TARGETS", "$.badcases"),
    ('"eval-000", "repair_target": "argument_drift", "failure_codes": ["X"]', '"eval-000", "repair_target": "argument_drift", "failure_codes": []', "INVALID_FAILURE_CODES", "$.badcases[0].failure_codes"), ('"lowest_validation_loss_epoch": 3', '"lowest_validation_loss_epoch": 4', "INVALID_OVERFITTING_EPOCH", "$.overfitting.lowest_validation_loss_epoch"),
    ('"final_validation_loss": 0.75', '"final_validation_loss": 0.5', "INVALID_OVERFITTING_EVIDENCE", "$.overfitting"), ('after_epoch_3"', 'after_epoch_2"', "INVALID_OVERFITTING_CLASSIFICATION", "$.overfitting.classification"), ('"training_performed": false', '"training_performed": true', "UNSAFE_REPAIR_POLICY", "$.repair_policy"),
]


@query(defects_sql("orders", "o_orderkey", TAXONOMY_DEFECTS))
def taxonomy_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each bad-case taxonomy breaks."""
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", with_defect(TAXONOMY, TAXONOMY_DEFECTS, F.col("o_orderkey")).alias("raw"))
    return grounding.document_violations(rows, ["o_orderkey"], "raw", lambda doc, scope: manifests.taxonomy_rules(doc, scope, TARGETS, 3))


@query("""
with e as (select item_id, 'f' || item_id as path, case when item_id % 3 = 0 then 'git_lfs' else 'git_blob' end as binding_kind, text from benchmark)
select path, binding_kind, case when binding_kind = 'git_lfs' then item_id * 1000 else strlen(text) end::bigint as bytes, 'sha256:' || case when binding_kind = 'git_lfs' then sha256('big' || item_id) else sha256(text) end as sha256,
  case when binding_kind = 'git_lfs' then sha1('ptr' || item_id) else sha1('blob ' || strlen(text) || chr(0) || text) end as git_blob_sha1, case when binding_kind = 'git_lfs' then 134::bigint end as pointer_bytes from e""")
def content_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a remote listing by name, and what each expected path is bound to."""
    b, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    path, large = F.concat(F.lit("f"), k.cast("string")), k % 3 == 0
    entry = F.struct(path.alias("rfilename"), (k * 10).alias("size"), F.sha1(F.concat(F.lit("ptr"), k.cast("string"))).alias("blobId"), F.when(large, F.struct(F.lit(134).alias("pointerSize"), F.sha2(F.concat(F.lit("big"), k.cast("string")), 256).alias("sha256"), (k * 1000).alias("size"))).alias("lfs"))
    listing = b.agg(F.to_json(F.struct(F.collect_list(entry).alias("siblings"))).alias("raw"))  # one remote answer is one document
    remote = listing.select(F.inline(manifests.remote_files(F.parse_json("raw"))))
    return manifests.content_bindings(b.select(path.alias("path"), F.when(large, "git_lfs").otherwise("git_blob").alias("binding_kind")), b.select(path.alias("path"), F.to_binary("text", F.lit("utf-8")).alias("content")), remote)
