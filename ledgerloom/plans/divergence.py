"""Divergence, gate and generator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identity
from ..functions.text import tokens
from ..operators import diverge, gates, generate, rules, walk
from .registry import query, spread, table

VECTOR_PAIRS_SQL = "p as (select a.vec_id, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1), c as (select vec_id, unnest(range(len(x))) as pos, unnest(x)::double as l, unnest(y)::double as r from p)"


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query("""
with t as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from conversations),
p as (select a.conv_id, a.turn, a.w as l, b.w as r from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
z as (select conv_id, turn, unnest(range(greatest(len(l), len(r)))) as i, l, r from p)
select p.conv_id, p.turn, min(i)::bigint as first_difference from p left join (select * from z where l[i + 1] is distinct from r[i + 1]) z on p.conv_id = z.conv_id and p.turn = z.turn group by p.conv_id, p.turn""")
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a turn against those of the next."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("r"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", diverge.first_difference(F.col("w"), F.col("r")).alias("first_difference"))


LAYERS_SQL = """
with a as (select doc_id, sha256(text) as raw, lang as compiled, n_chars as metric from documents where doc_id % 91 <> 0),
b as (select doc_id, case when doc_id % 40 = 0 then '' else sha256(text) end as raw, case when doc_id % 60 = 0 then 'xx' else lang end as compiled, n_chars as metric from documents),
j as (select coalesce(a.doc_id, b.doc_id) as doc_id, a.doc_id is not null and b.doc_id is not null and a.raw is not distinct from b.raw as s1, a.doc_id is not null and b.doc_id is not null and a.compiled is not distinct from b.compiled as s2, a.doc_id is not null and b.doc_id is not null and a.metric is not distinct from b.metric as s3 from a full join b on a.doc_id = b.doc_id),
u as (select doc_id, 'raw' as layer, s1 as same from j union all select doc_id, 'compiled', s2 from j union all select doc_id, 'metric', s3 from j)"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay with altered raw and compiled layers, and a record that the reference lacks."""
    docs = table(spark, sf_dir, "documents")
    reference = docs.where("doc_id % 91 <> 0").select("doc_id", F.sha2("text", 256).alias("raw"), F.col("lang").alias("compiled"), F.col("n_chars").alias("metric"))
    replay = docs.select("doc_id", F.when(F.col("doc_id") % 40 == 0, "").otherwise(F.sha2("text", 256)).alias("raw"), F.when(F.col("doc_id") % 60 == 0, "xx").otherwise(F.col("lang")).alias("compiled"), F.col("n_chars").alias("metric"))
    return diverge.layer_mismatches(reference, replay, "doc_id", ["raw", "compiled", "metric"])


@query(f"""{LAYERS_SQL}
select layer, count(*) filter (same)::bigint as "equal", count(*) filter (not same)::bigint as different, min(doc_id) filter (not same) as first_mismatch from u group by layer""")
def layered_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay with altered raw and compiled layers and a missing record in the reference."""
    return diverge.layered_equality(replayed(spark, sf_dir), "doc_id")


@query(f"{LAYERS_SQL} select doc_id, layer from u where not same")
def replay_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and layer that a replay doesn't reproduce."""
    return replayed(spark, sf_dir).where("not same").select("doc_id", "layer")


@query(f"""with {VECTOR_PAIRS_SQL}, d as (select vec_id, pos, abs(l - r) as d from c)
select vec_id, count(*)::bigint as elements, count(*) filter (d > 0)::bigint as n_different, max(d) as max_delta, arg_max(pos, (d, -pos))::bigint as first_max, min(pos) filter (d > 0)::bigint as first_different,
  round(sum(d::decimal(38,15))::double / count(*), 9) as mean_delta, round(sqrt(sum((d * d)::decimal(38,15))::double / count(*)), 9) as rms_delta from d group by vec_id""")
def vector_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16, E22."""
    return diverge.delta_statistics(vector_pairs(spark, sf_dir), ["vec_id"], "x", "y")


@query(f"""with {VECTOR_PAIRS_SQL}, u as (select vec_id, l as b, r * 0.001 as u from c)
select vec_id, count(*) filter (u <> 0)::bigint as nonzero, count(*) filter (u <> 0 and floor((b + u) * 1024 + 0.5) <> floor(b * 1024 + 0.5))::bigint as effective, count(*) filter (u <> 0 and floor((b + u) * 1024 + 0.5) = floor(b * 1024 + 0.5))::bigint as rounded_to_base from u group by vec_id""")
def rounding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a thousandth of the next vector on a grid of 1/1024."""
    pairs = vector_pairs(spark, sf_dir).withColumn("y", F.transform("y", lambda v: v.cast("double") * 0.001)).withColumn("x", F.transform("x", lambda v: v.cast("double")))
    return diverge.rounding_audit(pairs, ["vec_id"], "x", "y", 10)


@query("select vec_id, pos, value, rank() over (partition by vec_id order by value desc)::bigint as rank from (select vec_id, unnest(range(len(embedding)))::bigint as pos, unnest(embedding) as value from embeddings)")
def vector_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10."""
    return diverge.rank_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.col("pos").cast("long").alias("pos"), "value", F.col("rank").cast("long").alias("rank"))


@query("""
with c as (select vec_id, unnest(range(len(embedding)))::bigint as pos, unnest(embedding)::double as value from embeddings), r as (select *, row_number() over (partition by vec_id order by value desc, pos) as k from c)
select vec_id, list(pos order by k) filter (k <= 3) as top, max(value) filter (k = 1) - max(value) filter (k = 2) as margin, max(value) filter (k = 1) > max(value) filter (k = 2) as unique_top from r group by vec_id""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.G: the top three elements by position, the top margin, and whether the top is the only one."""
    cells = F.transform("embedding", lambda v, i: F.struct((-v.cast("double")).alias("v"), i.cast("long").alias("pos")))
    best = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.array_sort(cells), 1, 3).alias("t"))
    return best.select("vec_id", F.transform("t", lambda x: x["pos"]).alias("top"), (F.col("t")[1]["v"] - F.col("t")[0]["v"]).alias("margin"), (F.col("t")[0]["v"] < F.col("t")[1]["v"]).alias("unique_top"))


@query("""
with r as (select label, vec_id % 50 as k, vec_id % 2 as rep, sha256(case when vec_id % 31 = 0 then 'x' else (vec_id % 50)::varchar end) as h from embeddings), g as (select label, k, count(distinct h) = 1 as same, count(distinct rep) as reps from r group by all)
select label, bool_and(same) as stable, count(*)::bigint as keys, min(reps)::bigint as least_repeats from g group by label""")
def repeat_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    i = F.col("vec_id")
    runs = table(spark, sf_dir, "embeddings").select("label", (i % 50).alias("k"), (i % 2).alias("rep"), F.sha2(F.when(i % 31 == 0, "x").otherwise((i % 50).cast("string")), 256).alias("h"))
    return diverge.repeats_agree(runs, "label", "k", "rep", "h")


@query("""
with m as (select l_orderkey, l_linenumber * 10000000::bigint + l_partkey as module, l_partkey % 3 <> 0 as same, (l_partkey % 100 + 1)::double as size from lineitem)
select l_orderkey, min(module) filter (not same)::bigint as first_index, count(*) filter (same)::bigint as n_equal, arg_min(size, module) filter (not same) as first_size, arg_max(size, module) filter (not same) as last_size,
  round(arg_max(size, module) filter (not same) / arg_min(size, module) filter (not same), 9) as growth from m group by l_orderkey""")
def first_divergent_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of an order as modules, numbered by line and part."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey")).alias("module"), (F.col("l_partkey") % 3 != 0).alias("same"), (F.col("l_partkey") % 100 + 1).cast("double").alias("size"))
    return diverge.first_divergent(rows, ["l_orderkey"], "module", "same", "size")


@query("""
with b as (select o_orderkey, o_orderstatus as status, o_orderpriority as priority, case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as status2, case when o_orderkey % 4 = 0 then null else o_orderpriority end as priority2 from orders)
select o_orderkey, list_filter([case when status is distinct from status2 then 'status' end, case when priority is distinct from priority2 then 'priority' end], lambda x: x is not null) as changed from b""")
def struct_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I11."""
    s, p, k = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    changed = diverge.changed_fields([("status", s), ("priority", p)], [("status", F.when(k % 9 == 0, "X").otherwise(s)), ("priority", F.when(k % 4 != 0, p))])
    return table(spark, sf_dir, "orders").select("o_orderkey", changed.alias("changed"))


@query("""
with e as (select doc_id, sha256(text) as sha, n_chars from documents where doc_id % 83 <> 0), o as (select doc_id, case when doc_id % 45 = 0 then sha256('') else sha256(text) end as sha, case when doc_id % 35 = 0 then 0 else n_chars end as n_chars from documents where doc_id % 71 <> 0)
select coalesce(e.doc_id, o.doc_id) as doc_id, case when o.doc_id is null then 'missing' when e.doc_id is null then 'unexpected' when e.n_chars is distinct from o.n_chars then 'size' else 'hash' end as issue
from e full join o on e.doc_id = o.doc_id where o.doc_id is null or e.doc_id is null or e.n_chars is distinct from o.n_chars or e.sha is distinct from o.sha""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12."""
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    expected = docs.where("doc_id % 83 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"), "n_chars")
    observed = docs.where("doc_id % 71 <> 0").select("doc_id", F.when(i % 45 == 0, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256)).alias("sha"), F.when(i % 35 == 0, 0).otherwise(F.col("n_chars")).alias("n_chars"))
    return gates.manifest_diff(expected, observed, "doc_id", [("n_chars", "size"), ("sha", "hash")])


GATES_SQL = """g as (
  select source, unnest(['volume', 'languages', 'length']) as gate, unnest([count(*) >= 50, count(distinct lang) = 4, max(n_chars) < 15000]) as passed from documents group by source)"""


def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") >= 50).alias("volume"), (F.count_distinct("lang") == 4).alias("languages"), (F.max("n_chars") < 15000).alias("length"))
    return s


@query(f"with {GATES_SQL} select source, coalesce(bool_and(passed), false) as eligible, coalesce(list_sort(list(gate) filter (not coalesce(passed, false))), []) as blockers from g group by source")
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is eligible if all of its requirements hold."""
    rows = gate_rows(spark, sf_dir).select("source", F.inline(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("passed")) for g in ("volume", "languages", "length")))))
    return gates.requirements(rows, ["source"], "gate", "passed")


@query("select source, case when not count(*) >= 50 then 'too_few' when not count(distinct lang) = 4 then 'one_sided' when not max(n_chars) < 15000 then 'too_long' else 'qualified' end as class from documents group by source")
def priority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that fails decides."""
    return gate_rows(spark, sf_dir).select("source", gates.first_failure([("too_few", F.col("volume")), ("one_sided", F.col("languages")), ("too_long", F.col("length"))], "qualified").alias("class"))


@query("select s_suppkey, s_acctbal::double as value, (s_nationkey * 400)::double as cap, round(s_acctbal::double / nullif((s_nationkey * 400)::double, 0), 9) as used, s_acctbal::double <= (s_nationkey * 400)::double as within from supplier")
def resource_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E26, E37."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("value"), (F.col("s_nationkey") * 400).cast("double").alias("cap"))
    return gates.within_caps(rows, "value", "cap")


@query("""
with d as (select vec_id, max(abs(x)) as most, sum(abs(x)::decimal(38,15))::double / count(*) as mean, sqrt(sum((x * x)::decimal(38,15))::double / count(*)) as rms from (select vec_id, unnest(embedding)::double as x from embeddings) group by vec_id)
select vec_id, mean <= rms + 1e-9 and rms <= most + 1e-9 as consistent from d""")
def delta_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean <= rms <= max within a tolerance."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    total = lambda c: F.sum(c.cast("decimal(38,15)")).cast("double") / F.count("*")
    s = x.groupBy("vec_id").agg(F.max(F.abs("x")).alias("most"), total(F.abs("x")).alias("mean"), F.sqrt(total(F.col("x") * F.col("x"))).alias("rms"))
    return s.select("vec_id", ((F.col("mean") <= F.col("rms") + 1e-9) & (F.col("rms") <= F.col("most") + 1e-9)).alias("consistent"))


@query("select label, count(*)::bigint as tensors, sum(len(embedding))::bigint as elements, sum(len(embedding) * 4)::bigint as bytes from embeddings group by label")
def inventory_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E34, I21."""
    n = geometry.product(F.array(F.size("embedding")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("tensors"), F.sum(n).alias("elements"), F.sum(n * 4).alias("bytes"))


@query("select vec_id, count(*) filter ((x * 3)::float <> y)::bigint as mismatches from (select vec_id, unnest(embedding) as x, unnest(list_transform(embedding, lambda v: case when v > 0.2 then 0::float else (v * 3)::float end)) as y from embeddings) group by vec_id")
def float32_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products rounded to single precision against what was recorded."""
    e = table(spark, sf_dir, "embeddings")
    cells = e.select("vec_id", F.inline(F.arrays_zip(F.col("embedding").alias("x"), F.transform("embedding", lambda v: F.when(v > 0.2, F.lit(0).cast("float")).otherwise((v * 3).cast("float"))).alias("y"))))
    return cells.groupBy("vec_id").agg(F.count_if((F.col("x") * 3).cast("float") != F.col("y")).alias("mismatches"))


@query("""
with t as (select conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') as line from conversations)
select conv_id, count(*)::bigint as turns, sha256(string_agg(line, chr(10) order by turn, line)) as rendered from t group by conv_id""")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return generate.render_chat(table(spark, sf_dir, "conversations"), "conv_id").withColumn("rendered", F.sha2("rendered", 256))


@query("""
with t as (select conv_id, turn, role, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w)) as ids from conversations), c as (select conv_id, turn, role, len(ids) as n, 20 as prompt from t)
select conv_id, turn, least(n, 64)::bigint as kept, greatest(0, least(n, 64) - prompt)::bigint as trained, greatest(0, 64 - n)::bigint as padded from c""")
def loss_mask_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of 64 labels with a prompt of 20."""
    ids = F.transform(tokens(F.col("text")), lambda w: F.length(w))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids")).withColumn("mask", generate.loss_mask(F.col("ids"), F.lit(20), 64, -1))
    count = lambda f: F.size(F.filter("mask", f)).cast("long")
    return t.select("conv_id", "turn", count(lambda x: x != -1).alias("kept"), count(lambda x: x >= 0).alias("trained"), count(lambda x: x == -1).alias("padded"))


@query("select conv_id, turn, sha256(array_to_string(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: length(w)::varchar), ',')) as digest from conversations")
def token_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5."""
    ids = F.transform(tokens(F.col("text")), lambda w: F.length(w))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", identity.token_digest(ids).alias("digest"))


@query("select n_name as family, r_name as subject, 'Ask ' || n_name || ' about ' || r_name as instruction, case when n_nationkey < 16 then 'train' else 'validation' end as split from nation, region")
def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as families, regions as subjects."""
    families = table(spark, sf_dir, "nation").select(F.col("n_name").alias("family"), F.col("n_nationkey").alias("ordinal"))
    return generate.expand_templates(families, table(spark, sf_dir, "region").select(F.col("r_name").alias("subject")), "Ask {family} about {subject}", 16).select("family", "subject", "instruction", "split")


@query("""
with v(variant) as (values ('clean'), ('hard_negative')), r as (select r_regionkey, n_nationkey, variant, n_name || ':' || variant as candidate, n_name as instruction from nation join region on n_regionkey = r_regionkey, v)
select r_regionkey, n_nationkey, variant, sha256('candidate:v1' || chr(0) || candidate || chr(10)) as candidate_id, sha256('instruction:v1' || chr(0) || instruction || chr(10)) as instruction_id from r""")
def hard_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of pairs with content identities: variants share the instruction's, not the candidate's."""
    grid = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("variant", F.explode(F.array(F.lit("clean"), F.lit("hard_negative"))))
    made = generate.with_content_ids(grid, {"candidate": F.concat("n_name", F.lit(":"), "variant"), "instruction": F.col("n_name")})
    return made.select("r_regionkey", "n_nationkey", "variant", "candidate_id", "instruction_id")


@query("""
select event_id, list_sort(list_filter(json_keys(props), lambda x: x <> 'k')) as unknown, not list_contains(json_keys(props), 'k') as missing, json_type(props, '$.k') in ('UBIGINT', 'BIGINT') as strict_integer from events""")
def props_strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-world check of a JSON column."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", rules.unknown_fields(F.col("props"), ["k"]).alias("unknown"), (F.size(rules.missing_fields(F.col("props"), ["k"])) > 0).alias("missing"), rules.is_strict_integer(v, "$.k").alias("strict_integer"))


DOCUMENT_RULES_SQL = "case when text is null or text = '' then 'EMPTY_TEXT' when lang not in ('de', 'en', 'fr') then 'UNKNOWN_LANGUAGE' when n_chars > 10000 then 'TOO_LONG' when contains(text, '%%%') then 'FORBIDDEN_MARK' when source = 'src7' then 'UNKNOWN_SOURCE' end"


@query(f"select doc_id, c as code, case c when 'EMPTY_TEXT' then '$.text' when 'UNKNOWN_LANGUAGE' then '$.lang' when 'TOO_LONG' then '$.n_chars' when 'FORBIDDEN_MARK' then '$.text' when 'UNKNOWN_SOURCE' then '$.source' end as location from (select doc_id, {DOCUMENT_RULES_SQL} as c from documents)")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules, first offence."""
    return rules.first_violation(table(spark, sf_dir, "documents"), "doc_id", document_rules())


@query("""
with r as (select doc_id, unnest([0, 1, 2, 3, 4]) as ordinal, unnest(['EMPTY_TEXT', 'UNKNOWN_LANGUAGE', 'TOO_LONG', 'FORBIDDEN_MARK', 'UNKNOWN_SOURCE']) as code, unnest(['$.text', '$.lang', '$.n_chars', '$.text', '$.source']) as location,
  unnest([coalesce(text, '') = '', lang not in ('de', 'en', 'fr'), n_chars > 10000, contains(text, '%%%'), source = 'src7']) as broken from documents)
select doc_id, ordinal, code, location from r where broken""")
def all_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken rule."""
    return rules.violations(table(spark, sf_dir, "documents"), "doc_id", document_rules())


def document_rules() -> list[rules.Rule]:
    return [
        ("EMPTY_TEXT", "$.text", F.coalesce("text", F.lit("")) == ""), ("UNKNOWN_LANGUAGE", "$.lang", ~F.col("lang").isin("de", "en", "fr")),
        ("TOO_LONG", "$.n_chars", F.col("n_chars") > 10000), ("FORBIDDEN_MARK", "$.text", F.contains("text", F.lit("%%%"))), ("UNKNOWN_SOURCE", "$.source", F.col("source") == "src7"),
    ]


@query(r"""
with p as (select page_id, regexp_replace(url, '^https?://[^/]*/', '') as path from pages)
select page_id, path = '' or contains(path, '\') or regexp_matches(path, '^[A-Za-z]:') or len(list_filter(string_split(path, '/'), lambda x: x in ('', '.', '..'))) > 0 as unsafe from p""")
def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C22."""
    path = F.regexp_replace("url", "^https?://[^/]*/", "")
    return table(spark, sf_dir, "pages").select("page_id", rules.unsafe_path(path).alias("unsafe"))


#: Two versions of a nested document made from an event's columns, in SQL that both engines read.
VERSIONS_SQL = """
  select event_id,
    concat('{"kind":"', event_type, '","who":{"user":', user_id, ',"tags":["', event_type, '",', user_id % 3, ',{"deep":[null,', user_id % 2, ']}]},"cents":', cast(round(value * 100) as bigint), ',"props":', props, '}') as before,
    concat('{"who":{"tags":["', event_type, '",', case when event_type = 'error' then '7,' else '' end, user_id % 3, '.0,{"deep":[null,', case when value > 50 then 'true' else cast(user_id % 2 as varchar(9)) end, ']}],"user":', user_id + case when user_id > 40 then 1 else 0 end, '}, "kind" : "', event_type, '"',
      case when event_type = 'purchase' then ',"paid":{"by":"card"}' else concat(',"cents":', cast(round(value * 100) as bigint)) end, ',"props":', case when value < 5 then '[]' else props end, '}') as after
  from events
"""


@query(rf"""
with v as ({VERSIONS_SQL}), l as (select event_id, t.fullkey as k, t.type as ty, t.value as j, t.atom from v, json_tree(v.before) t), r as (select event_id, t.fullkey as k, t.type as ty, t.value as j, t.atom from v, json_tree(v.after) t
), pairs as (
  select coalesce(l.event_id, r.event_id) as event_id, coalesce(l.k, r.k) as path, l.k is null or r.k is null or
    case when l.ty in ('OBJECT', 'ARRAY') or r.ty in ('OBJECT', 'ARRAY') then l.ty <> r.ty or (l.ty = 'ARRAY' and json_array_length(l.j) <> json_array_length(r.j))
      when l.ty in ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') and r.ty in ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')
        then (case l.atom when 'true' then 1 when 'false' then 0 else l.atom::varchar::double end) <> (case r.atom when 'true' then 1 when 'false' then 0 else r.atom::varchar::double end)
      else l.atom::varchar <> r.atom::varchar end as differs
  from l full join r on l.event_id = r.event_id and l.k = r.k
), d as (select * from pairs where differs)
select event_id, path from d where not exists (select 1 from d u where u.event_id = d.event_id and (starts_with(d.path, u.path || '.') or starts_with(d.path, u.path || '[')))""")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two nested documents differ; a list of another length is one path, a key that one lacks has nothing below it."""
    spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), "event_id").createOrReplaceTempView("events")
    return walk.changed_paths(spark.sql(VERSIONS_SQL), "event_id", "before", "after")


@query(rf"""
with v as ({VERSIONS_SQL}), l as (select event_id, t.fullkey as path, t.value::varchar as before from v, json_tree(v.before) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('[]', '{{}}')
), r as (select event_id, t.fullkey as path, t.value::varchar as after from v, json_tree(v.after) t where t.type not in ('OBJECT', 'ARRAY') or t.value::varchar in ('[]', '{{}}'))
select coalesce(l.event_id, r.event_id) as event_id, coalesce(l.path, r.path) as path, before, after, coalesce(l.path, r.path) in ('$.who.user', '$.cents') as allowed
from l full join r on l.event_id = r.event_id and l.path = r.path where before is distinct from after""")
def changed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested documents that changed, against a list of paths that may."""
    spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), "event_id").createOrReplaceTempView("events")
    versions = spark.sql(VERSIONS_SQL)
    return walk.changed_leaves(versions.select("event_id", F.col("before").alias("raw")), versions.select("event_id", F.col("after").alias("raw")), "event_id", "raw", ["$.who.user", "$.cents"])
