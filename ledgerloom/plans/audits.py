"""Audit queries on the driver tables: records are documents, the frozen evaluation is benchmark, families are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import audit
from .registry import query, table

SPLIT_SQL = "case doc_id % 10 when 8 then 'validation' when 9 then 'eval' else 'train' end"
TOKENS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", audit.split_of(F.col("doc_id")))


@query(f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, sha256(array_to_string(t, ' ')) as normal_sha from (select doc_id, {TOKENS_SQL} as t from documents)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7, I8."""
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(text.token_set(F.col("text"))).cast("long").alias("n_distinct"), F.sha2(text.normalized(F.col("text")), 256).alias("normal_sha"))


@query(f"""
select doc_id, previous from (
  select doc_id, first_value(doc_id) over w as previous, row_number() over w as k
  from (select doc_id, array_to_string({TOKENS_SQL}, ' ') as n from documents) window w as (partition by n order by doc_id)
) where k > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    return audit.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "doc_id", "text").select("doc_id", "previous")


JACCARD_SQL = f"""
with d as (select doc_id, list_distinct({TOKENS_SQL}) as t from documents),
b as (select item_id, list_distinct({TOKENS_SQL}) as t from benchmark),
s as (
  select doc_id, item_id, dn, bn, count(*) as shared
  from (select doc_id, len(t) as dn, unnest(t) as token from d) join (select item_id, len(t) as bn, unnest(t) as token from b) using (token) group by all
), j as (
  select doc_id, item_id, shared::bigint as shared, shared::double / (dn + bn - shared)::double as jaccard from s
  union all select doc_id, item_id, 0, 1.0 from d, b where len(d.t) = 0 and len(b.t) = 0
)"""


@query(JACCARD_SQL + " select * from j")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, zeros left out."""
    return audit.similar_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id").select("doc_id", "item_id", "shared", "jaccard")


@query(JACCARD_SQL + " select item_id, max(jaccard) as max_jaccard, count(*) filter (jaccard > 0.5)::bigint as over_half from j group by item_id")
def jaccard_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the closest document of each item."""
    return audit.similarity_summary(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id", [0.5]).withColumnRenamed("over_0", "over_half")


@query(f"""
with d as (select doc_id, {SPLIT_SQL} as split, list_distinct({TOKENS_SQL}) as t from documents),
u as (select doc_id, split, len(t) as n, unnest(t) as token from d),
s as (select a.doc_id as a, b.doc_id as b, a.split as split_a, b.split as split_b, a.n as na, b.n as nb, count(*) as shared from u a join u b on a.token = b.token and a.split < b.split group by all)
select a, b, split_a, split_b, shared::double / (na + nb - shared)::double as jaccard from s where shared::double / (na + nb - shared)::double > 0.8""")
def jaccard_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3's gate over all pairs of splits."""
    return audit.pairs_above(records(spark, sf_dir), "doc_id", "split", 0.8)


@query(f"""
with d as (select doc_id, {TOKENS_SQL} as t from documents), b as (select item_id, {TOKENS_SQL} as t from benchmark),
du as (select doc_id, len(list_distinct(t)) as n, unnest(list_distinct(t)) as token from d), bu as (select item_id, len(list_distinct(t)) as n, unnest(list_distinct(t)) as token from b),
j as (select doc_id, item_id, count(*)::double / (any_value(du.n) + any_value(bu.n) - count(*))::double as jaccard from du join bu using (token) group by doc_id, item_id)
select (select count(*) from d)::bigint as documents, (select count(*) from b)::bigint as items, (select max(jaccard) from j) as max_jaccard, (select count(*) from j where jaccard > 0.8)::bigint as pairs_over,
  (select count(*) from (select array_to_string(t, ' ') as n from d) x semi join (select array_to_string(t, ' ') as n from b) y using (n))::bigint as exact""")
def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the frozen benchmark in one row."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    summary = audit.similarity_summary(docs, items, "item_id", [0.8])
    best = summary.agg(F.max("max_jaccard").alias("max_jaccard"), F.coalesce(F.sum("over_0"), F.lit(0)).alias("pairs_over"))
    normal = lambda df: df.select(text.normalized(F.col("text")).alias("n"))
    exact = normal(docs).join(normal(items), "n", "left_semi").agg(F.count("*").alias("exact"))
    return docs.agg(F.count("*").alias("documents")).crossJoin(items.agg(F.count("*").alias("items"))).crossJoin(best).crossJoin(exact)


@query(f"select family, list_sort(list(distinct {SPLIT_SQL})) as splits from (select *, case when n_chars % 9 = 0 then 'f' || (n_chars % 50) else source || '-' || doc_id end as family from documents) group by family having count(distinct {SPLIT_SQL}) > 1")
def family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-1: families of one record each, but for records of some lengths, which share one."""
    shared = F.concat(F.lit("f"), (F.col("n_chars") % 50).cast("string"))
    return audit.crossing(records(spark, sf_dir).withColumn("family", F.when(F.col("n_chars") % 9 == 0, shared).otherwise(F.concat_ws("-", "source", "doc_id"))), "family", "split")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def unmapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    return audit.unmapped(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""
with f as (select doc_id + (doc_id % 7 = 0)::int * 1000000 as doc_id, lang, case when doc_id % 5 = 0 then 'src0' else source end as source from documents)
select f.doc_id, f.lang, f.source, case when d.doc_id is null then ['missing'] else list_filter([case when f.lang is distinct from d.lang then 'lang' end, case when f.source is distinct from d.source then 'source' end], lambda x: x is not null) end as issues
from f left join documents d on f.doc_id = d.doc_id where d.doc_id is null or f.lang is distinct from d.lang or f.source is distinct from d.source""")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 on a manifest made from the documents with every seventh id and every fifth source altered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    manifest = docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 7 == 0, 1000000).otherwise(0)).alias("doc_id"), "lang", F.when(F.col("doc_id") % 5 == 0, "src0").otherwise(F.col("source")).alias("source"))
    return audit.member_check(manifest, docs, "doc_id", ["lang", "source"])


@query(f"select {SPLIT_SQL} as split, lang, count(*)::bigint as n from documents group by all")
def split_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, H-4: counts over the union of the splits, each a table of its own."""
    every = records(spark, sf_dir)
    train, validation, evaluation = (every.where(F.col("split") == s) for s in ("train", "validation", "eval"))
    return train.unionByName(validation).unionByName(evaluation).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("select quality, toxic, count(*)::bigint as n from labels group by all")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5."""
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("select count(*) filter (toxic = 1)::bigint as dangerous, count(*) filter (toxic = 1 and quality = 1)::bigint as dangerous_accepted, count(*) filter (toxic = 1 and quality = 0)::bigint as safe_rejections, count(*) filter (toxic is null or quality is null)::bigint as invalid from labels")
def dangerous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6, E11."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    return table(spark, sf_dir, "labels").agg(F.count_if(toxic).alias("dangerous"), F.count_if(toxic & good).alias("dangerous_accepted"), F.count_if(toxic & (F.col("quality") == 0)).alias("safe_rejections"), F.count_if(F.col("toxic").isNull() | F.col("quality").isNull()).alias("invalid"))


CANONICAL_SQL = "'{\"doc_id\":' || doc_id || ',\"lang\":' || to_json(lang) || ',\"source\":' || to_json(source) || '}'"


@query(f"""
select doc_id, 'sha256:' || sha256({CANONICAL_SQL}) as plain, 'sha256:' || sha256({CANONICAL_SQL} || chr(10)) as with_newline,
  sha256('record:v1' || chr(0) || {CANONICAL_SQL} || chr(10)) as domain, sha256('owner' || chr(0) || lower(trim(source))) as private from documents""")
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four identities of one record."""
    c = identity.canonical_struct(doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", identity.digest(c).alias("plain"), identity.digest(c, newline=True).alias("with_newline"), identity.domain_digest("record:v1", c).alias("domain"), identity.private_digest("owner", F.col("source")).alias("private"))


@query("select item_id, sha1('blob ' || strlen(text) || chr(0) || text) as blob from benchmark")
def git_blob_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4."""
    return table(spark, sf_dir, "benchmark").select("item_id", identity.git_blob_sha1(F.col("text")).alias("blob"))


@query("""
with i as (select doc_id, unnest([{'kind': 'text', 'identity': sha256(text)}, {'kind': 'source', 'identity': sha256(source)}], recursive := true) from documents),
r as (select 'text' as kind, sha256(text) as identity from documents where doc_id % 10 = 9 union select 'source', sha256('src3'))
select doc_id, kind from i semi join r using (kind, identity)""")
def exclusion_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of two kinds against a registry built from the eval split."""
    docs = table(spark, sf_dir, "documents")
    cells = F.array(F.struct(F.lit("text").alias("kind"), F.sha2("text", 256).alias("identity")), F.struct(F.lit("source").alias("kind"), F.sha2("source", 256).alias("identity")))
    registry = docs.where("doc_id % 10 = 9").select(F.lit("text").alias("kind"), F.sha2("text", 256).alias("identity")).union(spark.range(1).select(F.lit("source"), F.sha2(F.lit("src3"), 256)))
    return audit.exclusion_hits(docs.select("doc_id", F.inline(cells)), registry).select("doc_id", "kind")


@query("select kind, list_sort(list(distinct identity)) as identities from (select lang as kind, sha256(source) as identity from documents) group by kind")
def exclusion_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, H-6."""
    from ..operators.generate import exclusion_registry as build

    return build(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.sha2("source", 256).alias("identity")), "kind", "identity")


@query("""
select conv_id, (turn // 2)::bigint as pair, count(*)::bigint as members, list_sort(list_filter(['assistant', 'user'], lambda x: not list_contains(list(distinct role), x))) as missing,
  list_filter([case when count(distinct length(text)) > 1 then 'length' end], lambda x: x is not null) as differing
from conversations group by conv_id, turn // 2""")
def pair_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11 on neighbouring turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("pair"), "role", F.length("text").alias("length"))
    keyed = rows.withColumn("key", F.struct("conv_id", "pair"))
    return audit.pair_integrity(keyed, "key", "role", ["assistant", "user"], ["length"]).select("key.conv_id", "key.pair", "members", "missing", "differing")


@query("""
with m as (select max(doc_id) as most from documents), a as (select doc_id as k, sha256(text) as h from documents, m where doc_id * 10 < most * 9), b as (select doc_id as k, sha256(case when doc_id % 1000 = 321 or (most < 321 and doc_id = 21) then '' else text end) as h from documents, m)
select count(a.h)::bigint as n_before, count(b.h)::bigint as n_after, count(*) filter (a.h is not null and a.h is distinct from b.h)::bigint as n_mismatched, min(k) filter (a.h is not null and a.h is distinct from b.h)::bigint as first_mismatch from a full join b using (k)""")
def prefix_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first nine tenths of the table as its first version, against a second in which one record of each thousand was altered; doc_id is the ordinal."""
    docs = table(spark, sf_dir, "documents")
    most = docs.agg(F.max("doc_id").alias("most"))
    k = F.col("k")
    numbered = docs.select(F.col("doc_id").alias("k"), "text").crossJoin(F.broadcast(most))  # one row
    before = numbered.where(k * 10 < F.col("most") * 9).select("k", F.sha2("text", 256).alias("h"))
    altered = (k % 1000 == 321) | ((F.col("most") < 321) & (k == 21))
    return audit.prefix_mismatch(before, numbered.select("k", F.sha2(F.when(altered, "").otherwise(F.col("text")), 256).alias("h")), "k", "h")


@query("""
with e as (select * from (values ('en', 3), ('de', 4), ('xx', 1)) t(lang, expected)), o as (select lang, count(*) as observed from documents group by lang)
select lang, coalesce(observed, 0)::bigint as observed, coalesce(expected, 0)::bigint as expected from e full join o using (lang) where coalesce(observed, 0) <> coalesce(expected, 0)""")
def distribution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E19."""
    expected = spark.createDataFrame([("en", 3), ("de", 4), ("xx", 1)], "lang string, expected int")
    return audit.distribution_check(table(spark, sf_dir, "documents").select("lang"), expected, ["lang"])


@query("select list_sort(list_filter(['de', 'en', 'it'], lambda x: not list_contains(s, x))) as missing, list_sort(list_filter(s, lambda x: not list_contains(['de', 'en', 'it'], x))) as unexpected from (select list(distinct lang) as s from documents)")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E20, H-3, H-5."""
    return audit.coverage(table(spark, sf_dir, "documents"), "lang", ["de", "en", "it"])


@query("""
with c as (select lang, doc_id // 1000 as chunk, count(*) as n, sha256(string_agg(sha256(text), chr(10) order by doc_id)) as digest from documents group by all)
select lang, sum(n)::bigint as n, sha256(string_agg(digest, chr(10) order by chunk)) as digest from c group by lang""")
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, section 1.4: order-sensitive digests of groups of any size, over digests of a thousand ordinals each."""
    from ..operators.generate import tree_digest

    return tree_digest(table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("h")), ["lang"], "doc_id", "h")


@query("select conv_id, count(*)::bigint as n, sha256(string_agg(sha256(coalesce(text, '')), chr(10) order by turn)) as digest from conversations group by conv_id")
def receipt_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest over the receipts of a conversation's prompts in order."""
    from ..operators.generate import ordered_digest

    return ordered_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), ["conv_id"], "turn", "h")


@query("select kind, identity, (row_number() over (partition by kind order by identity) - 1)::bigint as place from (select distinct lang as kind, sha256(text) as identity from documents)")
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of any size as rows in order."""
    from ..operators.generate import registry_rows as build

    return build(table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.sha2("text", 256).alias("identity")), "kind", "identity")
