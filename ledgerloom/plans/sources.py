"""File, document and sequence queries: files are written from the tables to a shared folder and read again."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import geometry, identity
from ..functions.text import partition_label
from ..operators import diverge, documents, generate, rules
from ..sources import files, sinks
from ..sources.scratch import shared_folder
from .registry import query, table


def written(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The folder in which each row (name, content) now is a file."""
    folder = shared_folder(spark, name)
    sinks.write_files(rows, folder).agg(F.count("*")).collect()
    return folder


def file_name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


@query("""
with f as (select case when item_id % 2 = 0 then 'Item-' else 'item-' end || lpad(item_id::varchar, 6, '0') as name, text from benchmark)
select name, strlen(text)::bigint as bytes, sha256(text) as sha256, (row_number() over (order by lower(name)))::int as place, 'upstream_image_' || lpad((row_number() over (order by lower(name)))::varchar, 3, '0') as label from f""")
def file_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of files in case-folded order, with their running label."""
    k = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.when(k % 2 == 0, "Item-").otherwise("item-"), F.lpad(k.cast("string"), 6, "0")).alias("name"), F.to_binary("text", F.lit("utf-8")).alias("content"))
    return files.receipts(spark, written(spark, rows, "receipts")).select(file_name().alias("name"), "bytes", "sha256", "place", "label")


#: Documents as hex, and what is wrong with them.
FILE_CASES = [(b'{"a": [1, {"b": null}]}', None), (b"", "EMPTY_JSON"), (b'{"a": 1, "a": 2}', "DUPLICATE_JSON_KEY"), (b"[NaN]", "NONFINITE_NUMBER"), (b"{", "MALFORMED_JSON"), (b'{"a": "\xff"}', "MALFORMED_JSON"), (b"[" + b"1," * 200 + b"1]", "INPUT_TOO_LARGE"), (b"{} {}", "MALFORMED_JSON")]


@query(f"""select item_id, code from benchmark join (values {", ".join(f"({k}, {'null' if c is None else repr(c)})" for k, (_, c) in enumerate(FILE_CASES))}) v(k, code) on item_id % {len(FILE_CASES)} = k""")
def json_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A3: what is wrong with each JSON file: size, encoding, strictness."""
    k = F.col("item_id")
    content = F.element_at(F.array(*(F.unhex(F.lit(raw.hex())) for raw, _ in FILE_CASES)), (k % len(FILE_CASES)).cast("int") + 1)
    folder = written(spark, table(spark, sf_dir, "benchmark").select(F.concat(k.cast("string"), F.lit(".json")).alias("name"), content.alias("content")), "json")
    found = files.json_documents(spark, folder, most_bytes=300)
    return found.select(F.regexp_extract(file_name(), "([0-9]+)", 1).cast("long").alias("item_id"), "code")


#: Ids of the vectors of one archive file.
PER_ARCHIVE = 1000


def tensor_file(frame: pd.DataFrame) -> bytes:
    """A tensor file of one label's vectors; label 3 leaves a gap after its second tensor, label 5 has four bytes too many, label 7 a wrong shape."""
    label, at, header, data = int(frame["label"].iloc[0]), 0, {}, b""
    for k, (name, values) in enumerate(sorted(zip(frame["vec_id"], frame["embedding"], strict=True))):
        raw = struct.pack(f"<{len(values)}f", *values)
        header[f"v{name}"] = {"dtype": "F32", "shape": [len(values) // 2 - (label == 7 and k == 0), 2], "data_offsets": [at, at + len(raw)]}
        pad = b"\0" * (4 if label == 3 and k == 1 else 0)
        at, data = at + len(raw) + len(pad), data + raw + pad
    text = json.dumps({"__metadata__": {"format": "x"}, **header}).encode()
    return struct.pack("<Q", len(text)) + text + data + b"\0" * (4 if label == 5 else 0)


def tensor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", F.floor(F.col("vec_id") / PER_ARCHIVE).alias("part"))  # a thousand ids a file at most
    packed = vectors.groupBy("label", "part").applyInPandas(lambda f: pd.DataFrame({"name": [f"label-{f['label'].iloc[0]}-{f['part'].iloc[0]}.safetensors"], "content": [tensor_file(f)]}), "name string, content binary")
    return files.safetensors_headers(spark, written(spark, packed, "tensors"))


@query("""
with p as (select label, vec_id, (row_number() over (partition by label, vec_id // 1000 order by vec_id) - 1) as k, count(*) over (partition by label, vec_id // 1000) as n from embeddings)
select label, 'v' || vec_id as name, 'F32' as dtype, [32 - case when label = 7 and k = 0 then 1 else 0 end, 2]::bigint[] as shape, (k * 256 + case when label = 3 and k > 1 then 4 else 0 end)::bigint as start, 256::bigint as size, (n * 256 + case when label = 3 and n > 1 or label = 5 then 4 else 0 end)::bigint as data_bytes from p""")
def safetensors_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of files that hold each label's vectors; only the headers are read."""
    found = tensor_files(spark, sf_dir)
    return found.select(F.regexp_extract(file_name(), "label-([0-9]+)", 1).cast("int").alias("label"), "name", "dtype", "shape", "start", "size", "data_bytes")


@query("""
with p as (select label, vec_id, (row_number() over (partition by label, vec_id // 1000 order by vec_id) - 1) as k, count(*) over (partition by label, vec_id // 1000) as n from embeddings)
select label, 'v' || vec_id as name, case label when 7 then 'SHAPE_MISMATCH' when 3 then case when n = 2 then 'NOT_EXHAUSTIVE' else 'NOT_CONTIGUOUS' end else 'NOT_EXHAUSTIVE' end as issue from p
where (label = 7 and k = 0) or (label = 3 and (k = 2 or (n = 2 and k = 1))) or (label = 5 and k = n - 1)
union all select label, 'bias', 'MISSING_TENSOR' from (select distinct label, vec_id // 1000 as part from embeddings)""")
def safetensors_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, left-over data, wrong sizes and missing tensors."""
    found = files.safetensors_issues(tensor_files(spark, sf_dir), required=["bias"])
    return found.select(F.regexp_extract(file_name(), "label-([0-9]+)", 1).cast("int").alias("label"), "name", "issue")


def archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    skip = F.when(F.col("vec_id") >= 100, 8).otherwise(0)  # eight bytes that no record covers
    records = e.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("tensor_id"), (F.col("vec_id") * 256 + skip).alias("byte_offset"), F.lit(256).cast("long").alias("byte_length"), (F.col("vec_id") % 2).alias("run_id"), F.when(F.col("vec_id") == 12, 10).otherwise(F.col("vec_id")).alias("semantic_key"))
    return records, n * 256 + 8 + 4


@query("""
with p as (select vec_id, vec_id * 256 + case when vec_id >= 100 then 8 else 0 end as at, (select max(vec_id) from embeddings) as last from embeddings)
select 't' || vec_id as tensor_id, case when vec_id = 100 then 'NOT_CONTIGUOUS' when vec_id = last then 'NOT_EXHAUSTIVE' else 'DUPLICATE_KEY' end as issue from p where vec_id = 100 or vec_id = last or vec_id = 12""")
def archive_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an archive with a gap, data left over, or a key that occurs again."""
    records, total = archive(spark, sf_dir)
    return files.archive_issues(records, total, ["run_id", "semantic_key"])


@F.pandas_udf(BinaryType())
def float_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: struct.pack(f"<{len(v)}f", *v))


@query("select 't' || vec_id as tensor_id, 64::bigint as elements, true as aligned, true as whole, true as finite, true as same_raw, true as same_canonical, true as same_bound from embeddings")
def tensor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in archives of a thousand, read by range; the three digests against those of the vectors in the table."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / PER_ARCHIVE).alias("file"), float_bytes("embedding").alias("raw"))
    parts = F.array_sort(F.collect_list(F.struct("vec_id", F.hex("raw").alias("h"))))
    packed = e.groupBy("file").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("content")).select(F.concat(F.lit("part-"), F.col("file").cast("string"), F.lit(".bin")).alias("name"), "content")
    folder = written(spark, packed, "archive")
    at, size = (F.col("vec_id") % PER_ARCHIVE) * 256, F.lit(256).cast("long")
    records = e.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("tensor_id"), at.alias("byte_offset"), size.alias("byte_length"), F.concat(F.lit(f"{folder}/part-"), F.col("file").cast("string"), F.lit(".bin")).alias("path"))
    eight = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    own = e.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("tensor_id"), F.sha2("raw", 256).alias("__raw"), F.sha2(F.concat(eight(at), eight(size), F.unhex(F.sha2("raw", 256))), 256).alias("__bound"))
    found = files.tensor_records(spark, None, records).join(own, "tensor_id")
    return found.select("tensor_id", "elements", "aligned", "whole", "finite", (F.col("sha256") == F.col("__raw")).alias("same_raw"), (F.col("canonical_sha256") == F.col("__raw")).alias("same_canonical"), (F.col("bound_sha256") == F.col("__bound")).alias("same_bound"))


@query("""select (row_number() over (order by n_nationkey) - 1)::bigint as place, '{"comment":' || case when n_nationkey % 5 = 0 then 'null' else to_json(n_name) end || ',"key":' || n_nationkey || '}' as line from nation""")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines written to a folder all at once, and read again in their order."""
    folder = shared_folder(spark, "lines")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("comment"))
    sinks.write_jsonl(rows.coalesce(1), folder, ["key"])
    lines = spark.read.text(folder).select("value", F.get_json_object("value", "$.key").cast("long").alias("place"))
    return lines.select("place", F.col("value").alias("line"))


@query("""
with r as (select count(*) as n, min(n_name) as first from nation)
select 'canonical' as form, '{"first":' || to_json(first) || ',"n":' || n || '}' as text from r union all select 'pretty', '{' || chr(10) || '  "first" : ' || to_json(first) || ',' || chr(10) || '  "n" : ' || n || chr(10) || '}' from r
union all select 'error', '{"error":{"code":"MALFORMED_JSON","location":"$"}}'""")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as a canonical and an indented text, and the canonical object of an error."""
    report = table(spark, sf_dir, "nation").agg(F.count("*").alias("n"), F.min("n_name").alias("first"))
    texts = []
    for form in ("canonical", "pretty"):
        folder = shared_folder(spark, form)
        sinks.write_report(report, folder, pretty=form == "pretty")
        texts.append(spark.read.text(folder, wholetext=True).select(F.lit(form).alias("form"), F.rtrim(F.regexp_replace("value", r"\n$", "")).alias("text")))
    error = spark.range(1).select(F.lit("error").alias("form"), sinks.error_line(F.lit("MALFORMED_JSON"), F.lit("$")).alias("text"))
    return texts[0].unionByName(texts[1]).unionByName(error)


@query()
def rendered_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic images of boxes, as digests; no SQL encodes images, so tests decode them."""
    k = F.col("s_suppkey")
    box = lambda x, y, colour, stroke: F.struct(x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + 20).cast("int").alias("x2"), (y + 10).cast("int").alias("y2"), F.lit(colour).alias("colour"), F.lit(stroke).alias("stroke"))
    image = sinks.png(F.lit(64), F.lit(48), F.lit(0xF0F0F0), F.array(box(k % 40, k % 30, 0x204080, 0), box(k % 33, k % 21, 0xC02020, 2)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.length(image).alias("bytes"), F.sha2(image, 256).alias("sha256"))


@query("""
with p as (select doc_id, case when doc_id % 4 < 3 then 'version https://example.invalid/v1' || chr(10) || 'oid sha256:' || sha256(text) || chr(10) || 'size ' || n_chars || case when doc_id % 4 = 1 then '' when doc_id % 4 = 2 then 'x' else chr(10) end else text end as t, text, n_chars from documents)
select doc_id, case when doc_id % 4 < 2 then sha256(text) end as oid, case when doc_id % 4 < 2 then n_chars end as size from p""")
def lfs_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pointer stands for; other texts are none."""
    k = F.col("doc_id") % 4
    end = F.when(k == 1, "").when(k == 2, "x").otherwise("\n")
    text = F.when(k < 3, F.concat(F.lit("version https://example.invalid/v1\noid sha256:"), F.sha2("text", 256), F.lit("\nsize "), F.col("n_chars").cast("string"), end)).otherwise(F.col("text"))
    found = files.lfs_pointer(text)
    return table(spark, sf_dir, "documents").select("doc_id", found["oid"].alias("oid"), found["size"].alias("size"))


@query("""select doc_id, path, text from (select doc_id, unnest([{'path': '$.a[0].p', 'text': '/data/' || doc_id, 'on': doc_id % 3 = 0}, {'path': '$.b.q', 'text': 'C:\\x' || doc_id, 'on': doc_id % 3 = 1}], recursive := true) from documents) where "on" """)
def absolute_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves that name an absolute path; addresses, digests, relative paths and documents that are no JSON have none."""
    k = F.col("doc_id")
    text = lambda s: s.cast("string")
    first = F.concat(F.lit('{"a":[{"p":"/data/'), text(k), F.lit('"}],"b":{"q":"https://h/x"}}'))
    second = F.concat(F.lit('{"a":[{"p":"data/x"}],"b":{"q":"C:\\\\x'), text(k), F.lit('","r":"sha256:/x"}}'))
    raw = F.when(k % 3 == 0, first).when(k % 3 == 1, second).otherwise("{broken /x")
    return documents.absolute_paths(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw")


@query("""select doc_id, case doc_id % 7 when 0 then null when 1 then '$.a[1]' when 2 then '$.a' when 3 then '$.f' when 4 then '$' when 5 then '$' when 6 then null end as path from documents""")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place at which two documents differ: values, types, signed zeros, keys, and documents that are none."""
    cases = [('{"a":[1,2]}', '{ "a": [1, 2]}'), ('{"a":[1,2]}', '{"a":[1,3]}'), ('{"a":1}', '{"a":true}'), ('{"f":0.0}', '{"f":-0.0}'), ('{"a":1}', '{"b":1}'), ("{", '{"a":1}'), (None, None)]
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in cases)), (F.col("doc_id") % len(cases)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", documents.first_difference(pick(0), pick(1)).alias("path"))


@query("select p_partkey, 'group ' || (p_partkey % 9) as label from part")
def partition_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label before the first bar."""
    text = F.concat(F.lit("group "), (F.col("p_partkey") % 9).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " | rest | more").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", partition_label(text).alias("label"))


@query("""
with s as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
b as (select conv_id, turn, lpad(printf('%x', strlen(role)), 16, '0') || hex(role) || lpad(printf('%x', strlen(text)), 16, '0') || hex(text) as step from s)
select conv_id, sha256(from_hex(string_agg(step, '' order by turn))) as digest from b group by conv_id""")
def chained_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over a conversation's steps in order, role and text each behind its length in eight bytes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return documents.chained_digest(rows, "conv_id", "turn", "role", "text")


@query("select source, doc_id, (row_number() over (partition by source order by sha256('20260101:' || doc_id), doc_id) - 1)::bigint as place from documents")
def epoch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a seeded order of its source."""
    return generate.seeded_order(table(spark, sf_dir, "documents"), "source", "doc_id", 20260101)


@query("""
with e as (select user_id % 4 as epoch, event_id, (row_number() over (partition by user_id % 4 order by event_id) - 1) + case when event_id % 97 = 5 and user_id % 4 = 1 then 3 else 0 end as place, case when user_id % 4 = 2 and event_id % 50 = 7 then event_id - 1 when user_id % 4 = 3 and event_id % 60 = 1 then -1 else event_id end as k from events),
n as (select count(distinct event_id) as n from events)
select epoch, (n - count(distinct k) filter (k >= 0))::bigint as missing, count(*) filter (k < 0)::bigint as unknown, (count(*) - count(distinct k))::bigint as repeated, count(*) <> count(distinct place) or max(place) <> count(*) - 1 as misplaced from e, n group by epoch, n""")
def epoch_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what an epoch's order leaves out, adds, repeats or misplaces."""
    from pyspark.sql import Window

    e, k, g = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id") % 4
    place = F.row_number().over(Window.partitionBy(g).orderBy("event_id")) - 1 + F.when((k % 97 == 5) & (g == 1), 3).otherwise(0)
    key = F.when((g == 2) & (k % 50 == 7), k - 1).when((g == 3) & (k % 60 == 1), -1).otherwise(k)
    return diverge.epoch_orders(e.select("event_id"), e.select(g.alias("epoch"), place.cast("long").alias("place"), key.alias("event_id")), "event_id", "epoch", "place")


@query("""
with m as (select o_custkey, o_orderkey, o_orderkey % 3 = 0 as same, (o_orderkey % 17 + 1)::double as size from orders), d as (select * from m where not same)
select o_custkey, o_orderkey, round(size / first_value(size) over (partition by o_custkey order by o_orderkey), 9) as growth from d""")
def growth_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every differing stage as a multiple of the first."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (k % 3 == 0).alias("same"), (k % 17 + 1).cast("double").alias("size"))
    return diverge.growth_by_stage(rows, ["o_custkey"], "o_orderkey", "same", "size")


@query("""
with s as (select o_orderkey as k, o_orderkey % 3 as a, o_orderkey % 5 as b, o_orderkey % 7 as c from orders), t as (select k, 10 as elements, case when a = 0 then 0 else 4 end as n_different, case when b = 1 then 3 else 4 end as n_bitwise, case when b = 2 then 11 else 6 end as nonzero, case when c = 0 then 0.0 else 2.0 end as max_delta, case when c = 1 then 1.8 else 0.5 end as mean_delta, case when c = 2 then 2.5 else 1.0 end as rms_delta, case when c = 3 then 2.25 else 0.25 end as witness from s)
select k as o_orderkey, list_filter([case when mean_delta > rms_delta + 1e-9 then 'MEAN_OVER_RMS' end, case when rms_delta > max_delta + 1e-9 then 'RMS_OVER_MAX' end, case when (n_different = 0) <> (max_delta = 0) then 'DELTA_WITHOUT_DIFFERENCE' end, case when n_different > n_bitwise then 'DIFFERENT_OVER_BITWISE' end,
  case when witness > max_delta + 1e-9 then 'WITNESS_OVER_MAX' end, case when n_bitwise > elements or nonzero > elements then 'COUNT_OVER_ELEMENTS' end], lambda x: x is not null) as issues from t""")
def delta_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that delta statistics must keep."""
    k = F.col("o_orderkey")
    a, b, c = k % 3, k % 5, k % 7
    when = lambda cond, x, y: F.when(cond, x).otherwise(y)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(10).alias("elements"), when(a == 0, 0, 4).alias("n_different"), when(b == 1, 3, 4).alias("n_bitwise"), when(b == 2, 11, 6).alias("nonzero"), when(c == 0, 0.0, 2.0).alias("max_delta"), when(c == 1, 1.8, 0.5).alias("mean_delta"), when(c == 2, 2.5, 1.0).alias("rms_delta"), when(c == 3, 2.25, 0.25).alias("witness"))
    return diverge.delta_bounds(rows).select("o_orderkey", "issues")


@query("""
with t as (select ['F32', 'BF16', 'I64'][(vec_id % 3 + 1)::int] as dtype, ['gpu', 'cpu'][(vec_id % 2 + 1)::int] as device, [len(embedding), vec_id % 4 + 1] as shape from embeddings)
select dtype, device, count(*)::bigint as tensors, sum(shape[1] * shape[2])::bigint as elements, sum(shape[1] * shape[2] * case dtype when 'F32' then 4 else 2 end)::bigint as bytes, count(*) filter (shape[2] = 1)::bigint as flat from t where dtype <> 'I64' group by all""")
def tensor_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floating tensors by type and device, elements of their shapes, and how many have a contiguous stride of one element."""
    k = F.col("vec_id")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    rows = table(spark, sf_dir, "embeddings").select(pick(("F32", "BF16", "I64"), k % 3).alias("dtype"), pick(("gpu", "cpu"), k % 2).alias("device"), F.array(F.size("embedding").cast("long"), k % 4 + 1).alias("shape"))
    n, width = geometry.product(F.col("shape")), F.when(F.col("dtype") == "F32", 4).otherwise(2)
    stride = F.get(geometry.contiguous_strides(F.col("shape")), F.lit(0))
    return rows.where(F.col("dtype") != "I64").groupBy("dtype", "device").agg(F.count("*").alias("tensors"), F.sum(n).alias("elements"), F.sum(n * width).alias("bytes"), F.count_if(stride == 1).alias("flat"))


@query("select vec_id, count(*) filter (x = 0)::bigint as zeros, count(*) filter (x < 0 and (x * 1e-30)::float = 0)::bigint as lost from (select vec_id, unnest(list_transform(embedding, lambda v: case when v between -0.1 and 0.1 then 0.0::float else v end)) as x from embeddings) group by vec_id")
def float32_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rounded to single precision with one zero: -0.0 is 0.0, and what is too small stays itself."""
    near = F.transform("embedding", lambda v: geometry.float32(F.when(v.between(-0.1, 0.1), F.when(v < 0, F.lit(-0.0)).otherwise(F.lit(0.0))).otherwise(v)))
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(near).alias("x"))
    zero = F.col("x").cast("string") == "0.0"
    return cells.groupBy("vec_id").agg(F.count_if(zero).alias("zeros"), F.count_if((F.col("x") < 0) & (geometry.float32(F.col("x").cast("double") * 1e-30) == 0)).alias("lost"))


@query("select doc_id, case when doc_id % 3 = 0 then ['x', 'y'] when doc_id % 3 = 1 then ['x'] else [] end as missing, doc_id % 2 = 0 as repeats from documents")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields that a document lacks, and lists with a value twice."""
    k = F.col("doc_id")
    raw = F.when(k % 3 == 0, '{"z":1}').when(k % 3 == 1, '{"y":1}').otherwise('{"x":1,"y":2}')
    values = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "documents").select("doc_id", rules.missing_fields(raw, ["x", "y"]).alias("missing"), rules.has_duplicates(values).alias("repeats"))


@query("select doc_id, sha256('vector' || chr(0) || (doc_id % 5)) as digest from documents")
def private_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped, lower-cased values behind a domain."""
    return table(spark, sf_dir, "documents").select("doc_id", identity.private_digest("vector", F.concat(F.lit("  "), (F.col("doc_id") % 5).cast("string"), F.lit(" "))).alias("digest"))
