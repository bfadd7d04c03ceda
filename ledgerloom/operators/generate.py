"""Dataset generators and chat rendering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import domain_digest


def expand_templates(families: DataFrame, subjects: DataFrame, template: str, first_train: int) -> DataFrame:
    """Every family with every subject; the first ``first_train`` families train, the others validate."""
    grid = families.crossJoin(F.broadcast(subjects))  # a specification grid: both sides are short lists
    text = F.expr(f"replace(replace('{template}', '{{family}}', family), '{{subject}}', subject)")
    return grid.withColumns({"instruction": text, "split": F.when(F.col("ordinal") < first_train, "train").otherwise("validation")})


def family_records(specs: DataFrame, train_families: int, train_variants: int, validation_variants: int, first_family: int = 1) -> DataFrame:
    """One record for each variant of each family, with its ids.

    ``specs``: number (from 0 on, in order), category, place (in its category, from 0 on), description, template, subjects, arguments (map).
    The first ``train_families`` of a category train, the others validate; ``{subject}`` is replaced in template and arguments.
    """
    split = F.when(F.col("place") < train_families, "train").otherwise("validation")
    named = specs.withColumns({"split": split, "family_id": F.format_string("family-%03d", F.col("number") + first_family)})
    variants = F.slice("subjects", F.lit(1), F.when(F.col("split") == "train", train_variants).otherwise(validation_variants))
    rows = named.select("*", F.posexplode(variants).alias("variant", "subject"))
    ids = F.format_string("%s-%s-v%02d", "split", "family_id", F.col("variant") + 1)
    filled = lambda text: F.replace(text, F.lit("{subject}"), F.col("subject"))
    return rows.select(ids.alias("example_id"), "family_id", "split", "category", "description", filled(F.col("template")).alias("instruction"), F.transform_values("arguments", lambda _, v: filled(v)).alias("arguments"), F.concat(F.lit("delivery-"), ids).alias("delivery_id"))


def family_manifest(records: DataFrame) -> DataFrame:
    """One row a family with its example ids in order; a family's variants are few by contract."""
    return records.groupBy("family_id", "split", "category", "description").agg(F.array_sort(F.collect_list("example_id")).alias("example_ids"))


def with_increment(records: DataFrame, more: DataFrame) -> DataFrame:
    """Records of an increment behind those of the version before; families that exist already are left out of it."""
    new = more.join(records.select("family_id").distinct(), "family_id", "left_anti")
    return records.unionByName(new)


def fixture_records(specs: DataFrame, split: str, suffixed: bool, untouched: tuple[str, ...] = ()) -> DataFrame:
    """Numbered records of a fixture; those of a suffixed split say so in the instruction and in every argument but the ``untouched`` ones.

    ``specs``: number (from 1 on), category, instruction, arguments (map).
    """
    text, arguments = F.col("instruction"), F.col("arguments")
    if suffixed:
        text = F.format_string("%s Evaluation case %d.", "instruction", "number")
        arguments = F.transform_values("arguments", lambda k, v: F.when(k.isin(*untouched), v).otherwise(F.concat(v, F.lit("-eval"))))
    return specs.select(F.format_string(f"{split}-%03d", "number").alias("example_id"), F.lit(split).alias("split"), "category", text.alias("instruction"), arguments.alias("arguments"))


def training_grid(seeds: DataFrame, modes: dict[str, tuple[bool, bool]], sentences: dict[str, str], answers: dict[str, str | None], tool: str = "click") -> DataFrame:
    """Every seed in every mode with every disposition: what is shown, and what is to be answered.

    ``seeds``: number, label, bbox (array of four integers).  ``modes``: by name, whether a mode shows the reference and whether it shows
    the box.  ``sentences``: by disposition, the instruction with ``{label}``; ``answers``: by disposition, the reason to give, or null for
    the one that acts.  Both are specification lists; the grid is an explode of theirs, so nothing is joined.
    """
    cells = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(ref).alias("has_ref"), F.lit(box).alias("has_box"), F.lit(d).alias("disposition"), F.lit(sentences[d]).alias("sentence"), F.lit(answers[d]).cast("string").alias("reason")) for m, (ref, box) in modes.items() for d in sentences))
    rows = seeds.select("number", "label", "bbox", F.explode(cells).alias("cell"))
    acts = F.col("cell.reason").isNull()
    ref = F.concat(F.lit("ref-"), F.col("number").cast("string"))
    shown = lambda there, x: F.when(F.col(there), x)
    return rows.select(
        F.concat_ws("-", F.col("number").cast("string"), "cell.mode", "cell.disposition").alias("case_id"), F.col("number").alias("family"), F.col("cell.mode").alias("observation_mode"), "cell.disposition",
        F.replace("cell.sentence", F.lit("{label}"), "label").alias("instruction"), shown("cell.has_ref", ref).alias("cue_ref"), shown("cell.has_box", F.col("bbox")).alias("cue_bbox"),
        F.when(acts, tool).alias("tool"), F.when(acts, shown("cell.has_ref", ref)).alias("ref"), F.when(acts, shown("cell.has_box", F.col("bbox"))).alias("bbox"), "cell.reason",
    )


def hard_negatives(scenes: DataFrame, categories: DataFrame, base: DataFrame, sentence: str) -> DataFrame:
    """For every scene of a category a clean record and a hard negative that differ in the candidate alone.

    ``scenes``: category_id, scene_id, split.  ``categories``: category_id, overrides (map of the fields that the category changes), clean and
    negative (structs of disposition, tool and target; a null target names none).  ``base``: one row with the map ``observation`` that
    every scene starts from.  ``sentence``: the instruction with ``{category}`` and ``{scene}``.
    """
    told = scenes.join(categories, "category_id").crossJoin(F.broadcast(base))  # base is one row
    kept = F.map_filter("observation", lambda field, _: ~F.map_contains_key("overrides", field))
    variants = F.array(*(F.struct(F.lit(name).alias("variant"), F.col(candidate).alias("candidate"), F.lit(verdict).alias("verdict")) for name, candidate, verdict in (("clean", "clean", "accept"), ("hard_negative", "negative", "reject"))))
    rows = told.select("category_id", "scene_id", "split", F.map_concat(kept, "overrides").alias("observation"), F.inline(variants))
    instruction = F.replace(F.replace(F.lit(sentence), F.lit("{category}"), "category_id"), F.lit("{scene}"), "scene_id")
    target = F.when(F.col("candidate.target").isNotNull(), F.concat("scene_id", F.lit("/"), "candidate.target"))
    return rows.select("category_id", "scene_id", "split", "variant", instruction.alias("instruction"), "observation", "candidate.disposition", "candidate.tool", target.alias("target_ref"), "verdict", F.when(F.col("verdict") == "accept", "sound").otherwise(F.col("category_id")).alias("reason_code"))


def seeded_order(records: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """E33 for groups of any size: the place (from 0 on) of each record of a group in an order that the seed shuffles.

    Records stand by the SHA-256 of seed and key.  Places are counted by the digest's first byte before they are within
    one, so no window holds more than about a 256th of a group.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = records.select(group, key, digest.alias("__digest")).withColumn("__head", F.substring("__digest", 1, 2))
    before = Window.partitionBy(group).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(group, "__head").agg(F.count("*").alias("__n")).select(F.col(group).alias("__group"), F.col("__head").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(group, "__head").orderBy("__digest", key)) - 1
    placed = rows.withColumn("__own", own).join(heads, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__head") == F.col("__of")))
    return placed.select(group, key, (F.col("__before") + F.col("__own")).alias("place"))


def render_chat(turns: DataFrame, key: str, order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of a conversation in order, as ``role: text`` lines, with its turn count."""
    line = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return turns.groupBy(key).agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("rendered"))


def loss_mask(tokens: Column, prompt_length: Column, most: int, pad: int) -> Column:
    """Labels of a padded, truncated sequence: -100 on the prompt and on the padding."""
    cut = F.slice(tokens, 1, most)
    labels = F.transform(cut, lambda x, i: F.when(i < prompt_length, F.lit(-100)).otherwise(x))
    return F.concat(labels, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(most) - F.size(tokens))))


def with_content_ids(records: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """One domain-separated identity for each kind of content."""
    return records.withColumns({f"{kind}_id": domain_digest(f"{kind}:v1", canonical) for kind, canonical in kinds.items()})


def ordered_digest(rows: DataFrame, group: list[str], order: str, digest: str) -> DataFrame:
    """J8, section 1.4: the digest of a group's digests in order (null ones left out; null if none is left).

    A group is sorted (on disk where it must be) and hashed in passing, so no row or task holds all its digests.
    """
    chosen = rows.select(*group, order, F.col(digest).alias("__digest"))
    ordered = chosen.repartition(*group).sortWithinPartitions(*group, order, "__digest").select(*group, "__digest")
    keys = ordered.select(*group)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in keys.dtypes), "n long", "digest string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, state, held = None, 0, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*held, pa.array([n], pa.int64()), pa.array([state and state.hexdigest()], pa.string())], names=[*group, "n", "digest"])

        for batch in batches:
            columns = batch.columns
            for k, (*own, d) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if held is None or own != key:
                    if held is not None:
                        yield done()
                    key, n, state, held = own, 0, None, [c.slice(k, 1) for c in columns[:-1]]
                n += 1
                if d is not None:
                    if state is None:
                        state = hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(d.encode())
        if held is not None:
            yield done()

    return ordered.mapInArrow(run, schema)


def chunk_digests(rows: DataFrame, group: list[str], order: str, digest: str, chunk: int) -> DataFrame:
    """The digest of each run of ``chunk`` ordinals of a group, in order: group, chunk, n, digest.

    Rows without a digest are counted and left out.  The order column is an integer; a chunk is at most ``chunk`` ordinals.
    """
    place = F.floor(F.col(order) / chunk).cast("long")
    one = F.array_sort(F.collect_list(F.when(F.col(digest).isNotNull(), F.struct(F.col(order).alias("o"), F.col(digest).alias("d")))))
    return rows.groupBy(*group, place.alias("chunk")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(one, lambda x: x["d"]), "\n"), 256).alias("digest"))


def tree_digest(rows: DataFrame, group: list[str], order: str, digest: str, chunk: int = 1000) -> DataFrame:
    """J8 for groups of any size: one digest a group over the digests of its chunks in order.

    A Merkle tree with ``chunk`` children a node: while a group has chunk numbers of ``chunk`` or more, its chunks
    are folded once more, so no row ever holds more than ``chunk`` digests.  A group's digest depends on its own rows
    alone; one of up to ``chunk ** 2`` ordinals has two levels.
    """
    chunks = chunk_digests(rows, group, order, digest, chunk)
    parts = F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("o"), F.col("digest").alias("d"))))
    joined = F.sha2(F.array_join(F.transform(parts, lambda x: x["d"]), "\n"), 256).alias("digest")
    top = rows.agg(F.max(F.floor(F.col(order) / chunk))).first()[0] or 0
    while top >= chunk:
        whole = chunks.groupBy(*group).agg(F.max("chunk").alias("__top")).withColumnsRenamed({g: f"__{g}" for g in group})
        same = F.lit(True)
        for g in group:
            same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
        told = chunks.join(whole, same).select(*group, F.when(F.col("__top") >= chunk, F.floor(F.col("chunk") / chunk)).otherwise(F.col("chunk")).alias("__node"), (F.col("__top") >= chunk).alias("__deep"), "chunk", "n", "digest")
        folded = told.where("__deep").groupBy(*group, "__node").agg(F.sum("n").alias("n"), joined)
        chunks = folded.withColumnRenamed("__node", "chunk").select(*group, "chunk", "n", "digest").unionByName(told.where(~F.col("__deep")).select(*group, "chunk", "n", "digest"))
        top //= chunk
    return chunks.groupBy(*group).agg(F.sum("n").alias("n"), joined)


def registry_rows(identities: DataFrame, kind: str, value: str) -> DataFrame:
    """J9, H-6: distinct identities of each kind in order, one row each with its place (from 0 on).

    Places are counted by the leading byte of the identity first, so no kind's whole list is in one task.
    """
    head = F.substring(value, 1, 2)
    once = identities.select(kind, value, head.alias("__head")).distinct()
    before = Window.partitionBy(kind).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)
    heads = once.groupBy(kind, "__head").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(kind, "__head").orderBy(value)) - 1
    return once.withColumn("__own", own).join(heads, [kind, "__head"]).select(kind, value, (F.col("__before") + F.col("__own")).alias("place"))


def exclusion_registry(identities: DataFrame, kind: str, value: str) -> DataFrame:
    """J9, H-6: distinct identities of each kind as sorted lists, for registries that are documents; see :func:`registry_rows` for large ones."""
    return identities.groupBy(kind).agg(F.array_sort(F.collect_set(value)).alias("identities"))
