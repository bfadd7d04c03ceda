"""Commands: ``python -m ledgerloom COMMAND FOLDER [OUT]`` on a folder of JSON documents, one a file.

``runs``, ``manifests``, ``router``, ``families``, ``cases``, ``predictions`` and ``consents`` hold every document
against its contract; ``records`` maps run exports to canonical lines below OUT.  The first document in the order of
the paths that breaks its contract is written to stderr as one canonical object, and the status is 2.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import consent, exports, grounding, manifests, reliability, router
from .sources import files, sinks

CONTRACTS = {"families": manifests.family_rules, "cases": grounding.case_rules, "predictions": grounding.prediction_rules, "consents": consent.consent_rules}


def violations(command: str, documents: DataFrame, manifest_digest: str | None) -> DataFrame:
    """path, code and location of every document that breaks its contract; run exports are held to the digest that they state where none is given."""
    if command in ("runs", "records"):
        stated = F.lit(manifest_digest) if manifest_digest else F.get_json_object("text", "$.manifest_digest")
        judged = exports.run_violations(documents.withColumn("stated", stated), "path", "text", "stated")
    elif command == "manifests":
        judged = exports.manifest_violations(documents, "path", "text")
    elif command == "router":
        judged = router.record_violations(documents, "path", "text")
    else:
        judged = grounding.document_violations(documents, ["path"], "text", CONTRACTS[command])
    unread = documents.where("code is not null").select("path", "code", F.lit("$").alias("location"))
    return judged.join(unread.select("path"), "path", "left_anti").where("code is not null").unionByName(unread)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__.split("\n")[0])
    parser.add_argument("command", choices=["runs", "records", "manifests", "router", *CONTRACTS])
    parser.add_argument("folder")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--manifest-digest")
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
    documents = files.json_documents(spark, given.folder)
    worst = violations(given.command, documents, given.manifest_digest).orderBy("path").limit(1).collect()
    if not worst and given.command == "records":
        again = reliability.repeated_runs(documents.select(F.col("text").alias("raw"))).orderBy("run_id").limit(1).collect()
        worst = [{"path": given.folder, "code": "DUPLICATE_DATASET_RUN", "location": "dataset.source.run_id"}] if again else []
    if not worst and documents.limit(1).count() == 0:
        worst = [{"path": given.folder, "code": "EMPTY_DATASET_INPUT", "location": "dataset"}]
    if worst:
        print(json.dumps({"error": {k: worst[0][k] for k in ("code", "location", "path")}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False), file=sys.stderr)
        return 2
    if given.command == "records":
        sinks.write_jsonl(reliability.reliability_records(documents.select(F.col("text").alias("raw"))), given.out, ["record_id"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
