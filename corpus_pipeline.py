"""The corpus pipeline: quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

Defined cases, for every stage: a null, empty or blank text fails the quality rules and goes there, so that later stages
meet none here; each of them has its own result for such texts (near_dedup keeps them all, secret_scans leaves them as
they are, packing gives them one piece). Null ids are ids of their own. Copies and repeated rows count as one group, of
which one row stays. A very long text is held whole by the task that has it. An empty table passes as an empty table.
Other columns, whatever their names, are carried along up to the last stage. Secrets are found after near-duplicates, so
documents that differ in their secrets only are judged with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import common, components, neardup, packing, quality, secrets
from vacantia.llm.common import code_print, complete, delete, input_print, is_complete, shared_path
from vacantia.llm.neardup import neardup_stage
from vacantia.llm.packing import packing_stage
from vacantia.llm.quality import quality_stage
from vacantia.llm.secrets import secrets_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", neardup_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: Near-duplicate groups by MinHash and sequences by tokens are beyond SQL; the tests hold them against brute force.
ORACLE_SQL: str | None = None


#: What stages are made of: another state of it makes their results anew.
CODE = (common, components, neardup, packing, quality, secrets)


def run(spark: SparkSession, sf_dir: str, work: str | None = None) -> DataFrame:
    """All stages over documents.

    With `work`, a shared folder, stages that an earlier run has finished there are not run again, if they were made of the
    same files by the same code, and by the same stages before them; else they are. Without, each stage's folder goes when
    the next one is written; the last but one, which the result is read from, stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made_of = f"{input_print(docs)} {code_print(*CODE)}"
    before = None
    for name, stage in STAGES[:-1]:
        path = f"{work}/{name}" if work else shared_path(spark, name)
        made_of = f"{made_of} {name}"
        if not (work and is_complete(spark, path, made_of)):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if work:
                complete(spark, path, made_of)
        docs = spark.read.parquet(path)
        if before and not work:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
