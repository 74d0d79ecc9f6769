"""Stages in a fixed order, with isolation.

Row by row: each stage gives a section for every document, and an error where it couldn't; a document
fails in its first stage with an error, keeps the sections before it and has none after.
As jobs: documents with an error leave the run, the others go on to the next stage; a stage that raises
stops it for all that are left. Tables of the stages before stay written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.sources.files import read_table, replace_rows
from lexloom.storage import stored
from lexloom.streaming.jobs import DONE, FAILED, PROCESSING, STAGES

Stage = Callable[[DataFrame], DataFrame]


def merged(docs: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """doc_id, failed_stage, failure_reason and a column for each section, for every document.

    sections: in the order of the stages, doc_id, section and, if it may fail, error. A section after
    the failed stage is null; so is one of a document that the stage has no row for.
    """
    out, failed, reason = docs.select("doc_id"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, df in sections.items():
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        out = out.join(df.select("doc_id", F.col("section").alias(name), error.alias(f"{name}_error")), "doc_id", "left")
        error = F.col(f"{name}_error")
        reason = F.when(failed.isNull(), error).otherwise(reason)
        failed = F.when(failed.isNull() & error.isNotNull(), F.lit(name)).otherwise(failed)
    order = F.array(*map(F.lit, sections))
    out = out.withColumns({"failed_stage": failed, "failure_reason": reason})
    at = F.array_position(order, F.col("failed_stage"))
    return out.select("doc_id", "failed_stage", "failure_reason", *(F.when(F.col("failed_stage").isNull() | (at > k), F.col(n)).alias(n) for k, n in enumerate(sections, 1)))


def run(docs: DataFrame, stages: dict[str, Stage], folder: str, retries: int = 0, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Runs the stages over `docs` in STAGES' order and replaces each one's table in `folder`.

    A stage gets the documents that haven't failed, and gives doc_id, section and, if it may fail for
    some, error. Returns doc_id, status, retry_count, failed_stage, failure_reason. `retries` are the
    attempts that failed before; a failure counts one more, and the last allowed one makes a document
    FAILED. Rows that repeat a doc_id fail together.
    """
    unknown = set(stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    text = lambda x: F.lit(x).cast("string")
    gave_up = FAILED if retries + 1 >= config.max_retries else PROCESSING

    def state(rows: DataFrame, status: str, count: int, failed, reason) -> DataFrame:
        return rows.select("doc_id", text(status).alias("status"), F.lit(count).cast("long").alias("retry_count"), failed.alias("failed_stage"), reason.alias("failure_reason"))

    left, out = docs, []
    for name in (s for s in STAGES if s in stages):
        try:
            replace_rows(stages[name](left), f"{folder}/{name}", keys=left)
            sections = read_table(docs.sparkSession, f"{folder}/{name}")
            if "error" in sections.columns:
                bad = sections.filter("error is not null").groupBy(F.col("doc_id").alias("bad_id")).agg(F.min("error").alias("error"))
                both = stored(left.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left").drop("bad_id").withColumnRenamed("error", "_error"), "stage-left")
                out.append(state(both.filter("_error is not null"), gave_up, retries + 1, text(name), F.col("_error")))
                left = both.filter("_error is null").drop("_error")
        except Exception as e:  # noqa: BLE001 - a stage may fail in any way; the run says where and why
            out.append(state(left, gave_up, retries + 1, text(name), text(str(e).splitlines()[0][:500])))
            break
    else:
        out.append(state(left, DONE, retries, text(None), text(None)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
