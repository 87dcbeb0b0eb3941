"""Maps over documents with functions of one's own, for what Spark's functions can't say (external taggers, say)."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..workers import map_arrow


class StopProcessing(Exception):
    """Raised by a function to fail the whole map; any other exception makes its document invalid."""


class SkipDocument(Exception):
    """Raised by a function to leave a document out (needs allow_skip)."""


@dataclass
class MapPlan:
    """A function on documents and its life cycle in a worker.

    process(state, doc: dict) returns a dict of the output columns; process_batch(state, docs) takes many at a time.
    set_up() runs once in each task and gives the state; tear_down(state) ends it.
    """

    name: str
    output: str  # payload columns as a DDL string
    process: Callable | None = None
    process_batch: Callable | None = None
    set_up: Callable = lambda: None
    tear_down: Callable = lambda state: None
    batch_docs: int = 100
    allow_skip: bool = False


def map_documents(corpus: DataFrame, plan: MapPlan) -> DataFrame:
    """The corpus mapped by plan: same archive, doc_name and doc_ord; the payload is the plan's.

    Invalid documents pass through with null payload. A document whose function raises becomes invalid, with the
    traceback; StopProcessing fails the task.
    """
    keys = ["archive", "doc_name", "doc_ord"]
    schema = f"archive string, doc_name string, doc_ord bigint, {plan.output}, error struct<module_name:string,error_info:string>"
    columns = corpus.limit(0).selectExpr("1").sparkSession.createDataFrame([], schema).columns[3:-1]

    def one(state, doc: dict) -> dict | None:
        try:
            return dict(plan.process(state, doc)) | {"error": None}
        except StopProcessing:
            raise
        except SkipDocument:
            if not plan.allow_skip:
                raise
            return None
        except Exception:
            return {"error": {"module_name": plan.name, "error_info": traceback.format_exc()}}

    def many(state, docs: list[dict]) -> list[dict | None]:
        if plan.process_batch is None:
            return [one(state, d) for d in docs]
        try:
            return [dict(r) | {"error": None} for r in plan.process_batch(state, docs)]
        except StopProcessing:
            raise
        except Exception:
            if plan.process is not None:
                return [one(state, d) for d in docs]
            return [{"error": {"module_name": plan.name, "error_info": traceback.format_exc()}}] * len(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = plan.set_up()
        try:
            for batch in batches:
                rows = batch.to_pylist()
                results: list[dict | None] = [None] * len(rows)
                good = [i for i, r in enumerate(rows) if r["error"] is None]
                for at in range(0, len(good), plan.batch_docs):
                    part = good[at : at + plan.batch_docs]
                    for i, r in zip(part, many(state, [rows[i] for i in part]), strict=True):
                        results[i] = r
                out = []
                for i, row in enumerate(rows):
                    r = {"error": row["error"]} if row["error"] is not None else results[i]
                    if r is not None:
                        out.append({k: row[k] for k in keys} | {c: r.get(c) for c in columns} | {"error": r["error"]})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        finally:
            plan.tear_down(state)

    arrow = to_arrow_schema(corpus.sparkSession.createDataFrame([], schema).schema)
    return map_arrow(corpus, run, schema, 1 << 20)


def count_by_status(corpus: DataFrame) -> DataFrame:
    """module_name (null for valid documents), n."""
    return corpus.groupBy(F.col("error.module_name").alias("module_name")).agg(F.count(F.lit(1)).alias("n"))
