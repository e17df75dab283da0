"""What Python workers hold: small batches, and nothing that is freed."""

import inspect
import os

import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.llm import common as C


def test_workers_get_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 3000, 1, 1).select(F.expr("repeat('x', 4096)").alias("text"))
    got = [r.n for r in C.materialize(docs.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 3000 and max(got) <= C.ARROW_BYTES // 4096
    assert spark.conf.get(name) == before


def test_lean_keeps_results_and_signatures(spark):
    assert list(C.lean(lambda x: iter([x]))(3)) == [3]

    @C.lean
    def run(part: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([part.num_rows], pa.int64()), "pid": pa.array([os.getpid()], pa.int64())})

    assert len(inspect.signature(run).parameters) == 1
    assert [r.n for r in spark.range(7).withColumn("g", F.lit(1)).groupBy("g").applyInArrow(run, "n long, pid long").collect()] == [7]
