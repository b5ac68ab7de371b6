"""row_number within groups of any size: no group has to fit into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

#: Rows of a few numbers and digests that go to a Python worker at a time.
NARROW_ROWS = 20_000


def ranked(scratch: Scratch, name: str, df: DataFrame, group: str, order: list[Column | str], to: str) -> DataFrame:
    """df with a column `to`: 1, 2, ... within each value of `group`, in the given order.

    Rows are dealt by ranges of (group, order, a number of the row), so that a group may spread over many tasks and
    repeated rows do too; each task numbers its sorted rows, and the first group of a task goes on from what tasks
    before it hold of that group. Only these offsets, one a task at most, are broadcast. `group` holds no nulls; rows
    that tie in the order are numbered in any order. The table is written to the shared folder before and after."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW_ROWS))
    rows = scratch.put(f"{name}_rows", df).withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(group), *[F.col(x) if isinstance(x, str) else x for x in order], F.col("_row")]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    numbered = scratch.put(name, dealt.mapInArrow(_numbers(group, to), f"{fields}, _task int, _first boolean, `{to}` bigint"))
    firsts = numbered.filter("_first").select(group).distinct()
    counts = numbered.join(F.broadcast(firsts), group, "left_semi").groupBy(group, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_task", F.sum("_n").over(before).alias("_before"), F.lit(True).alias("_first")).filter("_before > 0")
    scratch.drop(f"{name}_rows")
    joined = numbered.join(F.broadcast(offsets), [group, "_task", "_first"], "left")
    return joined.withColumn(to, F.col(to) + F.coalesce("_before", F.lit(0))).drop("_task", "_first", "_before")


def _numbers(group: str, to: str):
    """Number the sorted rows of a task within each run of equal groups; _first marks the rows of its first run."""

    def run(batches):
        last, count, runs, task = None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(batch.schema.get_field_index(group))
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or values[0].as_py() != last
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            number = np.where(start < 0, count + at + 1, at - start + 1)
            run_no = runs + np.cumsum(new)
            last, count, runs = values[-1].as_py(), int(number[-1]), int(run_no[-1])
            columns = [*batch.columns, pa.array(np.full(len(at), task, np.int32)), pa.array(run_no == 1), pa.array(number.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_task", "_first", to])

    return run
