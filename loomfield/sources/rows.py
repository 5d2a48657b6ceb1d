"""One text column to many rows: the shape shared by the document kernels, and rows dealt out to them evenly."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of files that are worth a task of a Python kernel, bytes that are its most, and tasks that there may be at least.
_LEAST, _MOST, _TASKS = 4 << 10, 16 << 20, 48
#: Rows of a kernel's result that are sent at once.
FLUSH = 4000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` that come straight from files dealt out evenly; others as they are.

    A kernel's work goes by rows, splits go by bytes and row groups: a compressed table of a million rows may be one
    split, and one task would do all the work.
    """
    if rows.isStreaming:
        return rows
    plan = rows._jdf.queryExecution().optimizedPlan()
    while (name := plan.getClass().getSimpleName()) in ("Project", "Filter", "Generate"):
        plan = plan.children().head()
    if name not in ("LogicalRelation", "DataSourceV2ScanRelation"):
        return rows
    size = int(str(plan.stats().sizeInBytes()))
    tasks = min(size // _LEAST, max(_TASKS, 4 * rows.sparkSession.sparkContext.defaultParallelism, size // _MOST))
    return rows.repartition(tasks) if tasks > 1 else rows


def explode_text(rows: DataFrame, key: str, column: str, kernel: Callable[[object], Iterable[dict]], ddl: str) -> DataFrame:
    """(key, fields of ``ddl``, error): a row for each dictionary the kernel yields; a failure is one row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = spread(rows.select(F.col(f"`{key}`"), F.col(f"`{column}`").alias("__in")))
    schema = T.StructType([slim.schema[0], *T.StructType.fromDDL(ddl).fields, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        names = arrow.names[1:]

        def sent(keys: pa.Array, take: list[int], out: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys.take(pa.array(take, pa.int64())), *(pa.array(out[n], arrow.field(n).type) for n in names)], schema=arrow)

        for batch in batches:
            take, out = [], {n: [] for n in names}
            for k, value in enumerate(batch.column(1)):
                try:
                    found = list(kernel(value)) if (value := value.as_py()) is not None else []
                except Exception as e:  # the row's result, not the job's end
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                for row in found:
                    take.append(k)
                    for n in names:
                        out[n].append(row.get(n))
                if len(take) >= FLUSH:
                    yield sent(batch.column(0), take, out)
                    take, out = [], {n: [] for n in names}
            yield sent(batch.column(0), take, out)

    return slim.mapInArrow(run, schema)
