"""PDFs made from table rows, so that extraction can be compared with the rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.session import BATCHES, with_settings


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows of a narrow table, dealt by key. A small file is one task's, or a few's, however
    many rows it has, and making and reading a document takes far longer than its row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Rows that are turned into Python objects, and bytes of PDFs that are sent on, at a time.
SLICE, BYTES = 64, 1 << 20


def synthesize(rows: DataFrame, make: Callable[[dict], bytes], key: str) -> DataFrame:
    """doc_id, content: one PDF for each row, made from its columns. Rows come in batches
    that are bounded by bytes, and few are held as objects: memory doesn't follow the
    rows of a task."""

    def run(batches):
        for b in batches:
            ids, made, size = [], [], 0
            for k in range(0, b.num_rows, SLICE):
                for r in b.slice(k, SLICE).to_pylist():
                    ids.append(str(r[key]))
                    made.append(make(r))
                    size += len(made[-1])
                    if len(made) == 500 or size >= BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(made, pa.binary())], ["doc_id", "content"])
                        ids, made, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(made, pa.binary())], ["doc_id", "content"])

    return with_settings(rows, BATCHES).mapInArrow(run, "doc_id string, content binary")
