"""Incremental loads driven by saved marks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfunnel.sinks.log import CommitLog
from wayfunnel.sinks.writers import upsert
from wayfunnel.sources.readers import incremental_column, json_table


def load_json(spark: SparkSession, folder: str, table: str, schema: T.StructType, target: str, state: str, keys: Sequence[str],
              source: str = "business", multi_line: bool = True) -> dict[str, Any]:
    """Load what is later than the saved mark, merge it into ``target``, then save the new mark; returns the saved entry.

    Without a mark the full file and all increments are read. The mark is the largest value of the incremental column seen
    while the rows were staged; a load without rows keeps the old one and saves nothing. The entry is created after the data, so a
    job that fails between the two is repeated from the same mark and stores the same rows again. Of two loads at once
    one entry is created; the other load's rows are in the table as well.
    """
    log = CommitLog(spark, f"{state}/{source}.{table}")
    number, entry = log.newest()
    rows = json_table(spark, folder, table, schema, entry["mark"] if entry else None, multi_line)
    column = incremental_column(table, rows.drop("file_time").schema)
    rows = rows.withColumns({"load_seq": F.lit(number + 1), "_row": F.monotonically_increasing_id()})
    seen = Observation(f"load-{uuid.uuid4().hex}")
    newest = F.max(F.col(column).cast("timestamp_ntz")) if column else F.max(F.lit(None).cast("timestamp_ntz"))
    upsert(rows, target, keys, tie=("file_time", "_row"), observed=seen, metrics=[F.count(F.lit(1)).alias("n"), newest.alias("newest")])
    found = seen.get
    mark = found["newest"].strftime("%Y-%m-%dT%H:%M:%S") if found["newest"] else (entry or {}).get("mark")
    after = {"source": source, "table_name": table, "column": column, "mark": mark, "mode": "incremental" if entry else "full", "row_count": found["n"]}
    if found["n"]:
        log.commit(number + 1, after)
        return after
    return entry or after


def saved_marks(spark: SparkSession, state: str, table: str, source: str = "business") -> DataFrame:
    """All saved entries of a table, oldest first; a row for each load."""
    log = CommitLog(spark, f"{state}/{source}.{table}")
    names = ("source", "table_name", "column", "mark", "mode", "row_count")
    rows = [(n, *(entry[c] for c in names)) for n, entry in ((n, log.read(n)) for n in log.numbers())]
    return spark.createDataFrame(rows, "load long, source string, table_name string, column string, mark string, mode string, row_count long")
