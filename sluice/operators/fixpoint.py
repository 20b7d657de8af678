"""Recursive relations as a semi-naive fixpoint.

Every round applies the step to the rows that the round before added, not to all
of them.  UNION keeps only rows that no round had yet, by a null-safe anti join
with all of them; UNION ALL goes on until a round adds nothing.  A round's rows
are written to the shared folder, which cuts the lineage: round 1,000 costs as
much to plan as round 1.  While all rows together are few (``FEW``) they are
held as local rows instead, so a long chain of small rounds writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import FlowError
from sluice.sources import scratch

#: Rows that are held on the driver; rounds after which seen rows are put together; and rounds at most.
FEW, GATHER, MOST_ROUNDS = 10_000, 16, 100_000


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool) -> DataFrame:
    """All rows of ``base`` and of ``step`` applied again and again."""
    spark = base.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema])  # a step may add nulls
    folder = scratch.folder(spark)

    def typed(df: DataFrame) -> DataFrame:
        if len(df.columns) != len(schema):
            raise FlowError(f"recursion: {len(df.columns)} columns after {len(schema)}")
        return df.toDF(*schema.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

    held = base.limit(0).toArrow()
    kind = pa.schema([f.with_nullable(True) for f in held.schema])
    held = held.cast(kind)
    known: set[str] = set()
    parts: list[DataFrame] = []
    new = base.distinct() if distinct else base
    for no in range(MOST_ROUNDS):
        if not parts:  # so far everything fits on the driver
            rows = new.limit(FEW - held.num_rows + 1).toArrow().cast(kind)
            if held.num_rows + rows.num_rows <= FEW:
                if distinct:
                    fresh = {k: i for i, r in enumerate(rows.to_pylist()) if (k := repr(r)) not in known}
                    known |= fresh.keys()
                    rows = rows.take(pa.array(fresh.values(), pa.int64()))
                if not rows.num_rows:
                    return spark.createDataFrame(held, schema)
                held = pa.concat_tables([held, rows])
                new = typed(step(F.broadcast(spark.createDataFrame(rows, schema))))  # FEW rows at most
                continue
            parts = [scratch.stored(spark.createDataFrame(held, schema), f"{folder}/held")]
        if distinct:
            new = new.subtract(reduce(DataFrame.union, parts))
        added = scratch.stored(new, f"{folder}/round-{no}")
        if added.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(added)
        if len(parts) > GATHER:
            parts = [scratch.stored(reduce(DataFrame.union, parts), f"{folder}/upto-{no}")]
        new = typed(step(added))
    raise FlowError(f"recursion does not end within {MOST_ROUNDS} rounds")
