"""Running sums, places and next rows within groups by range partitions, without a task per group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import cut, partitions


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """df with `out`: the sum of `size` over the rows of the group up to and with this one, by `order`.

    The rows are sorted over all groups at once by range partitions, so that a group with a third
    of all rows spreads over many tasks; each partition sums its runs, the sums of the partitions
    (at most partitions + groups rows) give each run its offset. `order` should be unique within a
    group, else equal rows come in any order. Null sizes count as 0; null groups are a group. An
    empty table gives an empty one.
    """
    spark = df.sparkSession
    run, pid = f"{out}__run", f"{out}__pid"
    keys = [F.col(c) for c in [*groups, *order]]
    placed = df.repartitionByRange(max(2, partitions(spark)), *keys).sortWithinPartitions(*keys)
    marked = placed.withColumn("__g", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}))
    schema = T.StructType([*df.schema.fields, T.StructField(run, T.LongType()), T.StructField(pid, T.IntegerType()), T.StructField("__g", T.StringType())])
    names = [f.name for f in df.schema.fields]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(b.schema.get_field_index("__g"))
            same = codes.to_pylist()
            v = np.nan_to_num(b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype("float64")).astype("int64")
            c = np.cumsum(v)
            starts = [i for i in range(len(same)) if i == 0 or same[i] != same[i - 1]]
            base = np.zeros(len(v), dtype="int64")
            for k, s in enumerate(starts):
                e = starts[k + 1] if k + 1 < len(starts) else len(v)
                before = c[s - 1] if s else 0
                base[s:e] = (total if s == 0 and same[0] == last else 0) - before
            c = c + base
            last, total = same[-1], int(c[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(c), pa.array(np.full(len(v), part, dtype="int32")), codes], names=[*names, run, pid, "__g"])

    kept = cut(marked.mapInArrow(sums, schema), "prefix")
    ends = kept.groupBy("__g", pid).agg(F.max(run).alias("__sum"))
    before = Window.partitionBy("__g").orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("__g", pid, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    return kept.join(offsets, ["__g", pid]).withColumn(out, F.col(run) + F.col("__before")).select(*names, out)


def placed(df: DataFrame, groups: list[str], order: list[str], place: str = "i", lead: dict[str, str] | None = None, total: str | None = None) -> DataFrame:
    """df with `place`, the 0-based place of a row in its group by `order`; lead: {new: old}, the next row's old as new; total: the group's size.

    As a window over each group would give, but no task sees a whole group: the rows are sorted over all groups at
    once by range partitions, windows run within a partition's part of a group, and only what goes over the partitions' borders is
    joined: each border cuts one group, so there are less than two such parts a partition, which are broadcast. `order`
    holds column names or columns and should be unique within a group, nulls first. Null groups are a group; no groups are one group.
    An empty table gives an empty one.
    """
    lead = lead or {}
    n = max(2, partitions(df.sparkSession))
    keys = [*groups, *order]
    rows = cut(df.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id()), "placed")
    own = Window.partitionBy("__pid", *groups)
    local = own.orderBy(*order)
    here = rows.withColumn("__i", F.row_number().over(local) - 1).withColumns({k: F.lead(c).over(local) for k, c in lead.items()})
    here = here.withColumn("__last", F.lead(F.lit(True)).over(local).isNull())
    if total:
        here = here.withColumn(total, F.count(F.lit(1)).over(own))
    first = F.min_by(F.struct(*lead.values()), F.struct(*order)) if lead else F.lit(None).cast("struct<x:int>")
    parts = rows.groupBy("__pid", *groups).agg(F.count(F.lit(1)).alias("__n"), first.alias("__f"))  # a row a group, and one more a border
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = over.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__next": F.lead("__f").over(over.orderBy("__pid")), "__all": F.sum("__n").over(over)})
    border = F.broadcast(parts.where("__all > __n").select(F.col("__pid").alias("__p"), *[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], "__before", "__next", "__all"))
    same = F.col("__pid") == F.col("__p")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    out = here.join(border, same, "left")
    made = {place: (F.col("__i") + F.coalesce("__before", F.lit(0))).cast("int")}
    made |= {k: F.when(F.col("__last"), F.col("__next")[c]).otherwise(F.col(k)) for k, c in lead.items()}
    if total:
        made[total] = F.coalesce("__all", F.col(total))
    return out.withColumns(made).select(*df.columns, place, *lead, *([total] if total else []))
