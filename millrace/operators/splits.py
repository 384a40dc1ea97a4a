"""Splits, merges, presets and run configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.ladder import first_of
from millrace.plans.ranges import prefix_sums


def split(df: DataFrame, key: str, share: float = 0.9) -> DataFrame:
    """df with split: the first int(n * share) rows in the order of the key's MD5 are train, the rest val.

    Ranks come from running counts over range partitions, so that no task sorts the whole. The same rows
    give the same split at any parallelism; keys are unique.
    """
    total = df.agg((F.count("*") * F.lit(share)).cast("int").alias("__train"))
    keyed = df.withColumns({"__h": F.md5(F.col(key).cast("string")), "__one": F.lit(1).cast("long"), "__all": F.lit(0)})
    ranked = prefix_sums(keyed, ["__all"], ["__h", key], "__one", "__n").crossJoin(F.broadcast(total))  # one row
    return ranked.withColumn("split", F.when(F.col("__n") <= F.col("__train"), "train").otherwise("val")).drop("__h", "__one", "__all", "__n", "__train")


def merge(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """The rows of all prepared sets with the set's name; their splits stay. Missing sets (None) are passed over."""
    found = [df.withColumn("dataset", F.lit(name)) for name, df in parts if df is not None]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def resolved(df: DataFrame, key: str, sources: list[DataFrame], column: str = "path") -> DataFrame:
    """df with the path from the first source that has the key; rows that none has are dropped."""
    out = df
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(column).alias(f"__{i}")).dropDuplicates([key]), key, "left")
    names = [f"__{i}" for i in range(len(sources))]
    return out.withColumn(column, F.coalesce(*names)).drop(*names).where(F.col(column).isNotNull())


def epochs(n) -> Column:
    return first_of([(n < 20, 20), (n < 50, 15), (n < 100, 10)], 8)


def batch_size(n) -> Column:
    return first_of([(n < 30, 1), (n < 100, 2)], 4)


def training_plan(df: DataFrame, n: str) -> DataFrame:
    """df with epochs, batch, steps an epoch, all steps and warm-up steps for n images."""
    out = df.withColumns({"epochs": epochs(F.col(n)), "batch": batch_size(F.col(n))})
    out = out.withColumn("steps", F.floor(F.col(n) / F.col("batch")).cast("long"))
    out = out.withColumn("max_steps", F.col("steps") * F.col("epochs"))
    return out.withColumn("warmup", (F.col("max_steps") * F.lit(0.1)).cast("long"))


def memory_batch(gb, wanted) -> Column:
    """The batch that a memory size allows, at most the wanted one."""
    return F.least(first_of([(gb > 16, 8), (gb > 10, 6), (gb > 6, 4), (gb > 3, 2)], 1), wanted)


def config_json(**fields) -> Column:
    """A configuration document."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def newest(df: DataFrame, order: str, key: str) -> DataFrame:
    """Rows numbered from the newest on, ties by key."""
    return df.orderBy(F.col(order).desc(), key)


def last_step(done: dict[str, Column]) -> Column:
    """The last step of a list that is done, else none."""
    return first_of([(c, name) for name, c in reversed(done.items())], "none")


def taxonomy_prompt(taxonomy: DataFrame) -> DataFrame:
    """One row: each category with its terms; categories with a leading underscore are left out. taxonomy: category, ord, term."""
    rows = taxonomy.where(~F.startswith("category", F.lit("_"))).groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    return rows.agg(F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit(": "), "terms"))), "\n").alias("prompt"))
