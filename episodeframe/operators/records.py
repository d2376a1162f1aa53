"""Nested rows rebuilt: renamed and flattened structs, blocks of steps, enumerated cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def renamed(rows: DataFrame, struct: str, names: dict[str, str]) -> DataFrame:
    """rows with fields of a struct renamed; other fields stay as they are."""
    own = rows.schema[struct].dataType.names
    return rows.withColumn(struct, F.struct(*(F.col(f"{struct}.{n}").alias(names.get(n, n)) for n in own)))


def flattened(rows: DataFrame, key: str, struct: str) -> DataFrame:
    """(key, `key`, value): every leaf of a nested struct under its dotted name, as text. The names come from the schema alone."""

    def leaves(kind: StructType, at: str, name: str) -> list:
        out = []
        for f in kind.fields:
            path, full = f"{at}.{f.name}", f"{name}.{f.name}" if name else f.name
            out += leaves(f.dataType, path, full) if isinstance(f.dataType, StructType) else [F.struct(F.lit(full).alias("key"), F.col(path).cast("string").alias("value"))]
        return out

    return rows.select(key, F.inline(F.array(*leaves(rows.schema[struct].dataType, struct, ""))))


def drifted(before: DataFrame, after: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(key, before, after) of the flattened settings that differ or that one side lacks, without the allowed names."""
    a, b = before.select("key", F.col("value").alias("before")), after.select("key", F.col("value").alias("after"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "key", "full")
    return both.where((F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("before").eqNullSafe(F.col("after"))) & ~F.col("key").isin(*allowed)).select("key", "before", "after")


def blocks(rows: DataFrame, key: str, order: str, **parts: list[str]) -> DataFrame:
    """(key, steps): each key's rows in order as an array of structs, one field for each named block of columns."""
    step = F.struct(F.col(order).alias("_at"), *(F.struct(*names).alias(part) for part, names in parts.items()))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("_l"))
    return listed.select(key, F.transform("_l", lambda s: F.struct(*(s[p].alias(p) for p in parts))).alias("steps"))


def boundary_cases(spark: SparkSession, moves: tuple[str, ...] = ("U", "D", "L", "R")) -> DataFrame:
    """(case, value): every non-empty set of open moves, and every order in which all moves may have been tried."""
    listed = F.array(*map(F.lit, moves))
    n = len(moves)
    masks = spark.range(1, 1 << n)
    chosen = F.array_join(F.filter(listed, lambda m: F.floor(F.col("id") / F.pow(F.lit(2), F.array_position(listed, m) - 1)) % 2 == 1), "")
    opened = masks.select(F.format_string("open-mask-%02d", "id").alias("case"), chosen.alias("value"))
    # an order of n moves is a number of n digits to base n without a repeated digit
    orders = spark.range(n**n).withColumn("d", F.array(*(F.expr(f"cast(id div {n**(n - 1 - i)} % {n} as int)") for i in range(n)))).where(F.size(F.array_distinct("d")) == n)
    numbered = orders.withColumn("_i", F.row_number().over(Window.orderBy("id")) - 1)  # n! rows, a constant
    history = numbered.select(F.format_string("history-order-%02d", "_i").alias("case"), F.array_join(F.transform("d", lambda i: F.get(listed, i)), "").alias("value"))
    return opened.unionByName(history)


def boundary_coverage(rows: DataFrame, key: str, order: str, action: str, moves: tuple[str, ...] = ("U", "D", "L", "R")) -> DataFrame:
    """(case, value, n) of boundary_cases(): how many keys of rows have that set of moves, or made all moves first in that order."""
    first = rows.groupBy(key, action).agg(F.min(order).alias("_first"))
    tried = F.transform(F.array_sort(F.collect_list(F.struct("_first", action))), lambda x: x[action])
    per = first.groupBy(key).agg(tried.alias("_t"))
    mask = F.array_join(F.filter(F.array(*map(F.lit, moves)), lambda m: F.array_contains("_t", m)), "")
    met = per.select(F.explode(F.array(F.struct(F.lit("open").alias("kind"), mask.alias("value")), F.struct(F.when(F.size("_t") == len(moves), "history").alias("kind"), F.array_join("_t", "").alias("value")))).alias("m"))
    counts = met.where("m.kind IS NOT NULL").groupBy("m.kind", "m.value").agg(F.count(F.lit(1)).alias("n"))
    cases = boundary_cases(rows.sparkSession, moves).withColumn("kind", F.split_part("case", F.lit("-"), F.lit(1)))
    return cases.join(counts, ["kind", "value"], "left").select("case", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
