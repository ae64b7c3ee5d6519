"""Mapping of weight names by rules, and checks of names, shapes and configs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_keys(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, target, rule): each key rewritten by its first matching rule; target is null without one.

    ``rules`` (priority, pattern, target) are a bounded table of regular expressions, anchored at
    the key's start, with $1, $2 ... in the target for the groups. They are broadcast.
    """
    pattern = F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))
    hit = keys.join(F.broadcast(rules.withColumn("__p", pattern)), F.expr("key rlike __p"), "left")
    first = Window.partitionBy("key").orderBy("priority")
    best = hit.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return best.select("key", F.expr("regexp_replace(key, concat('^', pattern), target)").alias("target"), F.col("pattern").alias("rule"))


def unmapped(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys that no rule matches."""
    return keys.join(F.broadcast(rules.withColumn("__p", F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")")))), F.expr("key rlike __p"), "left_anti")


def merged_rules(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rules of both tables; those of the second win for equal patterns and come last, with priorities above all of the first."""
    above = first.agg(F.max("priority") + 1).first()[0] or 0
    least = second.agg(F.min("priority")).first()[0] or 0
    moved = second.select((F.col("priority") - least + above).cast(first.schema["priority"].dataType).alias("priority"), "pattern", "target")
    return first.join(second.select("pattern"), "pattern", "left_anti").select("priority", "pattern", "target").unionByName(moved)


def inverse_rules(rules: DataFrame) -> DataFrame:
    """Rules that lead back: targets become patterns that hold the groups, groups become templates.

    Groups do not nest. A group that the target leaves out cannot be led back, which is an error.
    """
    groups = F.regexp_extract_all("pattern", F.lit(r"\([^()]*\)"), F.lit(0))
    used = F.transform(F.regexp_extract_all("target", F.lit(r"\$(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    literal = F.split(F.regexp_replace("target", r"\.", r"\\."), r"\$\d+")
    outer = F.split(F.regexp_replace("pattern", r"\\\.", "."), r"\([^()]*\)")
    cut = rules.select("priority", "pattern", groups.alias("groups"), used.alias("used"), literal.alias("literal"), outer.alias("outer"))
    pattern = F.concat(F.array_join(F.transform("literal", lambda x, i: F.concat(x, F.coalesce(F.get("groups", F.get("used", i) - 1), F.lit("")))), ""), F.lit("$"))
    back = F.transform("outer", lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("$"), F.array_position("used", i).cast("string"), x)))
    lost = F.exists(F.sequence(F.lit(0), F.size("groups")), lambda i: (i > 0) & ~F.array_contains("used", i))
    target = F.when(lost, F.raise_error(F.concat(F.lit("no way back: "), F.col("pattern")))).otherwise(F.array_join(back, ""))
    return cut.select("priority", pattern.alias("pattern"), target.alias("target"))


def expert_gaps(parts: DataFrame, experts: int) -> DataFrame:
    """(layer, proj, n) of expert groups that are not complete."""
    return parts.groupBy("layer", "proj").agg(F.count_distinct("expert").alias("n")).where(F.col("n") != experts)


def stacked_experts(parts: DataFrame, value: str) -> DataFrame:
    """(layer, proj, values): the experts' values in expert order."""
    both = F.array_sort(F.collect_list(F.struct("expert", value)))
    return parts.groupBy("layer", "proj").agg(F.transform(both, lambda x: x[value]).alias("values"))


def shape_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose shapes differ, or that one side lacks."""
    return left.withColumnRenamed("shape", "l").join(right.withColumnRenamed("shape", "r"), "key", "full").where(~F.col("l").eqNullSafe(F.col("r")))


def config_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Fields (field, value) whose values differ between two unpivoted configs."""
    return left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), "field", "full").where(~F.col("l").eqNullSafe(F.col("r")))


def permuted(shape: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(shape, i))


def inverse_order(order: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda i: (F.array_position(order, i) - 1).cast("int"))


def reshaped(shape: Column, target: Column) -> Column:
    """The target shape, in which one -1 takes what is left; another number of elements is an error."""
    product = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda n, x: n * x)
    n, known = product(shape), product(F.filter(target, lambda x: x >= 0))
    out = F.transform(target, lambda x: F.when(x >= 0, x.cast("long")).otherwise((n / F.nullif(known, F.lit(0))).cast("long")))
    return F.when(product(out) == n, out).otherwise(F.raise_error(F.concat(F.lit("cannot reshape "), n, F.lit(" elements"))).cast("array<bigint>"))


def flattened(docs: DataFrame, name: str, doc: str) -> DataFrame:
    """(name, path, value) of the leaves of nested documents (variants): keys and list positions joined by dots.

    One pass for each level of nesting; empty objects and lists give no row.
    """
    level, leaves = docs.select(name, F.lit(None).cast("string").alias("path"), F.col(doc).alias("value")), []
    nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    while True:
        leaves.append(level.where(~nested))
        inner = level.where(nested).withColumnRenamed("value", "__outer")
        if inner.isEmpty():
            break
        each = docs.sparkSession.tvf.variant_explode(F.col("__outer").outer())
        step = F.coalesce("key", F.col("pos").cast("string"))
        level = inner.lateralJoin(each).select(name, F.concat_ws(".", "path", step).alias("path"), "value")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out.withColumn("value", F.to_json("value"))


def dtype_of(name: Column) -> Column:
    """Normal dtype name; bfloat16 is looked for before float16."""
    n = F.lower(name)
    return (F.when(n.contains("bfloat16") | (n == "bf16"), "bfloat16").when(n.contains("float16") | (n == "fp16"), "float16")
            .when(n.contains("float32") | (n == "fp32"), "float32").otherwise(F.raise_error(F.concat(F.lit("unknown dtype: "), name)).cast("string")))


def first_of(*names: str) -> Column:
    """The first column that is not null; none is an error."""
    return F.coalesce(*[F.col(n) for n in names], F.raise_error(F.lit("missing: " + " or ".join(names))).cast("string"))


def index_of(part: Column) -> Column:
    """A name's part as a number where it is one."""
    return part.try_cast("int")


def run_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("_"))
