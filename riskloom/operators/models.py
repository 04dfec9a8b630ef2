"""Risk of data models: the functions that belong to each, and what models share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def associations(models: DataFrame, functions: DataFrame, imports: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """models (model, file, line) and functions (function_id, file, name, line, score, band) -> (model, model_file, model_line, function columns, association).

    Of a model's own file: its methods ('Model::...'); without such, functions whose names mention it; without such, all if the file has no other
    model. And all functions of files that import the model's file (src_file, dst_file) and have its name among their tokens (file, token).
    """
    m = models.select("model", F.col("file").alias("model_file"), F.col("line").alias("model_line")).withColumn("_n", F.count("*").over(Window.partitionBy("model_file")))
    same = m.join(functions, F.col("model_file") == F.col("file"))
    rule = F.when(F.col("name").startswith(F.concat("model", F.lit("::"))), 1).when(F.instr(F.lower("name"), F.lower("model")) > 0, 2).when(F.col("_n") <= 1, 3)
    same = same.withColumn("_rule", rule).filter("_rule is not null")
    best = same.withColumn("_best", F.min("_rule").over(Window.partitionBy("model", "model_file", "model_line"))).filter("_rule = _best").drop("_rule", "_best", "_n").withColumn("association", F.lit("same_file"))
    if imports is None or tokens is None:
        return best
    far = m.drop("_n").join(imports.select(F.col("src_file").alias("file"), F.col("dst_file").alias("model_file")).distinct(), "model_file")
    far = far.join(tokens.select("file", F.col("token").alias("model")).distinct(), ["file", "model"]).join(functions, "file").withColumn("association", F.lit("direct_import"))
    both = best.unionByName(far.select(best.columns))
    w = Window.partitionBy("model", "model_file", "model_line", "function_id").orderBy(F.desc("association"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def risk_map(assoc: DataFrame, top_functions: int = 5, least: int = 2) -> DataFrame:
    """(model, model_file, model_line, score, functions, critical, high, moderate, low): score is the sum of the top functions; models of fewer than ``least`` functions are left out."""
    key = ["model", "model_file", "model_line"]
    r = assoc.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "file", "line", "name")))
    count = lambda b: F.count(F.when(F.col("band") == b, 1)).alias(b)
    g = r.groupBy(*key).agg(F.sum(F.when(F.col("_r") <= top_functions, F.col("score"))).alias("score"), F.count("*").alias("functions"), *map(count, ["critical", "high", "moderate", "low"]))
    return g.filter(F.col("functions") >= least)


def links(assoc: DataFrame) -> DataFrame:
    """(source, target, shared_functions, shared_risk, functions): pairs of models by the functions that they share, the first five names."""
    a = assoc.select(F.struct("model_file", "model_line", "model").alias("a"), "function_id", F.col("score").alias("sa"), "name")
    b = assoc.select(F.struct("model_file", "model_line", "model").alias("b"), "function_id", F.col("score").alias("sb"))
    j = a.join(b, "function_id").filter("a < b")
    g = j.groupBy("a", "b").agg(F.count("*").alias("shared_functions"), F.sum(F.greatest("sa", "sb")).alias("shared_risk"), F.array_join(F.slice(F.array_sort(F.collect_list("name")), 1, 5), ",").alias("functions"))
    return g.select(F.col("a.model").alias("source"), F.col("b.model").alias("target"), "shared_functions", "shared_risk", "functions")
