"""Pages and links between them: the inventory of routes, and which models link to which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.functions.text import slugify

#: (make, model)
Model = tuple[str, str]


def _frame(models: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return models.sparkSession.createDataFrame(rows, schema)


def route_inventory(models: DataFrame, static: list[str], age_slugs: list[str], pairs: list[tuple[Model, Model]]) -> DataFrame:
    """route: static pages, one page for each maker, model and age band of models (make, model), and one for each compared pair."""
    slugs = models.select(slugify(F.col("make")).alias("a"), slugify(F.col("model")).alias("b")).distinct()
    ages = F.explode(F.array(*[F.lit(x) for x in age_slugs]))
    path = lambda *parts: F.concat(F.lit("/mot-check/"), *[p for part in parts for p in (part, F.lit("/"))])
    by_model = slugs.select(F.explode(F.array(path("a"), path("a", "b"))).alias("route"))
    by_age = slugs.select("a", "b", ages.alias("age")).select(path("a", "b", "age").alias("route"))
    compared = _frame(models, [(*x, *y) for x, y in pairs], "a string, b string, c string, d string")
    name = lambda make, model: F.concat_ws("-", slugify(F.col(make)), slugify(F.col(model)))
    compared = compared.select(F.concat(F.lit("/mot-check/compare/"), name("a", "b"), F.lit("-vs-"), name("c", "d"), F.lit("/")).alias("route"))
    return by_model.union(by_age).union(compared).union(_frame(models, [(s,) for s in static], "route string")).distinct()


def link_tables(models: DataFrame, rivals: dict[Model, list[Model]], pairs: list[tuple[Model, Model]]) -> DataFrame:
    """kind, make, model, to_make, to_model: siblings of one maker, known competitors that have a page, and compared models.

    models: make, model (distinct). A maker's siblings grow with the square of its models, as the pages that show them do.
    """
    other = models.select("make", F.col("model").alias("to_model"))
    siblings = models.join(other, "make").where("model <> to_model").select(
        F.lit("sibling").alias("kind"), "make", "model", F.col("make").alias("to_make"), "to_model"
    )
    schema = "make string, model string, to_make string, to_model string"
    wanted = _frame(models, [(*m, *r) for m, listed in rivals.items() for r in listed], schema)
    there = models.select(F.col("make").alias("to_make"), F.col("model").alias("to_model"))
    competitors = models.join(wanted, ["make", "model"]).join(there, ["to_make", "to_model"], "left_semi")
    both = _frame(models, [(*x, *y) for x, y in pairs] + [(*y, *x) for x, y in pairs], schema)
    compared = models.join(both, ["make", "model"])
    named = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "make", "model", "to_make", "to_model")
    return siblings.unionByName(named(competitors, "competitor")).unionByName(named(compared, "comparison"))
