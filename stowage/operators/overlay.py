"""Layered settings: scopes, overrides, inheritance, parameters, templates.

A long table (fqn, rank, key, value) holds every scope's settings; the effective
value is the one of the highest rank. Ranks in order: project, project override,
namespace, namespace override, node, node override, command line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = {"project": 0, "project_override": 1, "cookbook": 2, "cookbook_override": 3, "recipe": 4, "recipe_override": 5, "command": 6}


def effective(settings: DataFrame) -> DataFrame:
    """(fqn, key, value, rank): per key the value of the highest rank."""
    best = settings.groupBy("fqn", "key").agg(F.max(F.struct("rank", "value")).alias("_x"))
    return best.select("fqn", "key", F.col("_x.value").alias("value"), F.col("_x.rank").alias("rank"))


def scope_rows(df: DataFrame, fqn: str, variables: str, scope: str) -> DataFrame:
    """A map column as settings of one scope."""
    return df.select(F.col(fqn).alias("fqn"), F.lit(RANKS[scope]).alias("rank"), F.explode(variables)).select("fqn", "rank", "key", "value")


def override_rows(df: DataFrame, fqn: str, overrides: str, environment: str, scope: str) -> DataFrame:
    """The chosen environment's block of a map<environment, map<key, value>>."""
    return df.select(F.col(fqn).alias("fqn"), F.lit(RANKS[scope + "_override"]).alias("rank"), F.explode(F.col(overrides)[environment])).select("fqn", "rank", "key", "value")


def command_rows(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """Command-line values: strings, above every scope, for all nodes."""
    if not values:
        return nodes.select("fqn", F.lit(6).alias("rank"), F.lit("").alias("key"), F.lit("").alias("value")).where(F.lit(False))
    pairs = F.explode(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]))
    return nodes.select("fqn", F.lit(RANKS["command"]).alias("rank"), pairs).select("fqn", "rank", "key", "value")


def retype_declared(effective_rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """Command-line values replace only keys that are declared."""
    if not values:
        return effective_rows
    given = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return effective_rows.withColumn("value", F.coalesce(given[F.col("key")], F.col("value")))


def inherited_environment(*scopes: Column) -> Column:
    """Project, namespace and node lists one after the other; repeats stay."""
    return F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in scopes])


def inherited_tags(own: Column, inherited: Column) -> Column:
    """The own tags, or all inherited ones if there are none: no merging."""
    return F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) == 0, inherited).otherwise(own)


def overlaid(base: Column, over: Column) -> Column:
    """Map union in which ``over`` wins."""
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    return F.when(base.isNull(), over).when(over.isNull(), base).otherwise(F.map_concat(kept, over))


# -- parameters ------------------------------------------------------------------------


def declared(templates: DataFrame, name: str = "name", parameters: str = "parameters") -> DataFrame:
    """(template, param, type, required, default): a JSON object of declarations as
    rows. ``default`` is JSON text, null where none is given."""
    spec = F.from_json(F.col(parameters), "map<string, string>")
    rows = templates.select(F.col(name).alias("template"), F.explode(spec).alias("param", "spec"))
    v = F.try_parse_json("spec")
    return rows.select(
        "template",
        "param",
        F.lower(F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("string"))).alias("type"),
        F.coalesce(F.try_variant_get(v, "$.required", "boolean"), F.lit(False)).alias("required"),
        F.to_json(F.try_variant_get(v, "$.default", "variant")).alias("default"),
    )


def json_kind(text: Column) -> Column:
    """string, number, boolean, array, object or null: the kind of a JSON text; a
    text that is no JSON is a string."""
    shape = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(shape.isNull() | (shape == "STRING"), F.lit("string"))
        .when(shape.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.lit("number"))
        .when(shape == "BOOLEAN", F.lit("boolean"))
        .when(F.startswith(shape, F.lit("ARRAY")), F.lit("array"))
        .when(F.startswith(shape, F.lit("OBJECT")), F.lit("object"))
        .otherwise(F.lit("null"))
    )


def resolve_parameters(uses: DataFrame, provided: DataFrame, declarations: DataFrame) -> DataFrame:
    """(fqn, param, value, error) for nodes that use templates.

    ``uses`` (fqn, template), ``provided`` (fqn, param, value as JSON text). Defaults
    are filled in, given values win, undeclared ones pass. ``error`` is ``missing``
    for a required one without value, ``type`` for a value of another kind.
    """
    wanted = uses.join(declarations, "template").select("fqn", "param", "type", "required", "default")
    both = wanted.join(provided.withColumn("_given", F.lit(True)), ["fqn", "param"], "full")
    value = F.when(F.col("_given"), F.col("value")).otherwise(F.col("default"))
    kind = json_kind(value)
    error = (
        F.when(F.col("type").isNull(), F.lit(None))
        .when(value.isNull() & F.col("required"), F.lit("missing"))
        .when(value.isNotNull() & (kind != F.col("type")), F.lit("type"))
    )
    return both.select("fqn", "param", value.alias("value"), error.alias("error")).where(F.col("value").isNotNull() | F.col("error").isNotNull())


def unknown_templates(uses: DataFrame, templates: DataFrame, name: str = "name") -> DataFrame:
    return uses.join(templates.select(F.col(name).alias("template")), "template", "left_anti")


def merge_template(node: str, template: str) -> dict[str, Column]:
    """Columns of a node merged with its template (struct columns of the given
    names): the node wins on description, dependencies, cache and run where it has
    them; environments are appended, variables overlaid; tags are the template's."""
    n, t = (lambda c: F.col(f"{node}.{c}")), (lambda c: F.col(f"{template}.{c}"))
    filled = lambda c: F.coalesce(F.size(n(c)) > 0, F.lit(False))
    return {
        "description": F.coalesce(n("description"), t("description")),
        "dependencies": F.when(filled("dependencies"), n("dependencies")).otherwise(t("dependencies")),
        "cache": F.coalesce(n("cache"), t("cache")),
        "run": F.when(F.coalesce(n("run"), F.lit("")) != "", n("run")).otherwise(t("run")),
        "environment": inherited_environment(t("environment"), n("environment")),
        "variables": overlaid(t("variables"), n("variables")),
        "tags": t("tags"),
    }
