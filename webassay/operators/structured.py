"""Structured data at any depth: the typed nodes of JSON-LD blocks as rows.

A block is one VARIANT value. Each round takes the values found last apart
with ``variant_explode`` in a lateral join, so there are as many rounds as the
deepest block has levels, and rows are spread like any others; a page with very
many nodes isn't held in one row. Blocks that can't be read have no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webassay.operators.rules import NOTICE, REQUIRED, Page, Thresholds, with_defaults
from webassay.session import checkpoint

#: What counts as no value.
FALSY = ("", "[]", "{}", "0", "0.0", "false")


def typed_nodes(blocks: DataFrame, json: str = "json") -> DataFrame:
    """The other columns of ``blocks``, path, types and node (VARIANT) of everything with an @type, wherever it sits."""
    keys = [c for c in blocks.columns if c != json]
    level = blocks.select(*keys, F.lit("$").alias("path"), F.try_parse_json(json).alias("node"))
    found = None
    while True:
        level = checkpoint(level.where(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)<")))
        said = F.try_variant_get("node", "$['@type']", "variant")
        typed = level.where(F.schema_of_variant("node").startswith("OBJECT<") & said.isNotNull()).select("*", types_of(said).alias("types"))
        found = typed if found is None else found.unionByName(typed)
        if level.isEmpty():
            return found
        inside = level.withColumnRenamed("node", "outer").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("outer").outer()))
        level = inside.select(*keys, F.concat("path", F.coalesce(F.concat(F.lit("."), "key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"), F.col("value").alias("node"))


def types_of(said: Column) -> Column:
    """The value of @type as a list: of one text, or of the values of a list; of anything else none."""
    several = F.transform(F.try_variant_get(said, "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.when(F.schema_of_variant(said).startswith("ARRAY<"), F.coalesce(several, F.array().cast("array<string>"))).when(F.schema_of_variant(said) == "STRING", F.array(F.try_variant_get(said, "$", "string"))).otherwise(F.array().cast("array<string>"))


def incomplete(nodes: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED) -> DataFrame:
    """``nodes``, a row for each of their types, with type and missing: its required properties without a value, in their order."""
    absent = lambda x: F.coalesce(F.try_variant_get("node", f"$.{x}", "string"), F.lit("")).isin(*FALSY)
    by_type = F.lit("")
    for name, props in required.items():
        by_type = F.when(F.col("type") == name, F.array_join(F.array_compact(F.array(*[F.when(absent(x), F.lit(x)) for x in props])), ", ")).otherwise(by_type)
    return nodes.withColumn("type", F.explode("types")).withColumn("missing", by_type)


def findings(pages: DataFrame) -> DataFrame:
    """structured.missing_properties of pages with incomplete nodes at any depth, with the distinct gaps as evidence."""
    full = with_defaults(pages)
    keys = [c for c in ("site", "page_id", "url") if c in full.columns]
    shown = full.where(F.col("error").isNull() & ~F.coalesce(Page(Thresholds()).blocked_index, F.lit(False)))
    blocks = shown.select(*keys, F.posexplode("doc.json_ld").alias("block", "json"))
    gaps = incomplete(typed_nodes(blocks)).where("missing <> ''").select(*keys, F.concat("type", F.lit(" missing "), "missing").alias("gap"))
    counted = gaps.groupBy(*keys, "gap").agg(F.count("*").alias("n"))  # a few kinds of gaps a page, however many nodes
    each = counted.groupBy(*keys).agg(F.array_join(F.slice(F.array_sort(F.collect_set("gap")), 1, 4), ", ").alias("evidence"), F.sum("n").alias("nodes"))
    return each.select(*keys, F.lit("structured.missing_properties").alias("finding_id"), F.lit(NOTICE).alias("severity"), F.lit("structured").alias("category"), F.concat(F.col("nodes").cast("string"), F.lit(" nodes lack required properties")).alias("message"), "evidence", F.lit("Add them.").alias("fix"))
