"""Validation of extraction templates, held as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Template types, those that are graphs, extraction methods with whether they are there, merge strategies.
TYPES = ("model", "list", "set", "graph", "hypergraph", "temporal_graph", "spatial_graph", "spatio_temporal_graph")
GRAPH_TYPES = ("graph", "hypergraph", "temporal_graph", "spatial_graph", "spatio_temporal_graph")
METHODS = {"standard": True, "two_stage": True, "graph_rag": False, "light_rag": False}
MODES = ("one_stage", "two_stage")
STRATEGIES = ("exact", "keep_first", "keep_last", "field_overwrite", "llm_balanced", "llm_prefer_first", "llm_prefer_last")


def _listed(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def _bare(key: str) -> Column:
    """A given text without a {field} placeholder."""
    return F.col(key).isNotNull() & ~(F.contains(F.col(key), F.lit("{")) & F.contains(F.col(key), F.lit("}")))


def _doubled(fields: str) -> Column:
    return F.size(fields) > F.size(F.array_distinct(fields))


def validate(templates: DataFrame) -> DataFrame:
    """``templates`` with ``valid``, ``errors`` and, for valid ones, ``warnings``.

    Columns: type, mode, method, merge_nodes, merge_edges (null: the default), entity_key, entity_label, entity_fields,
    relation_key, relation_fields (null key: no such schema), has_identifiers. A null type or name is an error.
    """
    graph = F.col("type").isin(*GRAPH_TYPES)
    off = lambda c, known: F.col(c).isNotNull() & ~F.col(c).isin(*known)
    errors = _listed({
        "name": F.col("name").isNull(), "type": F.col("type").isNull() | off("type", TYPES), "mode": off("mode", MODES), "method": off("method", METHODS),
        "merge_strategy_nodes": off("merge_nodes", STRATEGIES), "merge_strategy_edges": off("merge_edges", STRATEGIES),
        "entity_key": _bare("entity_key"), "display_label": _bare("entity_label"), "relation_key": _bare("relation_key"), "entity_fields": _doubled("entity_fields"), "relation_fields": _doubled("relation_fields"),
        "entity_schema": graph & F.col("entity_key").isNull(), "relation_schema": graph & F.col("relation_key").isNull(), "identifiers": graph & ~F.coalesce("has_identifiers", F.lit(False)),
    })
    method = F.coalesce("method", F.lit("standard"))
    warnings = _listed({"incompatible": ~graph, "not_implemented": method.isin(*[m for m, there in METHODS.items() if not there])})
    out = templates.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    return out.withColumn("warnings", F.when(F.col("valid"), warnings).otherwise(F.array().cast("array<string>")))
