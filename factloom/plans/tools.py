"""Graph tools for function calling: schemas, and calls whose errors are data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.operators import graph

_TEXT, _NUMBER, _FLAG = {"type": "string"}, {"type": "integer"}, {"type": "boolean"}
#: name to (what it does, required arguments, optional arguments)
TOOLS = {
    "graph_query": ("One SELECT over the views Fact and RELATED.", {"query": _TEXT}, {"limit": _NUMBER}),
    "graph_find_by_subject": ("Facts whose subject holds a text, in any case.", {"subject": _TEXT}, {}),
    "graph_find_by_reliability": ("The best facts of a tier.", {"reliability": _TEXT}, {"limit": _NUMBER}),
    "graph_rag_retrieve": ("Facts that match a question and their surroundings, by words and PageRank.", {"query": _TEXT}, {"top_k": _NUMBER, "hops": _NUMBER, "exclude_unverified": _FLAG}),
    "graph_distill_ontology": ("Taxonomy, types of concepts and the schema of relations.", {}, {}),
}


def list_tools() -> list[dict]:
    return [{"name": n, "description": d, "parameters": {"type": "object", "properties": r | o, "required": list(r)}} for n, (d, r, o) in TOOLS.items()]


class GraphTools:
    """The tools over one table of facts; results are small and are collected."""

    def __init__(self, facts: DataFrame, edges: DataFrame | None = None) -> None:
        self.facts, self.edges = facts, graph.link(facts) if edges is None else edges

    def graph_query(self, query: str, limit: int = 100) -> list[dict]:
        return rows(graph.graph_sql(self.facts.sparkSession, self.facts, self.edges, query, limit))

    def graph_find_by_subject(self, subject: str) -> list[dict]:
        return rows(graph.find_by_subject(self.facts, subject))

    def graph_find_by_reliability(self, reliability: str, limit: int = 100) -> list[dict]:
        return rows(graph.find_by_reliability(self.facts, reliability, limit))

    def graph_rag_retrieve(self, query: str, top_k: int = 5, hops: int = 2, exclude_unverified: bool = True) -> list[dict]:
        return rows(graph.retrieve(self.facts, self.edges, query, top_k, hops, verified_only=exclude_unverified))

    def graph_distill_ontology(self) -> dict:
        types = graph.semantic_types(self.facts)
        return {"taxonomy": rows(graph.taxonomy(self.facts)), "types": rows(types), "schema": rows(graph.relation_schema(self.facts, types))}


def rows(found: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in found.collect()]


def handle_tool_call(tools: GraphTools, name: str, arguments: dict | None) -> dict:
    """``{"ok": True, "result": ...}`` or ``{"ok": False, "error": ...}``."""
    if name not in TOOLS:
        return {"ok": False, "error": f"unknown tool: {name}"}
    given = arguments or {}
    if missing := [a for a in TOOLS[name][1] if a not in given]:
        return {"ok": False, "error": f"missing: {', '.join(missing)}"}
    try:
        return {"ok": True, "result": getattr(tools, name)(**given)}
    except Exception as e:
        return {"ok": False, "error": str(e)}
