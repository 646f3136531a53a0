"""A fluent builder for query flows, also from and to their JSON configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lexigraph.operators import build as B
from lexigraph.operators import nodeset as N


@dataclass
class Graph:
    """nodes (name, text, ...), edges by flavour name (i, j, count, and prob if it's kept), and parts of path nodes (id, part).

    Each may be a function without arguments that makes it, which is called when it is first wanted.  `search` makes the nodes
    without writing them, for steps that want a few by their text; they are searched where they are made until all nodes are wanted.
    """

    nodes: DataFrame | Callable[[], DataFrame]
    edges: dict[str, DataFrame | Callable[[], DataFrame]]
    parts: DataFrame | Callable[[], DataFrame] | None = None
    search: Callable[[], DataFrame] | None = None

    def along(self, name: str) -> DataFrame:
        """Edges with prob."""
        edges = self.counted(name)
        return edges if "prob" in edges.columns else B.with_prob(edges)

    def counted(self, name: str) -> DataFrame:
        """Edges as they are kept."""
        if name not in self.edges:
            raise ValueError(f"the graph has no edges named {name}")
        if not isinstance(self.edges[name], DataFrame):
            self.edges[name] = self.edges[name]()
        return self.edges[name]

    def found_nodes(self) -> DataFrame:
        return self.search() if self.search and not isinstance(self.nodes, DataFrame) else self.all_nodes()

    def all_nodes(self) -> DataFrame:
        if not isinstance(self.nodes, DataFrame):
            self.nodes = self.nodes()
        return self.nodes

    def all_parts(self) -> DataFrame:
        if self.parts is None:
            raise ValueError("the graph has no table of parts")
        if not isinstance(self.parts, DataFrame):
            self.parts = self.parts()
        return self.parts


#: What a step shows of its result, if its configuration doesn't say.
OUTPUT = {"num-nodes": 1000, "num-edges": 1000, "ind-nodes": 0, "ind-edges": 0}


@dataclass
class Flow:
    """Steps are numbered from 0; a step without `source` works on the last one.

    >>> # Flow(graph).select(["climate"]).traverse("next").filter_regex(["^ch"]).result()
    """

    graph: Graph
    steps: list[DataFrame] = field(default_factory=list)
    config: list[dict] = field(default_factory=list)
    #: Edges (i, j, prob) of subgraph steps, by step.
    links: dict[int, DataFrame] = field(default_factory=dict)

    def _at(self, source: int | None) -> int:
        at = len(self.steps) - 1 if source is None else source
        if not 0 <= at < len(self.steps):
            raise ValueError(f"step {at} isn't there yet")
        return at

    def _add(self, flop: str, deps: list[int], parameters: dict, step: DataFrame) -> Flow:
        self.config.append({"flop": flop, "flid": len(self.steps), "deps": deps, "parameters": parameters, "output": dict(OUTPUT)})
        self.steps.append(step)
        return self

    def select(self, paths: list[str | list[str]]) -> Flow:
        """Words, or paths of several tokens."""
        whole = [[p] if isinstance(p, str) else list(p) for p in paths]
        return self._add("SELECT", [], {"nodes": whole}, N.select_paths(self.graph.found_nodes(), whole))

    def select_hashes(self, weights: list[tuple[int, float]]) -> Flow:
        return self._add("SELECT", [], {"hashes": [list(w) for w in weights]}, N.select_hashes(N.node_hash(self.graph.all_nodes()), weights))

    def traverse(self, edge: str, source: int | None = None) -> Flow:
        at = self._at(source)
        return self._add("TRAVERSE", [at], {"edge": edge}, N.traverse(self.steps[at], self.graph.counted(edge)))

    def filter_regex(self, patterns: list[str], source: int | None = None) -> Flow:
        at = self._at(source)
        return self._add("FILTER", [at], {"node-regex": patterns}, N.filter_regex(self.steps[at], patterns))

    def filter_flavours(self, names: list[str], source: int | None = None) -> Flow:
        at = self._at(source)
        return self._add("FILTER", [at], {"node-flavors": names}, N.filter_flavours(self.steps[at], self.graph.all_nodes(), names))

    def filter_contains(self, other: int, source: int | None = None) -> Flow:
        """Nodes that are in step `other`, or of which a part is."""
        at, of = self._at(source), self._at(other)
        return self._add("FILTER", [at], {"contains-flid": of}, N.filter_contains(self.steps[at], self.steps[of], self.graph.all_parts()))

    def join(self, sources: list[int], mode: str = "last") -> Flow:
        deps = sorted(map(self._at, sources))
        return self._add("JOIN", deps, {"mode": mode}, N.join([self.steps[s] for s in deps], mode))

    def intersect(self, sources: list[int]) -> Flow:
        deps = sorted(map(self._at, sources))
        return self._add("INTERSECT", deps, {}, N.intersect([self.steps[s] for s in deps]))

    def uniform(self, source: int | None = None) -> Flow:
        at = self._at(source)
        return self._add("UNIFORM", [at], {}, N.uniform(self.steps[at]))

    def subgraph(self, edges: list[str], sources: list[int] | None = None, hops: int = 1) -> Flow:
        deps = sorted(map(self._at, sources or [None]))
        along = self.graph.along(edges[0])
        for name in edges[1:]:
            along = along.unionByName(self.graph.along(name))
        nodes, links = N.subgraph([self.steps[s] for s in deps], along, hops)
        self.links[len(self.steps)] = links
        return self._add("SUBGRAPH", deps, {"edges": edges, "hops": hops}, nodes)

    def without(self, other: int, source: int | None = None) -> Flow:
        at, of = self._at(source), self._at(other)
        return self._add("WITHOUT", [at, of], {}, N.without(self.steps[at], self.steps[of]))

    def result(self, source: int | None = None) -> DataFrame:
        return self.steps[self._at(source)]

    def page(self, source: int | None = None) -> DataFrame:
        """The part of a step's result that its configuration shows."""
        shown = self.config[self._at(source)]["output"]
        return N.page(self.result(source), shown["num-nodes"], shown["ind-nodes"])

    def overview(self) -> DataFrame:
        return N.overview([(k, c["flop"], rows) for k, (c, rows) in enumerate(zip(self.config, self.steps, strict=True))])

    def to_config(self) -> dict:
        return {"flow": self.config}

    @classmethod
    def from_config(cls, graph: Graph, config: dict) -> Flow:
        """Run {"flow": [{"flop", "flid", "deps", "parameters", "output"}, ...]}, each step after those that it depends on, else in their order."""
        flow, place, waiting = cls(graph), {}, list(config["flow"])
        needs = lambda op: [*op.get("deps", ()), *(f for f in [op.get("parameters", {}).get("contains-flid")] if f is not None)]
        known = {op["flid"] for op in waiting}
        if unknown := {d for op in waiting for d in needs(op)} - known:
            raise ValueError(f"steps depend on {sorted(unknown)}, which aren't there")
        while waiting:
            op = next((op for op in waiting if all(d in place for d in needs(op))), None)
            if op is None:
                raise ValueError(f"steps {[op['flid'] for op in waiting]} depend on each other")
            waiting.remove(op)
            flow._run(op["flop"].upper(), [place[d] for d in op.get("deps", ())], op.get("parameters", {}), place)
            flow.config[-1]["output"] |= op.get("output", {})
            place[op["flid"]] = len(flow.steps) - 1
        return flow

    def _run(self, kind: str, deps: list[int], p: dict, place: dict[int, int]) -> None:
        if kind == "SELECT" and "hashes" in p:
            self.select_hashes([(h, w) for h, w in p["hashes"]])
        elif kind == "SELECT":
            self.select(p["nodes"])
        elif kind == "TRAVERSE":
            self.traverse(p["edge"], deps[0])
        elif kind == "FILTER" and "node-regex" in p:
            self.filter_regex(p["node-regex"], deps[0])
        elif kind == "FILTER" and "contains-flid" in p:
            self.filter_contains(place[p["contains-flid"]], deps[0])
        elif kind == "FILTER":
            self.filter_flavours(p["node-flavors"], deps[0])
        elif kind == "JOIN":
            self.join(deps, p.get("mode", "last"))
        elif kind == "INTERSECT":
            self.intersect(deps)
        elif kind == "UNIFORM":
            self.uniform(deps[0])
        elif kind == "SUBGRAPH":
            self.subgraph(p["edges"], deps, p.get("hops", 1))
        elif kind == "WITHOUT":
            self.without(deps[1], deps[0])
        else:
            raise ValueError(f"unknown step {kind}")
