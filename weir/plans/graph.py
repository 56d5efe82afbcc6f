"""Graphs of named operators joined by edges that carry named streams.

A node is a function from a DataFrame to a DataFrame; a source is a function of
the session. Rows may carry the column ``_stream``; an edge takes the streams it
subscribes to, matched exactly. Nodes that read several edges get the union. A
feedback edge closes a cycle for a bounded number of rounds. A body with a second
parameter also gets the latest signal that the node was sent, or None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weir.errors import AlternateNotFoundError, DuplicateError, InvalidAppError, NodeNotFoundError

STREAM, DEFAULT = "_stream", "default"
Body = Callable[..., DataFrame]
Envelope = Callable[[DataFrame], DataFrame]
Partitioner = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Edge:
    """From ``source``; ``kind`` is round_robin, reduce (by ``key``), custom (``partitioner``) or feedback (for ``rounds``).

    ``envelope`` adds what travels with each row of the edge, before the rows are dealt."""

    source: str
    kind: str = "round_robin"
    key: str | None = None
    streams: tuple[str, ...] = (DEFAULT,)
    partitioner: Partitioner | None = None
    envelope: Envelope | None = None
    rounds: int = 0


@dataclass
class Node:
    """``alternates`` has the body under "default", or several of a dynamic node."""

    name: str
    graph: Graph
    alternates: dict[str, Body] = field(default_factory=dict)
    values: dict[str, float] = field(default_factory=dict)
    active: str | None = None
    source: Callable[[SparkSession], DataFrame] | None = None
    edges: list[Edge] = field(default_factory=list)
    instances: int = 1
    streams: tuple[str, ...] = (DEFAULT,)
    dynamic: bool = False
    signal: object = None

    def subscribe(self, upstream: str, *streams: str, envelope: Envelope | None = None) -> Node:
        """Read ``streams`` (the default one if none) of ``upstream``, dealt round robin."""
        return self._edge(Edge(upstream, streams=streams or (DEFAULT,), envelope=envelope))

    def reduce(self, upstream: str, key: str, *streams: str, envelope: Envelope | None = None) -> Node:
        """Read with all rows of a ``key`` together."""
        return self._edge(Edge(upstream, "reduce", key, streams or (DEFAULT,), envelope=envelope))

    def subscribe_with(self, upstream: str, partitioner: Partitioner, *streams: str, envelope: Envelope | None = None) -> Node:
        """Read with rows dealt, or copied, by ``partitioner(df, instances)``."""
        return self._edge(Edge(upstream, "custom", None, streams or (DEFAULT,), partitioner, envelope))

    def feedback(self, downstream: str, rounds: int, *streams: str) -> Node:
        """Also read what ``downstream``, this node or one that follows from it, emits: for ``rounds`` rounds after the first. A round without rows ends nothing but adds nothing."""
        if rounds < 1:
            raise InvalidAppError("feedback needs at least one round")
        return self._edge(Edge(downstream, "feedback", None, streams or (DEFAULT,), rounds=rounds))

    def _edge(self, edge: Edge) -> Node:
        if edge.kind == "feedback" and self.source is None:  # its node may come later
            self.edges.append(edge)
            return self
        if edge.source not in self.graph.nodes:
            raise NodeNotFoundError(f"{self.name} subscribes to {edge.source}, which is not in the graph")
        if self.source is not None:
            raise InvalidAppError(f"{self.name} is a source and reads no edge")
        known = self.graph.nodes[edge.source].streams
        if unknown := [s for s in edge.streams if s not in known]:
            raise InvalidAppError(f"{edge.source} has no stream {', '.join(unknown)}; it has {', '.join(known)}")
        self.edges.append(edge)
        return self

    def parallelism(self, n: int) -> Node:
        """``n`` instances; 0 and less mean 1."""
        self.instances = max(1, n)
        return self

    def emits(self, *streams: str) -> Node:
        """Declare the streams that the rows' ``_stream`` column names."""
        self.streams = streams
        return self

    def alternate(self, name: str, value: float, body: Body) -> Node:
        """Add an implementation to a dynamic node."""
        if not self.dynamic:
            raise InvalidAppError(f"{self.name} is not dynamic")
        if name in self.alternates:
            raise DuplicateError(f"{self.name} has an alternate {name}")
        self.alternates[name], self.values[name] = body, float(value)
        return self

    def use(self, name: str) -> Node:
        """Make an alternate the active one."""
        if name not in self.alternates:
            raise AlternateNotFoundError(f"{self.name} has no alternate {name}")
        self.active = name
        return self


@dataclass
class Graph:
    name: str = "app"
    nodes: dict[str, Node] = field(default_factory=dict)

    def _add(self, node: Node) -> Node:
        if node.name in self.nodes:
            raise DuplicateError(f"node {node.name} exists")
        self.nodes[node.name] = node
        return node

    def source(self, name: str, read: Callable[[SparkSession], DataFrame]) -> Node:
        return self._add(Node(name, self, source=read))

    def node(self, name: str, body: Body) -> Node:
        return self._add(Node(name, self, {"default": body}, {"default": 1.0}, "default"))

    def dynamic_node(self, name: str) -> Node:
        return self._add(Node(name, self, dynamic=True))

    def validate(self) -> None:
        if not self.nodes:
            raise InvalidAppError("the graph is empty")
        for n in self.nodes.values():
            if n.source is None and not any(e.kind != "feedback" for e in n.edges):
                raise InvalidAppError(f"{n.name} reads nothing")
            if n.source is None and n.active is None:
                raise InvalidAppError(f"{n.name} has no active alternate")
        self.order()
        for n in self.nodes.values():
            for e in n.edges:
                if e.kind == "feedback":
                    if e.source not in self.nodes:
                        raise NodeNotFoundError(f"{n.name} is fed back from {e.source}, which is not in the graph")
                    self.cycle(n.name, e.source)

    def order(self) -> list[str]:
        """Names so that each follows what it reads, feedback edges left out."""
        done: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str) -> None:
            if state.get(name) == 1:
                raise InvalidAppError(f"{name} reads itself; such an edge is made with feedback")
            if name not in state:
                state[name] = 1
                for e in self.nodes[name].edges:
                    if e.kind != "feedback":
                        visit(e.source)
                state[name] = 2
                done.append(name)

        for name in self.nodes:
            visit(name)
        return done

    def upstream(self, name: str) -> set[str]:
        """``name`` and all that its rows come from, feedback left out."""
        found, todo = set(), [name]
        while todo:
            if (n := todo.pop()) not in found:
                found.add(n)
                todo += [e.source for e in self.nodes[n].edges if e.kind != "feedback"]
        return found

    def cycle(self, first: str, last: str) -> list[str]:
        """The nodes on the ways from ``first`` to ``last``, in order."""
        found = [n for n in self.order() if n in self.upstream(last) and first in self.upstream(n)]
        if not found:
            raise InvalidAppError(f"{last} does not follow from {first}")
        return found

    def sinks(self) -> list[str]:
        read = {e.source for n in self.nodes.values() for e in n.edges if e.kind != "feedback"}
        return [n for n in self.nodes if n not in read]
