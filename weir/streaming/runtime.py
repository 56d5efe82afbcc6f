"""Applications: graphs that run on streams, with status, signals, switching, scaling and stop.

Sinks without a reduce edge on their way share one query for each streaming
source. Its micro-batches pass the compiled graph as bounded DataFrames in one
``foreachBatch``, so that splits read their input once and every sink of a batch
is written before the batch counts as done. Control rows are looked up at the
start of each batch. A source of the graph that is not a stream comes whole, with
the first batch.

A sink behind a reduce edge is a query of its own: the graph is compiled on the
streaming DataFrames, so that a reduce node's aggregation is Spark's, with its
state in the state store and the checkpoint, and counts go on from batch to batch
and over restarts. The sink gets the groups that changed. Its plan is fixed while
it runs: a switch, a scaling or a signal restarts the query from its checkpoint.
Such a sink cannot also read a source that is not a stream.
"""

from __future__ import annotations

import enum
import math
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from weir.errors import AlternateNotFoundError, AppNotFoundError, DuplicateError, InsufficientResourcesError, InvalidAppError, NodeNotFoundError
from weir.plans.compile import compile_graph
from weir.plans.graph import Graph
from weir.streaming.control import ControlTable

Sink = Callable[[DataFrame, int], None]


class Status(enum.Enum):
    STARTING = "STARTING"
    RUNNING = "RUNNING"
    TERMINATED = "TERMINATED"
    FAILED = "FAILED"


@dataclass
class App:
    graph: Graph
    sinks: dict[str, Sink]
    on_signal: dict[str, Callable[[object], None]]
    teardown: dict[str, Callable[[], None]]
    queries: dict[str, StreamingQuery] = field(default_factory=dict)
    handled: dict[str, float] = field(default_factory=dict)
    restart: dict[str, Callable[[], StreamingQuery]] = field(default_factory=dict)
    stopped: bool = False
    lock: threading.RLock = field(default_factory=threading.RLock)


class Rates(StreamingQueryListener):
    """Rows and state of every query so far, by its name."""

    def __init__(self):
        self.seen: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name:
            self.seen.setdefault(event.name, {"batches": 0, "rows": 0, "state_rows": 0})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name:
            x = self.seen.setdefault(p.name, {"batches": 0, "rows": 0, "state_rows": 0})
            x["batches"] += 1
            x["rows"] += p.numInputRows
            x["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
            x["duration_ms"] = dict(p.durationMs)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class Engine:
    def __init__(self, spark: SparkSession, control_folder: str | None = None):
        self.spark, self.control, self.apps, self.rates = spark, ControlTable(control_folder), {}, Rates()
        spark.streams.addListener(self.rates)

    def submit(
        self,
        name: str,
        graph: Graph,
        inputs: dict[str, DataFrame],
        sinks: dict[str, Sink],
        checkpoint: str,
        trigger: dict | None = None,
        on_signal: dict[str, Callable[[object], None]] | None = None,
        teardown: dict[str, Callable[[], None]] | None = None,
    ) -> App:
        """Start ``graph`` with streaming ``inputs`` in place of its sources; a sink is called with each batch of its node."""
        if name in self.apps and self.status(name) in (Status.STARTING, Status.RUNNING):
            raise DuplicateError(f"application {name} exists")
        graph.validate()
        for node in [*inputs, *sinks]:
            self._node(graph, node)
        if not inputs or not sinks:
            raise InvalidAppError("an application needs a streaming input and a sink")
        keyed = [s for s in sinks if any(e.kind == "reduce" for n in graph.upstream(s) for e in graph.nodes[n].edges)]
        for s in keyed:
            if still := [n for n in graph.upstream(s) if graph.nodes[n].source is not None and n not in inputs]:
                raise InvalidAppError(f"{s} is behind a reduce edge and reads {', '.join(still)}, which is not a stream")
        app = self.apps[name] = App(graph, sinks, on_signal or {}, teardown or {})
        every = trigger or {"processingTime": "1 second"}
        self._apply_controls(name, app)
        for k, (source, df) in enumerate(inputs.items()):
            if plain := [s for s in sinks if s not in keyed]:
                writer = df.writeStream.queryName(f"{name}.{source}").option("checkpointLocation", f"{checkpoint}/{source}")
                app.queries[source] = writer.foreachBatch(self._batch(name, app, source, set(inputs), plain, k == 0)).trigger(**every).start()
        for s in keyed:

            def begin(s=s) -> StreamingQuery:
                df = compile_graph(graph, self.spark, dict(inputs))[s]
                writer = df.writeStream.queryName(f"{name}.{s}").option("checkpointLocation", f"{checkpoint}/{s}.keyed").outputMode("update")
                return writer.foreachBatch(sinks[s]).trigger(**every).start()

            app.restart[s] = begin
            app.queries[s] = begin()
        self.control.report(name, self.status(name).value)
        return app

    def _batch(self, name: str, app: App, source: str, streams: set[str], sinks: list[str], first: bool) -> Sink:
        def run(batch: DataFrame, batch_id: int) -> None:
            with app.lock:
                self._apply_controls(name, app)
                spark = batch.sparkSession
                others = {}
                for n in app.graph.nodes.values():
                    if n.source is not None and n.name != source:
                        rows = n.source(spark)
                        others[n.name] = rows if first and batch_id == 0 and n.name not in streams else rows.limit(0)
                batch.persist()
                try:
                    outputs = compile_graph(app.graph, spark, {source: batch, **others})
                    for node in sinks:
                        app.sinks[node](outputs[node], batch_id)
                finally:
                    batch.unpersist()
            self.control.report(name, self.status(name).value)

        return run

    def poll(self, name: str) -> None:
        """Take the control rows that other processes sent; ``wait`` does it all the time. Restarts what has a fixed plan."""
        app = self._app(name)
        for row in self.control.receive(name):
            if row.kind == "kill":
                self.kill(name)
            elif row.kind == "signal":
                self.signal(name, row.node, row.payload)
            elif row.kind == "alternate":
                self.switch_alternate(name, row.node, row.payload)
            elif row.kind == "scale":
                self.scale(name, row.node, row.payload)
        if not app.stopped:
            self.control.report(name, self.status(name).value)

    def _changed(self, name: str, node: str) -> None:
        """Restart the running queries of fixed plan that ``node`` is part of."""
        app = self._app(name)
        for s, begin in app.restart.items():
            if node in app.graph.upstream(s) and app.queries[s].isActive:
                app.queries[s].stop()
                with app.lock:
                    self._apply_controls(name, app)
                app.queries[s] = begin()

    def _apply_controls(self, name: str, app: App) -> None:
        for node in app.graph.nodes.values():
            if (c := self.control.get(name, node.name, "alternate")) and node.active != c.payload:
                node.use(c.payload)
            if (c := self.control.get(name, node.name, "scale")) and node.instances != c.payload:
                node.parallelism(c.payload)
            c = self.control.get(name, node.name, "signal")
            if c and app.handled.get(node.name) != c.at:
                app.handled[node.name] = c.at
                node.signal = c.payload
                if handler := app.on_signal.get(node.name):
                    handler(c.payload)

    def _app(self, name: str) -> App:
        if name not in self.apps:
            raise AppNotFoundError(name)
        return self.apps[name]

    @staticmethod
    def _node(graph: Graph, node: str):
        found = next((n for k, n in graph.nodes.items() if k.lower() == node.lower()), None)
        if found is None:
            raise NodeNotFoundError(f"{graph.name} has no node {node}")
        return found

    def signal(self, name: str, node: str, payload: object) -> None:
        """The node's handler and its body, on all instances, see the latest payload from the next batch on."""
        found = self._node(self._app(name).graph, node)
        self.control.put(name, found.name, "signal", payload)
        self._changed(name, found.name)

    def switch_alternate(self, name: str, node: str, alternate: str) -> None:
        found = self._node(self._app(name).graph, node)
        if alternate not in found.alternates:
            raise AlternateNotFoundError(f"{node} has no alternate {alternate}")
        self.control.put(name, found.name, "alternate", alternate)
        self._changed(name, found.name)

    def scale(self, name: str, node: str, change: int) -> int:
        """More or fewer instances from the next batch on; gives the new number."""
        found = self._node(self._app(name).graph, node)
        asked = self.control.get(name, found.name, "scale")
        n = max(1, (asked.payload if asked else found.instances) + change)
        if n > self.spark.sparkContext.defaultParallelism:
            raise InsufficientResourcesError(f"{n} instances asked for, {self.spark.sparkContext.defaultParallelism} cores")
        self.control.put(name, found.name, "scale", n)
        self._changed(name, found.name)
        return n

    def status(self, name: str) -> Status:
        app = self._app(name)
        if any(q.exception() is not None for q in app.queries.values()):
            return Status.FAILED
        if app.stopped or (app.queries and not any(q.isActive for q in app.queries.values())):
            return Status.TERMINATED
        return Status.RUNNING if any(q.lastProgress for q in app.queries.values()) else Status.STARTING

    def wait(self, name: str, timeout_s: float | None = None) -> None:
        """Until all queries end, as those with ``availableNow`` do; takes control rows of other processes meanwhile."""
        app, end = self._app(name), time.monotonic() + timeout_s if timeout_s else math.inf
        for key in list(app.queries):
            while not app.queries[key].awaitTermination(0.5):
                self.poll(name)
                if app.stopped or time.monotonic() > end:
                    return

    def kill(self, name: str) -> None:
        """Stop the queries, then run the nodes' teardown hooks."""
        app = self._app(name)
        for q in app.queries.values():
            q.stop()
        app.stopped = True
        for hook in app.teardown.values():
            hook()
        self.control.drop(name)
        self.control.report(name, Status.TERMINATED.value)

    @staticmethod
    def ping(text: str) -> str:
        return text
