"""From a graph to DataFrames: one logical plan per sink, left to Catalyst as a whole."""

from __future__ import annotations

import inspect
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.plans.graph import DEFAULT, STREAM, Edge, Graph, Node


def take_streams(df: DataFrame, edge: Edge) -> DataFrame:
    """The rows of the streams that ``edge`` subscribes to; without ``_stream`` all rows are on the default one."""
    if STREAM in df.columns:
        return df.where(F.col(STREAM).isin(*edge.streams)).drop(STREAM)
    return df if DEFAULT in edge.streams else df.where(F.lit(False))


def disperse(df: DataFrame, edge: Edge, instances: int) -> DataFrame:
    """Reduce edges with several instances co-locate keys; round robin needs no exchange, as Spark deals rows anyhow. What the edge's envelope adds is there before."""
    if edge.envelope is not None:
        df = edge.envelope(df)
    if edge.kind == "custom":
        return edge.partitioner(df, instances)
    if edge.kind == "reduce" and instances > 1:
        return df.repartition(instances, edge.key)
    return df


def merged(frames: list[DataFrame]) -> DataFrame:
    """Bag union by name; absent fields are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def node_output(node: Node, spark: SparkSession, outputs: dict[str, DataFrame]) -> DataFrame:
    if node.source is not None:
        return node.source(spark)
    return run_body(node, [disperse(take_streams(outputs[e.source], e), e, node.instances) for e in node.edges if e.kind != "feedback"])


def run_body(node: Node, frames: list[DataFrame]) -> DataFrame:
    body = node.alternates[node.active]
    needed = [p for p in inspect.signature(body).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    return body(merged(frames), node.signal) if len(needed) > 1 else body(merged(frames))


def unrolled(graph: Graph, first: Node, edge: Edge, outputs: dict[str, DataFrame]) -> None:
    """Adds to the ``outputs`` of a cycle what each round of ``edge`` gives."""
    cycle = graph.cycle(first.name, edge.source)
    rounds = {n: [outputs[n]] for n in cycle}
    for _ in range(edge.rounds):
        now: dict[str, DataFrame] = {}
        for name in cycle:
            node = graph.nodes[name]
            frames = [take_streams(rounds[edge.source][-1], edge)] if name == first.name else []
            frames += [disperse(take_streams(now[e.source], e), e, node.instances) for e in node.edges if e.source in now and e.kind != "feedback"]
            now[name] = run_body(node, frames)
        for name in cycle:
            rounds[name].append(now[name])
    for name in cycle:
        outputs[name] = merged(rounds[name])


def compile_graph(graph: Graph, spark: SparkSession, inputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The output of every node; ``inputs`` replace nodes by given DataFrames, bounded or streaming."""
    graph.validate()
    outputs: dict[str, DataFrame] = dict(inputs or {})
    order = graph.order()

    def run(names: list[str]) -> None:
        for name in names:
            if name not in outputs:
                outputs[name] = node_output(graph.nodes[name], spark, outputs)

    for name in order:
        for edge in graph.nodes[name].edges:
            if edge.kind == "feedback":
                before = graph.upstream(edge.source)
                run([n for n in order if n in before])
                unrolled(graph, graph.nodes[name], edge, outputs)
    run(order)
    return outputs


def run_batch(graph: Graph, spark: SparkSession, inputs: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The output of every sink."""
    outputs = compile_graph(graph, spark, inputs)
    return {s: outputs[s] for s in graph.sinks()}
