"""Verification: expected against predicted outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .compiler import SPARK_TYPES, CompileReport, Plan, compile_graph, safe_name
from .graph import DATE, NUMBER, Graph

TOLERANCE = 0.01
LEAST_CASES = 10


def case_table(spark: SparkSession, graph: Graph, least: int = LEAST_CASES) -> DataFrame:
    """scenario_id, the inputs and expected outputs of a graph's cases."""
    if len(graph.cases) < least:
        raise ValueError(f"{graph.name} has {len(graph.cases)} cases; {least} are needed")
    fields = [(graph.nodes[k].name, SPARK_TYPES[graph.nodes[k].type]) for k in graph.inputs]
    kinds = [_kind(v) for v in graph.cases[0][1]]
    fields += [(safe_name(o), t) for o, t in zip(graph.outputs, kinds)]
    rows = [(i, *a, *b) for i, (a, b) in enumerate(graph.cases)]
    return spark.createDataFrame(rows, ", ".join(["scenario_id int", *[f"`{n}` {t}" for n, t in fields]]))


def _kind(v: object) -> str:
    from .rewrite import type_of

    return SPARK_TYPES[type_of(v)]


def predict(plan: Plan, df: DataFrame, suffix: str = "_predicted") -> DataFrame:
    """df with one predicted column for each output of the plan."""
    named = Plan(plan.graph, plan.rules, CompileReport(), plan.trade_off, plan.threshold)
    g = plan.graph
    named.graph = type(g)(g.name, g.nodes, g.inputs, {f"{safe_name(o)}{suffix}": k for o, k in g.outputs.items()}, g.tables, g.cases)
    return named.apply(df)


def is_right(expected: Column, predicted: Column, type: str, tolerance: float = TOLERANCE) -> Column:
    """Numbers within the tolerance, dates and others exactly; a missing value is wrong unless both miss."""
    same = F.abs(expected - predicted) <= tolerance if type == NUMBER else F.datediff(expected, predicted) == 0 if type == DATE else expected == predicted
    return F.coalesce(same, expected.isNull() & predicted.isNull())


def mismatches(df: DataFrame, outputs: dict[str, str], tolerance: float = TOLERANCE, suffix: str = "_predicted") -> DataFrame:
    """Rows where an output (name -> type) differs from its prediction."""
    wrong = F.lit(False)
    for o, t in outputs.items():
        wrong = wrong | ~is_right(F.col(o), F.col(o + suffix), t, tolerance)
    return df.where(wrong)


def accuracy(df: DataFrame, outputs: dict[str, str], tolerance: float = TOLERANCE, suffix: str = "_predicted") -> DataFrame:
    """One row: right predictions by output, all_correct, total."""
    right = {o: is_right(F.col(o), F.col(o + suffix), t, tolerance) for o, t in outputs.items()}
    every = F.lit(True)
    for c in right.values():
        every = every & c
    return df.agg(*[F.count_if(c).alias(f"{o}_correct") for o, c in right.items()], F.count_if(every).alias("all_correct"), F.count("*").alias("total"))


def verify(spark: SparkSession, graph: Graph, rules=None) -> tuple[DataFrame, DataFrame]:
    """(accuracy, mismatches) of a graph on its own cases."""
    plan = compile_graph(graph, rules=rules)
    done = predict(plan, case_table(spark, graph))
    outputs = {safe_name(o): plan.graph.nodes[k].type for o, k in plan.graph.outputs.items()}
    return accuracy(done, outputs), mismatches(done, outputs)
