"""Graphs to DataFrames: lowered to columns, lookups to joins, stages where sharing pays."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import lookups
from .graph import BOOLEAN, DATE, NUMBER, TEXT, Graph, from_formulas
from .registry import RuleSet, standard
from .rewrite import Transform, array_values, drop_constant_conditions, infer_types, lookup_transforms, rewrite, split_column, type_of

SPARK_TYPES = {NUMBER: "double", TEXT: "string", BOOLEAN: "boolean", DATE: "date"}
RESERVED = {"select", "from", "where", "group", "order", "by", "join", "table", "case", "when", "then", "else", "end", "and", "or", "not", "null", "true", "false", "union", "all", "as", "on", "in", "is", "limit", "set", "update", "insert", "values", "index", "primary", "key"}


@dataclass
class CompileReport:
    """What the compiler did, for reading and for cutting rule sets down to those used."""

    functions: Counter = field(default_factory=Counter)
    transforms: Counter = field(default_factory=Counter)
    macros: Counter = field(default_factory=Counter)
    stages: list[list[str]] = field(default_factory=list)
    lookups: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in vars(self).items()})

    def used(self, rules: RuleSet) -> RuleSet:
        return RuleSet({n: s for n, s in rules.signatures.items() if n in self.functions}, [t for t in rules.transforms if t.name in self.transforms], rules.protects, {n: g for n, g in rules.macros.items() if g.name in self.macros}, {})


def safe_name(name: str, used: set[str] | None = None) -> str:
    """A column name from a cell's name."""
    out = "".join(c if c.isalnum() or c == "_" else "_" for c in name)
    if out[:1].isdigit() or out.lower() in RESERVED:
        out = f"sc_{out}"
    while used is not None and out in used:
        out += "_"
    return out


def type_of_column(spark_type: str) -> str:
    if spark_type in ("date", "timestamp", "timestamp_ntz"):
        return DATE
    if spark_type.startswith("array<"):
        return f"ARRAY[{type_of_column(spark_type[6:-1])}]"
    return {"string": TEXT, "boolean": BOOLEAN}.get(spark_type, NUMBER)


def literal(value: object, type: str) -> Column:
    return F.lit(value).cast(SPARK_TYPES[type])


@dataclass
class Plan:
    """A compiled graph; apply() adds its outputs to any DataFrame that has its inputs."""

    graph: Graph
    rules: RuleSet
    report: CompileReport
    trade_off: int = 15
    threshold: int = 400

    def apply(self, df: DataFrame, keep: bool = True) -> DataFrame:
        """df's columns (or the inputs alone) and one column per output; one row per row."""
        g, columns = self.graph, list(df.columns)
        made: dict[int, Column] = {}
        persist = marked(g, self.trade_off, self.threshold)
        pending: dict[str, Column] = {}
        hidden: list[str] = []
        self.report.stages, self.report.lookups = [], []
        for k in g.order():
            n = g.nodes[k]
            if n.kind == "input":
                made[k] = F.col(f"`{n.name}`")
                if n.type in SPARK_TYPES:
                    made[k] = made[k].cast(SPARK_TYPES[n.type])
            elif n.kind == "constant":
                made[k] = literal(n.value, n.type)
            elif n.kind == "table_column":
                table, column = split_column(n.name)
                made[k] = F.lit(None)  # only lookups and aggregates read table columns
                values = g.tables[table][column]
                made[k] = F.array(*[literal(v, type_of(v) if v is not None else NUMBER) for v in values])
            elif n.name == "ARRAY":
                made[k] = F.array(*[made[a] for a in array_values(g, k)])
            elif n.name == "NULL":
                made[k] = F.lit(None)
            elif n.name.startswith("LOOKUP_") and all(g.nodes[n.args[i]].kind == "table_column" for i in (0, 2)):
                if pending:
                    df, pending = self._stage(df, pending), {}
                name = f"__n{k}"
                df = self._lookup(df, k, made, name)
                hidden.append(name)
                made[k] = F.col(name)
            else:
                found = self.rules.find(n.name, [g.nodes[a].type for a in n.args])
                made[k] = found.build(*[made[a] for a in n.args])
                self.report.functions[n.name] += 1
                if k in persist:
                    name = f"__n{k}"
                    # A stage may use only columns of earlier stages.
                    if any(f"__n{a}" in pending for a in g.order([k])):
                        df, pending = self._stage(df, pending), {}
                    pending[name] = made[k]
                    hidden.append(name)
                    made[k] = F.col(name)
        if pending:
            df = self._stage(df, pending)
        outputs = [made[k].alias(safe_name(o)) for o, k in g.outputs.items()]
        names = {safe_name(o) for o in g.outputs}
        kept = [F.col(f"`{c}`") for c in (columns if keep else [g.nodes[i].name for i in g.inputs]) if c not in names]
        return df.select(*kept, *outputs)

    def _stage(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        self.report.stages.append(list(columns))
        return df.withColumns(columns)

    def _lookup(self, df: DataFrame, k: int, made: dict[int, Column], name: str) -> DataFrame:
        g = self.graph
        n = g.nodes[k]
        table, key = split_column(g.nodes[n.args[0]].name)
        result = split_column(g.nodes[n.args[2]].name)[1]
        reference = reference_table(df, g, table)
        exact = n.name == "LOOKUP_EXACT_MATCH_1"
        self.report.lookups.append(f"{n.name} {table}[{key}] -> {result}")
        # The table comes from the graph, so it is as small as the graph.
        how = lookups.exact_lookup if exact else lookups.asof_lookup
        out = how(df, made[n.args[1]], reference, key, result, name, position="__position", small=len(g.tables[table][key]) <= lookups.BROADCAST_ROWS)
        default = g.nodes[n.args[3]]
        return out if default.kind == "function" and default.name == "NULL" else out.withColumn(name, F.coalesce(F.col(name), made[n.args[3]]))


def reference_table(df: DataFrame, graph: Graph, table: str) -> DataFrame:
    """A table of the graph with its row order."""
    data = graph.tables[table]
    columns = list(data)
    kinds = [SPARK_TYPES[type_of(next((v for v in data[c] if v is not None), None))] for c in columns]
    rows = [(i, *[float(v) if kind == "double" and v is not None else v for v, kind in zip(r, kinds)]) for i, r in enumerate(zip(*data.values()))]
    return df.sparkSession.createDataFrame(rows, ", ".join(["__position int", *[f"`{c}` {t}" for c, t in zip(columns, kinds)]]))


def marked(graph: Graph, trade_off: int, threshold: int) -> set[int]:
    """The calls to keep as columns: those whose sharing saves more than trade_off steps, the least
    such saving first, and then those where an expression would pass threshold steps."""
    order = graph.order()
    consumers = {k: len(c) for k, c in graph.consumers().items()}
    kept: set[int] = set()

    def steps() -> dict[int, int]:
        size: dict[int, int] = {}
        for k in order:
            n = graph.nodes[k]
            size[k] = 0 if n.kind != "function" else 1 + sum(0 if a in kept else size[a] for a in n.args)
        return size

    while True:
        size = steps()
        saving = {k: size[k] * (consumers[k] - 1) for k in order if graph.nodes[k].kind == "function" and graph.nodes[k].name not in ("ARRAY", "NULL") and k not in kept}
        worth = [(s, k) for k, s in saving.items() if s > trade_off]
        if worth:
            kept.add(min(worth)[1])
            continue
        large = [k for k in order if size[k] > threshold and graph.nodes[k].kind == "function"]
        inner = [(size[a], a) for k in large[:1] for a in graph.order([k])[:-1] if a not in kept and graph.nodes[a].kind == "function" and graph.nodes[a].name not in ("ARRAY", "NULL")]
        if not inner:
            return kept
        kept.add(max(inner)[1])


def compile_graph(graph: Graph, columns: dict[str, str] | None = None, rules: RuleSet | None = None, overrides: RuleSet | None = None, trade_off: int = 15, threshold: int = 400) -> Plan:
    """Check, rewrite, type and lower a graph; errors name every call that no rule fits."""
    base = standard()
    base.function("NULL", (), "Any", None, "engine")
    base.transforms = lookup_transforms()
    rules = base.merge(rules) if rules else base
    rules = rules.merge(overrides) if overrides else rules
    graph.validate()
    report = CompileReport()
    out = drop_constant_conditions(rewrite(graph, rules, columns, report))
    out = infer_types(out, rules, columns)
    out.validate()
    return Plan(out, rules, report, trade_off, threshold)


def evaluate(df: DataFrame, formulas: dict[str, str], tables: dict | None = None, rules: RuleSet | None = None, keep: bool = True) -> DataFrame:
    """df with the formulas' values."""
    graph = from_formulas(formulas, tables=tables)
    columns = {c: type_of_column(t) for c, t in df.dtypes}
    return compile_graph(graph, columns, rules).apply(df, keep)


__all__ = ["CompileReport", "Plan", "Transform", "compile_graph", "evaluate"]
