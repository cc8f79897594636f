"""Calculation workbooks: XML graphs of versions 3 to 5, and folders of them."""

from __future__ import annotations

import datetime
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Collection
from dataclasses import replace
from pathlib import Path

from ..plans.graph import ANY, BOOLEAN, DATE, NUMBER, RANGE, TEXT, Graph, GraphError, Node
from ..plans.registry import RuleSet
from ..plans.rewrite import Transform, type_of

_CODES = {"0": TEXT, "1": NUMBER, "2": BOOLEAN, "3": DATE, "4": RANGE, "5": ANY}
_TABLE_COLUMN = re.compile(r"\w+\[[^\]]+\]")
_LEVELS = {"10": "address", "100": "alias", "15": "array"}


def parse_value(text: str, type: str) -> object:
    """A value from its text; dates are MM/DD/YYYY with an optional time."""
    if type == NUMBER:
        return float(text)
    if type == BOOLEAN:
        return text.strip().lower() in ("true", "1")
    if type == DATE:
        return datetime.datetime.strptime(text.split(" ")[0], "%m/%d/%Y").date()
    return text


def _type(e: ET.Element) -> str | None:
    t = _get(e, "Type", "type", "data_type", "DataType")
    return _CODES.get(t, t)


def _get(e: ET.Element, *names: str) -> str | None:
    for n in names:
        if n in e.attrib:
            return e.attrib[n]
    return None


def _all(root: ET.Element, *tags: str) -> list[ET.Element]:
    return [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] in tags]


def read_workbook(source: str | Path) -> Graph:
    """The graph in an XML file or text: constants merged, table arrays lifted, inputs and outputs in order."""
    text = str(source)
    root = ET.fromstring(text) if text.lstrip().startswith("<") else ET.parse(text).getroot()
    version = _get(root, "Version", "version") or "5"
    g = Graph(_get(root, "Name", "name") or "calculation")
    early = version.split(".")[0] in ("3", "4")
    raw: dict[str, dict] = {}
    slots: dict[str, str] = {}  # node -> input it stands for
    names: dict[str, dict[str, str]] = {}
    for e in _all(root, "NamedNode"):
        level = _get(e, "NameLevel", "Level", "level") or "alias"
        names.setdefault(_get(e, "NodeId", "node_id"), {})[_LEVELS.get(level, level)] = _get(e, "Name", "NodeName", "name")
    for e in _all(root, "FunctionNode"):
        raw[_get(e, "NodeId", "node_id")] = {"kind": "function", "name": _get(e, "Name", "function_name", "name").upper(), "args": {}}
    for e in _all(root, "ConstantNode"):
        t = _type(e) or TEXT
        raw[_get(e, "NodeId", "node_id")] = {"kind": "constant", "value": parse_value(_get(e, "Value", "value") or "", t), "type": t, "args": {}}
    order: list[tuple[int, str]] = []
    for i, e in enumerate(_all(root, "Input")):
        key = _get(e, "InputId", "input_id", "NodeId", "node_id") or str(i)
        place = int(_get(e, "InputOrder", "input_order") or key)
        name = _get(e, "Name", "input_name", "name") or f"input_{place}"
        order.append((place, name))
        g_key = f"in:{key}"
        raw[g_key] = {"kind": "input", "name": name, "type": _type(e), "args": {}}
        if not early and _get(e, "NodeId", "node_id"):
            slots[_get(e, "NodeId", "node_id")] = g_key
    for e in _all(root, "InputDependency"):
        slots[_get(e, "NodeId", "node_id")] = f"in:{_get(e, 'InputId', 'input_id')}"
    for e in _all(root, "NodeDependency", "Dependency"):
        child, parent = _get(e, "ChildNodeId", "child_node_id"), _get(e, "ParentNodeId", "parent_node_id")
        raw[child]["args"][int(_get(e, "ParentPosition", "parent_position"))] = parent
    made: dict[str, int] = {}
    for _, name in sorted(order):
        k = next(k for k, r in raw.items() if r["kind"] == "input" and r["name"] == name)
        made[k] = g.add(Node("input", name, type=raw[k]["type"]))

    def build(key: str) -> int:
        key = slots.get(key, key)
        stack = [key]
        while stack:
            k = slots.get(stack[-1], stack[-1])
            if k in made:
                stack.pop()
                continue
            r = raw[k]
            args = [slots.get(a, a) for _, a in sorted(r["args"].items())]
            waiting = [a for a in args if a not in made]
            if waiting:
                if len(stack) > 10 * len(raw) + 10:
                    raise GraphError(f"{g.name}: nodes form a circle")
                stack += waiting
                continue
            label = names.get(k, {})
            label = label.get("alias") or label.get("address") or label.get("array")
            ids = tuple(made[a] for a in args)
            if r["kind"] == "function" and r["name"] == "ARRAY" and label and _TABLE_COLUMN.fullmatch(label) and all(g.nodes[a].kind == "constant" for a in ids):
                table, column = label.split("[")
                g.tables.setdefault(table, {})[column[:-1]] = [g.nodes[a].value for a in ids[2:]]
                made[k] = g.add(Node("table_column", label))
            else:
                made[k] = g.add(Node(r["kind"], r.get("name", ""), r.get("value"), r.get("type"), ids))
            stack.pop()
        return made[key]

    outputs = sorted(_all(root, "Output"), key=lambda e: int(_get(e, "Id", "output_order", "OutputOrder") or 0))
    for e in outputs:
        g.outputs[_get(e, "Name", "output_name", "name")] = build(_get(e, "NodeId", "node_id"))
    types_in = [_type(e) for _, e in sorted(((int(_get(e, "InputId", "input_order", "InputOrder") or i), e) for i, e in enumerate(_all(root, "Input"))), key=lambda p: p[0])]
    for case in _all(root, "TestCase"):
        values = [parse_value(_get(v, "Value", "value"), _type(v) or t or TEXT) for v, t in zip(_all(case, "InputValue"), types_in)]
        g.cases.append((values, [parse_value(_get(v, "Value", "value"), _type(v) or NUMBER) for v in _all(case, "OutputValue")]))
    # Cells whose tables columns differ in length are no table.
    for t, columns in g.tables.items():
        if len({len(v) for v in columns.values()}) != 1:
            raise GraphError(f"the columns of {t} differ in length")
    keep = g.order()
    g.nodes = {k: n for k, n in g.nodes.items() if k in keep or n.kind == "input"}
    return g


def read_macros(folder: str | Path, rules: RuleSet | None = None, native: Collection[str] = ()) -> RuleSet:
    """Every workbook of a folder as a function of its name; circles are an error.

    Names in ``native`` (such as ``standard().signatures``) stay with their native columns until
    ``use_macro`` says otherwise, so a library whose functions call each other in circles can be loaded whole.
    """
    rules = rules or RuleSet()
    for path in sorted(Path(folder).iterdir()):
        if path.suffix.lower() == ".xml":
            name = path.stem.upper()
            rules.add_macro(name, replace(read_workbook(path), name=name), active=name not in native)
    return rules


def read_signatures(folder: str | Path, builders: RuleSet) -> RuleSet:
    """The signature files (func_sig_*.json) of a folder; builders come from rules that have them."""
    out = RuleSet()
    for path in sorted(Path(folder).glob("func_sig_*.json")):
        data = json.loads(path.read_text())
        own = RuleSet.from_json(json.dumps(data if "signatures" in data else {"signatures": data}), builders)
        for name, found in own.signatures.items():
            have = out.signatures.setdefault(name, [])
            have += [s for s in found if s.inputs not in {h.inputs for h in have}]
    return out


def convert_folder(source: str | Path, target: str | Path) -> list[str]:
    """Write every workbook of a folder, of whatever version, as version 5; the names written."""
    Path(target).mkdir(parents=True, exist_ok=True)
    names = []
    for path in sorted(Path(source).iterdir()):
        if path.suffix.lower() == ".xml":
            (Path(target) / path.name).write_text(write_workbook(read_workbook(path)))
            names.append(path.name)
    return names


def read_transforms(folder: str | Path) -> list[Transform]:
    """Every workbook of a folder as a rewrite: its first output to its second; further ones are protected."""
    out = []
    for path in sorted(Path(folder).iterdir()):
        if path.suffix.lower() == ".xml":
            g = read_workbook(path)
            if len(g.outputs) < 2 or g.name != path.stem:
                raise GraphError(f"{path.name} needs two outputs and the name of its file")
            names = list(g.outputs)
            parts = [replace(g, outputs={n: g.outputs[n]}) for n in names]
            out.append(Transform(g.name, parts[0], parts[1], tuple(parts[2:])))
    return out


def write_workbook(graph: Graph) -> str:
    """The graph as XML of version 5."""
    root = ET.Element("CodeCalculation", Name=graph.name, Version="5")
    inputs = ET.SubElement(root, "Inputs")
    for i, k in enumerate(graph.inputs):
        ET.SubElement(inputs, "Input", NodeId=str(k), InputOrder=str(i), Name=graph.nodes[k].name, Type=graph.nodes[k].type or ANY)
    functions, constants, edges, outputs = (ET.SubElement(root, t) for t in ("FunctionNodes", "ConstantNodes", "NodeDependencies", "Outputs"))
    for k, n in graph.nodes.items():
        if n.kind == "function":
            ET.SubElement(functions, "FunctionNode", NodeId=str(k), Name=n.name)
            for i, a in enumerate(n.args):
                ET.SubElement(edges, "NodeDependency", ParentNodeId=str(a), ChildNodeId=str(k), ParentPosition=str(i))
        elif n.kind == "constant":
            value = n.value.strftime("%m/%d/%Y") if n.type == DATE else str(n.value)
            ET.SubElement(constants, "ConstantNode", NodeId=str(k), Type=n.type, Value=value)
    for i, (name, k) in enumerate(graph.outputs.items()):
        ET.SubElement(outputs, "Output", Id=str(i), Name=name, NodeId=str(k))
    cases = ET.SubElement(root, "TestCases")
    for given, wanted in graph.cases:
        case = ET.SubElement(cases, "TestCase")
        for tag, values in (("InputValue", given), ("OutputValue", wanted)):
            for v in values:
                ET.SubElement(case, tag, Value=v.strftime("%m/%d/%Y") if isinstance(v, datetime.date) else str(v), Type=type_of(v))
    return ET.tostring(root, encoding="unicode")
