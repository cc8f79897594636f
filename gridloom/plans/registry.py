"""Function signatures and what they become: the rule set of the compiler."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions import library as L
from .graph import ANY, BOOLEAN, DATE, NUMBER, RANGE, TEXT, GraphError

N, T, B, D = NUMBER, TEXT, BOOLEAN, DATE
SCALARS = (N, T, B, D)


def many(t: str) -> str:
    return f"Multiple[{t}]"


def array(t: str) -> str:
    return f"ARRAY[{t}]"


@dataclass(frozen=True)
class Signature:
    """inputs -> output, and the column builder (None: a rewrite must remove the call)."""

    inputs: tuple[str, ...]
    output: str
    build: Callable | None = None
    source: str = "engine"


def is_match(given: str | None, declared: str, permissive: bool = True) -> bool:
    if given == declared or given is None:
        return given == declared or permissive
    if not permissive:
        return False
    if declared == ANY:
        return given in SCALARS
    if declared == RANGE:
        return given.startswith(("ARRAY", "TABLE_COLUMN"))
    if declared.startswith("ARRAY["):
        return given.startswith("ARRAY[") and is_match(given[6:-1], declared[6:-1])
    if declared.startswith("TABLE_COLUMN["):
        return given.startswith("TABLE_COLUMN[") and is_match(given[13:-1], declared[13:-1])
    return False


def fits(given: list[str | None], declared: tuple[str, ...], mode: str = "permissive") -> bool:
    """exact: equal lists; strict: equal elements and a trailing Multiple; permissive: wildcards too."""
    if mode == "exact":
        return list(given) == list(declared)
    loose = mode == "permissive"
    if any(d.startswith("Multiple[") for d in declared[:-1]):
        raise GraphError("Multiple must be last")
    if declared and declared[-1].startswith("Multiple["):
        head, rest = declared[:-1], declared[-1][9:-1]
        return len(given) > len(head) and all(is_match(g, d, loose) for g, d in zip(given, head)) and all(is_match(g, rest, loose) for g in given[len(head) :])
    return len(given) == len(declared) and all(is_match(g, d, loose) for g, d in zip(given, declared))


@dataclass
class RuleSet:
    """Signatures by function name, rewrites, macros. A merge puts the other's rules first."""

    signatures: dict[str, list[Signature]] = field(default_factory=dict)
    transforms: list = field(default_factory=list)
    protects: list = field(default_factory=list)
    macros: dict[str, object] = field(default_factory=dict)
    idle: dict[str, object] = field(default_factory=dict)  #: macros whose names stay native

    def function(self, name: str, inputs: tuple[str, ...], output: str, build: Callable | None, source: str = "user") -> RuleSet:
        self.signatures.setdefault(name.upper(), []).insert(0 if source == "user" else len(self.signatures.get(name.upper(), [])), Signature(tuple(inputs), output, build, source))
        return self

    def find(self, name: str, given: list[str | None]) -> Signature | None:
        return next((s for s in self.signatures.get(name, []) if fits(given, s.inputs)), None)

    def merge(self, over: RuleSet) -> RuleSet:
        names = {**self.signatures, **over.signatures}
        macros = {n: g for n, g in self.macros.items() if n not in over.idle} | over.macros
        idle = {n: g for n, g in (self.idle | over.idle).items() if n not in macros}
        return RuleSet({n: over.signatures.get(n, []) + self.signatures.get(n, []) for n in names}, over.transforms + self.transforms, over.protects + self.protects, macros, idle)

    def add_macro(self, name: str, graph, active: bool = True) -> RuleSet:
        """A function that is a graph; its inputs are its arguments in order. An inactive one waits beside the native function."""
        self.idle[name.upper()] = graph
        return self.use_macro(name) if active else self

    def use_macro(self, *names: str) -> RuleSet:
        """Let macros stand for their functions; GraphError, and nothing changed, if they form a circle."""
        missing = [n for n in names if n.upper() not in self.idle and n.upper() not in self.macros]
        if missing:
            raise GraphError(f"there is no macro {', '.join(missing)}")
        macros = self.macros | {n.upper(): self.idle[n.upper()] for n in names if n.upper() in self.idle}
        check_macros(macros)
        self.macros = macros
        self.idle = {n: g for n, g in self.idle.items() if n not in macros}
        return self

    def use_native(self, *names: str) -> RuleSet:
        """Let the native columns stand for these functions again."""
        for n in names:
            if n.upper() in self.macros:
                self.idle[n.upper()] = self.macros.pop(n.upper())
        return self

    def to_json(self) -> str:
        """Signatures (without builders), macros in use and idle, rewrites with their protected patterns."""
        graphs = lambda m: {n: g.to_json() for n, g in m.items()}
        transforms = [{"name": t.name, "from": t.pattern.to_json(), "to": t.target.to_json(), "protect": [p.to_json() for p in t.protect]} for t in self.transforms]
        return json.dumps({"signatures": {n: [{"inputs": s.inputs, "output": s.output, "coded": s.build is not None, "source": s.source} for s in v] for n, v in self.signatures.items()}, "macros": graphs(self.macros), "idle": graphs(self.idle), "transforms": transforms, "protects": [p.to_json() for p in self.protects]})

    @classmethod
    def from_json(cls, text: str, builders: RuleSet | None = None) -> RuleSet:
        """Signatures get their builders from ``builders`` where it has equal ones.

        Signatures may also be in the wide form: a list of outputs, and text for code generators, which is ignored.
        """
        from .graph import Graph
        from .rewrite import Transform

        d, out = json.loads(text), cls()
        for n, v in d.get("signatures", {}).items():
            for s in v:
                known = next((b.build for b in (builders or cls()).signatures.get(n.upper(), []) if b.inputs == tuple(s["inputs"])), None)
                output = s["output"] if "output" in s else s["outputs"][0]
                out.signatures.setdefault(n.upper(), []).append(Signature(tuple(s["inputs"]), output, known, s.get("source", "file")))
        out.macros = {n: Graph.from_json(g) for n, g in d.get("macros", {}).items()}
        out.idle = {n: Graph.from_json(g) for n, g in d.get("idle", {}).items()}
        own = [t for t in d.get("transforms", []) if isinstance(t, dict) and "from" in t]  # the wide form's are files of their own
        out.transforms = [Transform(t["name"], Graph.from_json(t["from"]), Graph.from_json(t["to"]), tuple(map(Graph.from_json, t.get("protect", [])))) for t in own]
        out.protects = list(map(Graph.from_json, d.get("protects", [])))
        return out


def prepared(mode: str, libraries: RuleSet, language: RuleSet | None = None, own: RuleSet | None = None) -> RuleSet:
    """The rules of one calculation. build: language over libraries; supplement: its own over both;
    complete: its own alone."""
    if mode not in ("build", "supplement", "complete"):
        raise ValueError(f"there is no mode {mode}")
    if (mode != "complete" and language is None) or (mode != "build" and own is None):
        raise ValueError(f"rules are missing for mode {mode}")
    if mode == "complete":
        return own
    built = libraries.merge(language)
    return built if mode == "build" else built.merge(own)


def check_macros(macros: dict) -> None:
    """GraphError if macros call each other in a circle."""
    uses = {n: {x.name for x in g.nodes.values() if x.kind == "function" and x.name in macros} for n, g in macros.items()}
    done: set[str] = set()
    path: list[str] = []

    def visit(n: str) -> None:
        if n in path:
            raise GraphError("macros form a circle: " + " -> ".join([*path[path.index(n) :], n]))
        if n not in done:
            path.append(n)
            for m in sorted(uses[n]):
                visit(m)
            path.pop()
            done.add(n)

    for n in uses:
        visit(n)


def standard() -> RuleSet:
    """The rules of the engine."""
    r = RuleSet()

    def f(name: str, inputs: tuple, output: str, build: Callable | None) -> None:
        r.function(name, inputs, output, build, "engine")

    f("+", (D, N), D, L.date_add)
    f("-", (D, N), D, L.date_sub)
    f("-", (D, D), N, lambda a, b: F.datediff(a, b).cast("double"))
    for op, fn in (("+", L.add), ("-", L.subtract), ("*", L.multiply), ("/", L.divide), ("^", L.power), ("MOD", L.modulo), ("%", L.modulo)):
        f(op, (N, N), N, fn)
    for a in (array(B), "TABLE_COLUMN[Boolean]"):
        for b in (B, N):
            f("*", (a, f"{a.split('[')[0]}[{b}]"), f"{a.split('[')[0]}[Number]", L.array_mask_times)
    for name, fn in (("N", L.negate), ("ABS", lambda x: F.abs(L.num(x))), ("SQRT", lambda x: F.when(L.num(x) >= 0, F.sqrt(L.num(x)))), ("EXP", lambda x: F.exp(L.num(x))), ("LN", lambda x: F.ln(L.num(x))), ("LOG10", L.log), ("LOG", L.log), ("FACT", L.fact), ("EVEN", L.even), ("ODD", L.odd), ("INT", L.integer), ("TRUNC", L.truncate), ("FISHER", L.fisher), ("FISHERINV", L.fisher_inverse), ("NORMSDIST", L.norm_s_dist), ("NORMSINV", L.norm_s_inv), ("ISLEAPYEAR", L.is_leap_year), ("YEAR", L.year), ("MONTH", L.month), ("DAY", L.day), ("HOUR", L.hour), ("MINUTE", L.minute), ("SECOND", L.second)):
        f(name, (N,), N, fn)
    for t in ("SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN"):
        f(t, (N,), N, lambda x, t=t: getattr(F, t.lower())(L.num(x)))
    for name, fn in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth)):
        f(name, (D,), N, lambda x, fn=fn: fn(x).cast("double"))
    f("LOG", (N, N), N, L.log)
    for name, fn in (("CEILING", L.ceiling), ("FLOOR", L.floor_to), ("COMBIN", L.combin), ("PERMUT", L.permut), ("ROUND", L.round_half_away), ("ROUNDDOWN", L.round_down), ("ROUNDUP", L.round_up), ("TRUNC", L.truncate)):
        f(name, (N, N), N, fn)
    f("DATE", (N, N, N), N, L.date)
    f("TIME", (N, N, N), N, L.time)
    f("SLN", (N, N, N), N, L.sln)
    f("SYD", (N, N, N, N), N, L.syd)
    for name, fn, least, most in (("FV", L.fv, 3, 5), ("PV", L.pv, 3, 5), ("PMT", L.pmt, 3, 5), ("NPER", L.nper, 3, 5), ("IPMT", L.ipmt, 4, 6), ("PPMT", L.ppmt, 4, 6)):
        for n in range(least, most + 1):
            f(name, (N,) * n, N, fn)
    f("NPV", (N, many(N)), N, L.npv)
    for n in (2, 3):
        f("YEARFRAC", (D, D, N)[:n], N, L.yearfrac)
        f("DAYS360", (D, D, ANY)[:n], N, L.days360)
        f("YEARFRAC", (N, N, N)[:n], N, lambda a, b, *k: L.yearfrac(L.from_serial(a), L.from_serial(b), *k))
        f("DAYS360", (N, N, ANY)[:n], N, lambda a, b, *k: L.days360(L.from_serial(a), L.from_serial(b), *k))
    f("EOMONTH", (D, N), D, L.eomonth)
    compare = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}
    for op, method in compare.items():
        for t in SCALARS:
            f(op, (t, t), B, lambda a, b, m=method: getattr(a, m)(b))
            f(op, (array(t), t), array(B), lambda a, v, m=method: L.array_compare(a, v, lambda x, y: getattr(x, m)(y)))
            f(op, (f"TABLE_COLUMN[{t}]", t), "TABLE_COLUMN[Boolean]", lambda a, v, m=method: L.array_compare(a, v, lambda x, y: getattr(x, m)(y)))
    for name, fn in (("AND", L.and_), ("OR", L.or_)):
        f(name, (many(B),), B, fn)
        f(name, (many(ANY),), B, fn)
        f(name + "2", (B, B), B, fn)
        f(name + "2", ("TABLE_COLUMN[Boolean]",) * 2, "TABLE_COLUMN[Boolean]", lambda a, b, fn=fn: F.zip_with(a, b, fn))
    f("AND", (array(B),), B, lambda a: F.forall(a, lambda x: x))
    f("OR", (array(B),), B, lambda a: F.exists(a, lambda x: x))
    f("NOT", (ANY,), B, L.not_)
    for t in SCALARS:
        f("IF", (ANY, t, t), t, L.if_)
        f("ISNA", (t,), B, L.is_na)
        f("FILTER", (array(t), array(B), t), array(t), L.array_filter)
        for a in (array(t), f"TABLE_COLUMN[{t}]"):
            mask = "ARRAY[Boolean]" if a.startswith("ARRAY") else "TABLE_COLUMN[Boolean]"
            f("SC_FIRST_TRUE", (a, mask, t), t, L.first_true)
            f("INDEX", (a, N), t, L.index)
            f("MATCH", (t, a, N), N, None)
            f("MATCH", (t, a), N, lambda v, k: L.match(v, k, 1))
            f("MIN", (a,), t, F.array_min)
            f("MAX", (a,), t, F.array_max)
            for u in SCALARS:
                v = f"{a.split('[')[0]}[{u}]"
                f("LOOKUP", (t, a, v), u, lambda x, k, w: L.vlookup(x, k, w))
                f("LOOKUP_EXACT_MATCH_1", (a, t, v, ANY), u, lambda k, x, w, d: F.coalesce(L.vlookup(x, k, w, False), d))
                f("LOOKUP_INEXACT_MATCH_1", (a, t, v, ANY), u, lambda k, x, w, d: F.coalesce(L.vlookup(x, k, w), d))
        f("ARRAY", (N, N, many(t)), array(t), None)
    f("IF", (ANY, B), B, L.if_)
    f("&", (ANY, ANY), T, L.concat)
    f("MID", (T, N, N), T, L.mid)
    for name, fn, arr in (("SUM", L.add, L.array_sum), ("PRODUCT", L.multiply, L.array_product), ("MIN", L.minimum, F.array_min), ("MAX", L.maximum, F.array_max), ("AVERAGE", L.average, L.array_average), ("MEDIAN", lambda *a: L.array_median(F.array(*a)), L.array_median), ("MODE", lambda *a: L.array_mode(F.array(*a)), L.array_mode), ("AVEDEV", lambda *a: L.array_avedev(F.array(*a)), L.array_avedev), ("COUNT", lambda *a: L.array_count(F.array(*a)), L.array_count), ("COUNTA", lambda *a: L.array_count(F.array(*a)), L.array_count), ("COUNTBLANK", lambda *a: L.array_count_blank(F.array(*a)), L.array_count_blank)):
        f(name, (array(N),), N, arr)
        f(name, ("TABLE_COLUMN[Number]",), N, arr)
        f(name, (many(N),), N, fn)
        if name in ("MIN", "MAX"):
            f(name, (many(D),), D, fn)
    for t in SCALARS:
        for u in SCALARS:
            # What VLOOKUP and HLOOKUP become once their table is cut into vectors.
            f("VECTOR_LOOKUP", (t, array(t), array(u), B), u, L.vector_lookup)
    f("PERCENTILE", (array(N), N), N, L.array_percentile)
    f("PERCENTRANK", (array(N), N), N, L.array_percent_rank)
    f("SUMPRODUCT", (many(array(N)),), N, L.sum_product)
    f("SUMPRODUCT", (N,), N, L.num)
    f("SUMNUM", (many(ANY),), N, lambda *a: L.add(*[F.coalesce(x.try_cast("double"), F.lit(0.0)) for x in a]))
    return r
