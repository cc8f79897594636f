"""All queries of the engine with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import library as L
from .functions import macros
from .operators import cube, lookups
from .plans.compiler import compile_graph, evaluate, type_of_column
from .plans.graph import NUMBER, Graph, from_formulas
from .plans.registry import RuleSet
from .plans.verify import accuracy, mismatches, predict
from .sources.tables import read_table
from .streaming.incremental import sessions, windowed_sums

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# One formula per output over one table -------------------------------------------------------

_LINE = "l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t, CAST(l_shipdate AS DATE) AS s, l_returnflag AS f"
_ORDER = "o_orderkey AS k, o_totalprice AS p, CAST(o_orderdate AS DATE) AS s, o_orderpriority AS f, CAST(o_orderkey % 360 + 12 AS DOUBLE) AS m, CAST(o_orderkey % 7 + 1 AS DOUBLE) / 1200 AS r, CAST(o_orderkey % 2 AS DOUBLE) AS e"
_PART = "p_partkey AS k, CAST(p_size % 21 AS DOUBLE) AS a, CAST(p_partkey % 11 AS DOUBLE) AS b, p_retailprice AS p"
_CUSTOMER = "c_custkey AS k, c_name AS a, c_mktsegment AS f, c_acctbal AS p"
_BASE = {"lineitem": (_LINE, ["k", "n"]), "orders": (_ORDER, ["k"]), "part": (_PART, ["k"]), "customer": (_CUSTOMER, ["k"])}


def formulas(name: str, table: str, columns: dict[str, tuple[str, str]], digits: int = 6) -> None:
    """A query of formulas with their SQL; Number results are rounded in both."""
    base, keys = _BASE[table]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, table).selectExpr(*_split(base))
        out = evaluate(df, {c: f for c, (f, _) in columns.items()}).select(*keys, *columns)
        return out.select(*keys, *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c in columns])

    _QUERIES[name] = run
    picked = ", ".join(f"{_rounded(sql, digits)} AS {c}" for c, (_, sql) in columns.items())
    _SQL[name] = f"WITH b AS (SELECT {base} FROM {table}) SELECT {', '.join(keys)}, {picked} FROM b"


def _rounded(sql: str, digits: int) -> str:
    return sql[1:] if sql.startswith("!") else f"round(CAST({sql} AS DOUBLE), {digits})"


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]]]


formulas("arith_ops", "lineitem", {"total": ("q + p", "q + p"), "less": ("p - q", "p - q"), "times": ("p * (1 - d) * (1 + t)", "p * (1 - d) * (1 + t)"), "ratio": ("p / (d * 100)", "p / nullif(d * 100, 0)"), "neg": ("-p", "-p"), "pct": ("q%", "q / 100")})
formulas("power_sqrt_abs", "lineitem", {"pw": ("(1 + d) ^ q", "pow(1 + d, q)"), "sq": ("SQRT(p)", "sqrt(p)"), "ab": ("ABS(d - 0.05)", "abs(d - 0.05)")})
formulas("compare_ops", "lineitem", {"gt": ("q > 25", "!(q > 25)"), "lt": ("q < 25", "!(q < 25)"), "ge": ("q >= 25", "!(q >= 25)"), "le": ("q <= 25", "!(q <= 25)"), "eq": ("q = 25", "!(q = 25)"), "ne": ("q <> 25", "!(q <> 25)")})
formulas("bool_ops", "lineitem", {"a2": ("AND(q > 10, d > 0.02, t > 0.01)", "!(q > 10 AND d > 0.02 AND t > 0.01)"), "o2": ("OR(q > 45, d > 0.08, t > 0.07)", "!(q > 45 OR d > 0.08 OR t > 0.07)"), "nt": ("NOT(q > 10)", "!(NOT q > 10)")})
formulas("if_case", "lineitem", {"band": ('IF(q > 40, "large", IF(q > 20, "middle", "small"))', "!(CASE WHEN q > 40 THEN 'large' WHEN q > 20 THEN 'middle' ELSE 'small' END)"), "num": ("IF(n - 1, p, 0)", "CASE WHEN n <> 1 THEN p ELSE 0 END")})
formulas("mod_floor", "lineitem", {"m1": ("MOD(q, 7)", "q - 7 * floor(q / 7)"), "m2": ("MOD(-q, 7)", "-q - 7 * floor(-q / 7)"), "m3": ("MOD(q, -7)", "q + 7 * floor(q / -7)"), "m0": ("MOD(q, n - n)", "CAST(NULL AS DOUBLE)"), "i": ("INT(-p / 100)", "floor(-p / 100)")})
formulas("round_family", "lineitem", {"r0": ("ROUND(-p / 7, 0)", "-floor(p / 7 + 0.5)"), "rm": ("ROUND(p, -2)", "floor(p * pow(10, -2) + 0.5) / pow(10, -2)"), "up": ("ROUNDUP(-p / 7, 1)", "-ceil(p / 7 * pow(10, 1)) / pow(10, 1)"), "dn": ("ROUNDDOWN(-p / 7, 1)", "-floor(p / 7 * pow(10, 1)) / pow(10, 1)"), "tr": ("TRUNC(-p / 7)", "-floor(p / 7)")})
formulas("ceil_floor_sig", "lineitem", {"c": ("CEILING(-q, 4)", "-ceil(q / 4) * 4"), "f": ("FLOOR(-q, 4)", "-floor(q / 4) * 4"), "ev": ("EVEN(q)", "ceil(q / 2) * 2"), "od": ("ODD(-q)", "-(ceil((q + 1) / 2) * 2 - 1)")})
formulas("trig", "lineitem", {"si": ("SIN(q)", "sin(q)"), "co": ("COS(q)", "cos(q)"), "ta": ("TAN(q / 40)", "tan(q / 40)"), "asi": ("ASIN(d)", "asin(d)"), "aco": ("ACOS(d)", "acos(d)"), "ata": ("ATAN(q)", "atan(q)")})
formulas("exp_log", "lineitem", {"ex": ("EXP(d)", "exp(d)"), "l": ("LN(p)", "ln(p)"), "lt": ("LOG10(p)", "log10(p)"), "lb": ("LOG(p, 2)", "ln(p) / ln(2)"), "l0": ("LN(n - n)", "CAST(NULL AS DOUBLE)")})
formulas("fact_combin_permut", "part", {"fa": ("FACT(a)", "CAST(factorial(CAST(a AS INT)) AS DOUBLE)"), "cb": ("COMBIN(a, b)", "CASE WHEN b <= a THEN round(CAST(factorial(CAST(a AS INT)) AS DOUBLE) / (CAST(factorial(CAST(b AS INT)) AS DOUBLE) * CAST(factorial(CAST(a - b AS INT)) AS DOUBLE))) END"), "pm": ("PERMUT(a, b)", "CASE WHEN b <= a THEN round(CAST(factorial(CAST(a AS INT)) AS DOUBLE) / CAST(factorial(CAST(a - b AS INT)) AS DOUBLE)) END")}, 0)
formulas("date_add_days", "orders", {"later": ("s + m", "!(s + CAST(m AS INT))"), "earlier": ("s - m", "!(s - CAST(m AS INT))"), "apart": ("s + m - s", "CAST(m AS INT)")})
formulas("date_parts", "orders", {"y": ("YEAR(s)", "year(s)"), "mo": ("MONTH(s)", "month(s)"), "dd": ("DAY(s)", "day(s)"), "leap": ("ISLEAPYEAR(YEAR(s))", "CASE WHEN (year(s) % 4 = 0 AND year(s) % 100 <> 0) OR year(s) % 400 = 0 THEN 1 ELSE 0 END")})
formulas("serial_date", "orders", {"dt": ("DATE(YEAR(s), MONTH(s) + 3, DAY(s))", "datediff('day', DATE '1899-12-30', CAST(date_trunc('month', s) + INTERVAL 3 MONTH AS DATE)) + day(s) - 1"), "yy": ("YEAR(DATE(YEAR(s), 12, 31))", "year(s)"), "mm": ("MONTH(DATE(YEAR(s), 2, 30))", "3"), "first": ("DATE(1900, 1, 1)", "1")})
formulas("time_parts", "orders", {"ti": ("TIME(k, 30, 15)", "k / 24.0 + 30 / 1440.0 + 15 / 86400.0"), "h": ("HOUR(TIME(k, 30, 15))", "k % 24"), "mi": ("MINUTE(TIME(k, 30, 15))", "30"), "se": ("SECOND(TIME(k, 30, 15))", "15")})
_US = "(year({b}) - year({a})) * 360 + (month({b}) - month({a})) * 30 + (CASE WHEN {a} = last_day({a}) AND month({a}) = 2 AND {b} = last_day({b}) AND month({b}) = 2 THEN 30 WHEN day({b}) = 31 AND (day({a}) >= 30 OR {a} = last_day({a})) THEN 30 ELSE day({b}) END) - (CASE WHEN {a} = last_day({a}) THEN 30 ELSE least(day({a}), 30) END)"
_EU = "(year({b}) - year({a})) * 360 + (month({b}) - month({a})) * 30 + least(day({b}), 30) - least(day({a}), 30)"
_TO = "(s + CAST(m AS INT))"
formulas("days360", "orders", {"us": ("DAYS360(s, s + m)", _US.format(a="s", b=_TO)), "eu": ("DAYS360(s, s + m, TRUE)", _EU.format(a="s", b=_TO))})
formulas("yearfrac", "orders", {"y0": ("YEARFRAC(s, s + m)", f"({_US.format(a='s', b=_TO)}) / 360.0"), "y2": ("YEARFRAC(s, s + m, 2)", "CAST(m AS INT) / 360.0"), "y3": ("YEARFRAC(s + m, s, 3)", "CAST(m AS INT) / 365.0"), "y4": ("YEARFRAC(s, s + m, 4)", f"({_EU.format(a='s', b=_TO)}) / 360.0"), "y1": ("YEARFRAC(s, s + 10, 1)", "10.0 / CASE WHEN year(s + 10) = year(s) THEN datediff('day', make_date(year(s), 1, 1), make_date(year(s) + 1, 1, 1)) WHEN (((year(s) % 4 = 0 AND year(s) % 100 <> 0) OR year(s) % 400 = 0) AND month(s) < 3) THEN 366 ELSE 365 END")})
formulas("concat_text", "customer", {"c": ('a & ": " & f', "!(a || ': ' || f)"), "mi": ("MID(f, 2, 3)", "!substring(f, 2, 3)")})
formulas("text_equal", "customer", {"same": ('f = "BUILDING"', "!(f = 'BUILDING')"), "other": ('f <> "BUILDING"', "!(f <> 'BUILDING')")})
formulas("sum_row", "lineitem", {"s": ("SUM(q, p, {1, 2; 3, 4})", "q + p + 10"), "pr": ("PRODUCT(q, d, 2)", "q * d * 2"), "av": ("AVERAGE(q, p, d)", "(q + p + d) / 3")})
formulas("min_max_row", "lineitem", {"lo": ("MIN(q, d * 100, t * 100)", "least(q, d * 100, t * 100)"), "hi": ("MAX(q, d * 100, t * 100)", "greatest(q, d * 100, t * 100)")})
formulas("array_stats_row", "lineitem", {"md": ("MEDIAN(q, d * 100, t * 100, 12)", "list_median([q, d * 100, t * 100, 12])"), "ct": ("COUNT(q, d, t)", "3"), "ad": ("AVEDEV(q, 10, 20)", "(abs(q - (q + 30) / 3) + abs(10 - (q + 30) / 3) + abs(20 - (q + 30) / 3)) / 3"), "pc": ("PERCENTILE({1, 2, 3, 4}, d)", "1 + 3 * d"), "mo": ("MODE(2, n, 2, 3)", "2")})
formulas("const_fold_if", "orders", {"kept": ("IF(1 = 1, p * (1 + 2 * 3), p / 0)", "p * 7"), "cut": ("IF(FALSE, 1, p)", "p")}, 2)
_DUE = "(CASE WHEN e = 1 THEN 1 + r ELSE 1 END)"
_PMT = f"(-(p * pow(1 + r, m) + 100) * r / ((pow(1 + r, m) - 1) * {_DUE}))"
_FVK = "(-p * pow(1 + r, {k}) - {pmt} / r * (pow(1 + r, {k}) - 1) * {due})"
_IPMT = f"(({_FVK.format(k='(5 - CASE WHEN e = 1 THEN 2 ELSE 1 END)', pmt=_PMT, due=_DUE)} - CASE WHEN e = 1 THEN {_PMT} ELSE 0 END) * r)"
formulas("fv", "orders", {"v": ("FV(r, m, -100, p, e)", f"-p * pow(1 + r, m) + 100 / r * (pow(1 + r, m) - 1) * {_DUE}"), "v0": ("FV(0, m, -100, p)", "-p + 100 * m"), "v3": ("FV(r, 12, -100)", "100 / r * (pow(1 + r, 12) - 1)")}, 3)
formulas("pv", "orders", {"v": ("PV(r, m, -100, p, e)", f"-p * pow(1 + r, -m) + 100 / r * (1 - pow(1 + r, -m)) * {_DUE}")}, 3)
formulas("pmt", "orders", {"v": ("PMT(r, m, p, 100, e)", _PMT), "v0": ("PMT(0, 12, p)", "-p / 12")})
formulas("ipmt_ppmt", "orders", {"i": ("IPMT(r, 5, m, p, 100, e)", _IPMT), "pp": ("PPMT(r, 5, m, p, 100, e)", f"{_PMT} - {_IPMT}"), "first": ("IPMT(r, 1, m, p, 0, 1)", "0")}, 3)
formulas("nper", "orders", {"v": ("NPER(r, -p, p * 10, 0, e)", f"CASE WHEN (-p * {_DUE}) / (p * 10 * r - p * {_DUE}) > 0 THEN ln((-p * {_DUE}) / (p * 10 * r - p * {_DUE})) / ln(1 + r) END")})
formulas("sln_syd_npv", "orders", {"sl": ("SLN(p, p / 10, m)", "(p - p / 10) / m"), "sy": ("SYD(p, p / 10, m, 3)", "(p - p / 10) * (m - 3 + 1) * 2 / (m * (m + 1))"), "np": ("NPV(r, p, p / 2, -p)", "p / (1 + r) + p / 2 / pow(1 + r, 2) - p / pow(1 + r, 3)")}, 3)
formulas("fisher", "lineitem", {"fi": ("FISHER(d)", "0.5 * ln((1 + d) / (1 - d))"), "inv": ("FISHERINV(d)", "(exp(2 * d) - 1) / (exp(2 * d) + 1)")})


def _horner(x: str, c: tuple) -> str:
    return reduce(lambda acc, k: f"({acc} * {x} + ({k!r}))", reversed(c[:-1]), f"({c[-1]!r})")


# Published coefficients, written out so that the library's own are tested.
_SQL_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_SQL_A = (2.50662827745924, -30.6647980661472, 138.357751867269, -275.928510446969, 220.946098424521, -39.6968302866538)
_SQL_B = (1.0, -13.2806815528857, 66.8013118877197, -155.698979859887, 161.585836858041, -54.4760987982241)
_SQL_C = (2.93816398269878, 4.37466414146497, -2.54973253934373, -2.40075827716184, -0.322396458041136, -0.00778489400243029)
_SQL_D = (1.0, 3.75440866190742, 2.445134137143, 0.32246712907004, 0.00778469570904146)
_Z = "((d - 0.05) * 40)"
_TT = f"(1 / (1 + abs({_Z}) / sqrt(2) / 2))"
_TAIL = f"({_TT} * exp(-{_Z} * {_Z} / 2 + {_horner(_TT, _SQL_ERFC)}) / 2)"
_P = "(0.001 + d * 9.9)"
_Q = "sqrt(-2 * ln({x}))"


def _tail(x: str) -> str:
    q = _Q.format(x=x)
    return f"({_horner(q, _SQL_C)} / {_horner(q, _SQL_D)})"


_CQ = f"({_P} - 0.5)"
formulas("normsdist", "lineitem", {"v": ("NORMSDIST((d - 0.05) * 40)", f"CASE WHEN {_Z} < 0 THEN {_TAIL} ELSE 1 - {_TAIL} END")})
formulas("normsinv", "lineitem", {"v": ("NORMSINV(0.001 + d * 9.9)", f"CASE WHEN {_P} < 0.02425 THEN {_tail(_P)} WHEN {_P} > 0.97575 THEN -{_tail(f'(1 - {_P})')} ELSE {_horner(f'({_CQ} * {_CQ})', _SQL_A)} * {_CQ} / {_horner(f'({_CQ} * {_CQ})', _SQL_B)} END")})

# Functions that SQL spells differently, on the table's own keys ---------------------------------


@query("eomonth", "SELECT o_orderkey AS k, last_day(CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 48 AS INT)) AS DATE)) AS ends FROM orders")
def eomonth(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(o_orderdate AS DATE) AS s", "CAST(o_orderkey % 48 AS DOUBLE) AS m")
    return evaluate(df, {"ends": "EOMONTH(s, m)"}).select("k", "ends")


@query("text_equal_ignoring_case", "SELECT c_custkey AS k, lower(c_mktsegment) = 'building' AS same FROM customer")
def text_equal_ignoring_case(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), L.text_equal(F.col("c_mktsegment"), F.lit("Building")).alias("same"))


_ARRAYS = "WITH b AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings)"


def _arrays(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("a"))


@query("array_stats", f"{_ARRAYS} SELECT k, round(list_sum(a), 5) AS su, round(list_avg(a), 6) AS av, round(list_median(a), 6) AS md, list_min(a) AS lo, list_max(a) AS hi, CAST(len(a) AS DOUBLE) AS n, round(list_avg(list_transform(a, lambda x: abs(x - list_avg(a)))), 6) AS ad FROM b")
def array_stats(spark, sf_dir):
    out = evaluate(_arrays(spark, sf_dir), {"su": "SUM(a)", "av": "AVERAGE(a)", "md": "MEDIAN(a)", "lo": "MIN(a)", "hi": "MAX(a)", "n": "COUNT(a)", "ad": "AVEDEV(a)"})
    return out.select("k", F.round("su", 5).alias("su"), *[F.round(c, 6).alias(c) for c in ("av", "md")], "lo", "hi", "n", F.round("ad", 6).alias("ad"))


@query("array_mask", f"{_ARRAYS} SELECT k, CAST(len(list_filter(a, lambda x: x <= 0)) AS DOUBLE) AS below, round(list_sum(list_transform(a, lambda x: CASE WHEN x <= 0 THEN x ELSE 0 END)), 5) AS masked, round(list_sum(list_transform(a, lambda x: x * x)), 5) AS sp, coalesce(list_filter(a, lambda x: x > 0)[1], -1) AS first FROM b")
def array_mask(spark, sf_dir):
    df = _arrays(spark, sf_dir)
    out = evaluate(df, {"masked": "SUM((a <= 0) * a)", "sp": "SUMPRODUCT(a, a)", "first": "SC_FIRST_TRUE(a, a > 0, -1)"})
    below = F.size(L.array_filter(F.col("a"), L.array_compare(F.col("a"), F.lit(0.0), lambda x, y: x <= y), F.lit(None).cast("double"))).cast("double")
    return out.select("k", below.alias("below"), F.round("masked", 5).alias("masked"), F.round("sp", 5).alias("sp"), "first")


@query("column_stats", "SELECT l_returnflag AS f, round(avg(l_quantity), 6) AS av, round(median(l_quantity), 6) AS md, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def column_stats(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.round(F.avg("l_quantity"), 6).alias("av"), F.round(F.median("l_quantity"), 6).alias("md"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count("l_quantity").alias("n"), F.round(F.percentile("l_quantity", 0.9), 6).alias("p90"))


@query("sum_numbers_only", "SELECT o_orderkey AS k, round(coalesce(try_cast(o_orderstatus AS DOUBLE), 0) + o_totalprice + coalesce(try_cast(substring(o_orderpriority, 1, 1) AS DOUBLE), 0), 2) AS s FROM orders")
def sum_numbers_only(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS a", "o_totalprice AS p", "substring(o_orderpriority, 1, 1) AS f")
    return evaluate(df, {"s": "SUMNUM(a, p, f)"}).select("k", F.round("s", 2).alias("s"))


# Lookups ----------------------------------------------------------------------------------------

_BANDS = {"Bands": {"Low": [1000.0, 20000.0, 50000.0, 100000.0, 200000.0], "Rate": [0.01, 0.03, 0.02, 0.05, 0.04], "Name": ["tiny", "small", "middle", "large", "huge"]}, "Priorities": {"Code": ["1-URGENT", "2-HIGH", "1-URGENT"], "Days": [1.0, 3.0, 9.0]}}
_BANDS_SQL = "WITH bands(low, hi, rate, name) AS (VALUES (1000e0, 20000e0, 1e-2, 'tiny'), (20000e0, 50000e0, 3e-2, 'small'), (50000e0, 100000e0, 2e-2, 'middle'), (100000e0, 200000e0, 5e-2, 'large'), (200000e0, 1e300, 4e-2, 'huge'))"


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_totalprice AS p", "o_orderpriority AS f")


@query("lookup_exact", "SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 1e0 WHEN '2-HIGH' THEN 3e0 END AS days FROM orders")
def lookup_exact(spark, sf_dir):
    return evaluate(_orders(spark, sf_dir), {"days": "INDEX(Priorities[Days], MATCH(f, Priorities[Code], 0))"}, _BANDS).select("k", "days")


@query("lookup_exact_default", "SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 1e0 WHEN '2-HIGH' THEN 3e0 ELSE 7e0 END AS days FROM orders")
def lookup_exact_default(spark, sf_dir):
    match = "INDEX(Priorities[Days], MATCH(f, Priorities[Code], 0))"
    return evaluate(_orders(spark, sf_dir), {"days": f"IF(ISNA({match}), 7, {match})"}, _BANDS).select("k", "days")


@query("lookup_vector", _BANDS_SQL + " SELECT o_orderkey AS k, rate, name FROM orders LEFT JOIN bands ON o_totalprice >= low AND o_totalprice < hi")
def lookup_vector(spark, sf_dir):
    return evaluate(_orders(spark, sf_dir), {"rate": "LOOKUP(p, Bands[Low], Bands[Rate])", "name": "LOOKUP(p, Bands[Low], Bands[Name])"}, _BANDS).select("k", "rate", "name")


@query("max_leq_aggregate", "SELECT o_orderkey AS k, CASE WHEN o_totalprice >= 100000 THEN 5e-2 WHEN o_totalprice >= 20000 THEN 3e-2 WHEN o_totalprice >= 1000 THEN 1e-2 ELSE 0e0 END AS best FROM orders")
def max_leq_aggregate(spark, sf_dir):
    return evaluate(_orders(spark, sf_dir), {"best": "MAX((Bands[Low] <= p) * Bands[Rate])"}, _BANDS).select("k", F.col("best"))


@query("lookup_table_exact", "SELECT c_custkey AS k, coalesce(n_name, '?') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_table_exact(spark, sf_dir):
    out = lookups.exact_lookup(read_table(spark, sf_dir, "customer"), F.col("c_nationkey"), read_table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "nation", default="?")
    return out.select(F.col("c_custkey").alias("k"), "nation")


_ASOF = "SELECT l_orderkey AS k, l_linenumber AS n, o.total FROM lineitem ASOF LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS total FROM orders GROUP BY 1) o ON CAST(l_shipdate AS DATE) >= o.d"


def _asof(spark, sf_dir, small):
    reference = read_table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.max("o_totalprice").alias("total_")) if small is None else read_table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("total_"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").cast("date").alias("s"))
    return lookups.asof_lookup(lines, F.col("s"), reference, "d", "total_", "total", small=small).select("k", "n", "total")


@query("lookup_asof", _ASOF)
def lookup_asof(spark, sf_dir):
    return _asof(spark, sf_dir, None)


@query("lookup_asof_large", _ASOF)
def lookup_asof_large(spark, sf_dir):
    """The way for references beyond the broadcast bound."""
    return _asof(spark, sf_dir, False)


_TEXT_KEYS = "SELECT c_custkey AS k, n_name AS nation FROM customer ASOF LEFT JOIN (SELECT n_name FROM nation) n ON c_mktsegment >= n.n_name"


def _asof_text(spark, sf_dir, small):
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"))
    return lookups.asof_lookup(customers, F.col("value"), read_table(spark, sf_dir, "nation"), "n_name", "n_name", "nation", small=small).select("k", "nation")


@query("lookup_asof_text", _TEXT_KEYS)
def lookup_asof_text(spark, sf_dir):
    return _asof_text(spark, sf_dir, None)


@query("lookup_asof_text_large", _TEXT_KEYS)
def lookup_asof_text_large(spark, sf_dir):
    return _asof_text(spark, sf_dir, False)


_MAX_LEQ = "SELECT l_orderkey AS k, l_linenumber AS n, coalesce(o.best, 0e0) AS best FROM lineitem ASOF LEFT JOIN (SELECT d, max(p) OVER (ORDER BY d) AS best FROM (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS p FROM orders WHERE o_orderkey % 50 = 0 GROUP BY 1)) o ON CAST(l_shipdate AS DATE) >= o.d"


def _max_leq(spark, sf_dir, small):
    orders = read_table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").alias("p"))
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_shipdate").cast("date").alias("s"))
    return lookups.max_leq(lines, F.col("s"), orders, "d", "p", "best", small=small).select("k", "n", "best")


@query("max_leq_table", _MAX_LEQ)
def max_leq_table(spark, sf_dir):
    return _max_leq(spark, sf_dir, None)


@query("max_leq_large", _MAX_LEQ)
def max_leq_large(spark, sf_dir):
    return _max_leq(spark, sf_dir, False)


# Graphs ------------------------------------------------------------------------------------------

_AVERAGE = "SUM(IF(1 > Length, 0, Balance / (1 + Rate) ^ 1), IF(2 > Length, 0, Balance / (1 + Rate) ^ 2)) / Length"
_AVERAGE_SQL = "(CASE WHEN 1 > l_linenumber THEN 0 ELSE l_extendedprice / (1 + l_discount) END + CASE WHEN 2 > l_linenumber THEN 0 ELSE l_extendedprice / pow(1 + l_discount, 2) END) / l_linenumber"


def _loans(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_linenumber").cast("double").alias("Length"), F.col("l_discount").alias("Rate"), F.col("l_extendedprice").alias("Balance"))


@query("formula_avg_balance", f"SELECT l_orderkey AS k, l_linenumber AS n, round({_AVERAGE_SQL}, 4) AS av_bal FROM lineitem")
def formula_avg_balance(spark, sf_dir):
    return evaluate(_loans(spark, sf_dir), {"av_bal": _AVERAGE}).select("k", "n", F.round("av_bal", 4).alias("av_bal"))


def _period() -> RuleSet:
    body = from_formulas({"interest": "b * r", "payment": "-PMT(r, n, b)", "left": "b + b * r - payment"}, "PERIOD", {"n": NUMBER, "r": NUMBER, "b": NUMBER})
    return RuleSet().add_macro("PERIOD", body)


@query("macro_multi_output", "WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS p, l_linenumber + 5.0 AS m, 0.01 + l_discount AS r FROM lineitem) SELECT k, n, round(p * (r * 1.1) - p * (r * 0.9), 4) AS diff, round(p + p * r - p * pow(1 + r, m) * r / (pow(1 + r, m) - 1), 4) AS rest FROM b")
def macro_multi_output(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_extendedprice AS p", "l_linenumber + 5.0D AS m", "0.01D + l_discount AS r")
    graph = from_formulas({"diff": "FUNCTION_ARRAY(PERIOD(m, r * 1.1, p), 1) - FUNCTION_ARRAY(PERIOD(m, r * 0.9, p), 1)", "rest": "FUNCTION_ARRAY(PERIOD(m, r, p), 3)"})
    out = compile_graph(graph, {c: type_of_column(t) for c, t in df.dtypes}, _period()).apply(df)
    return out.select("k", "n", F.round("diff", 4).alias("diff"), F.round("rest", 4).alias("rest"))


_CALLS = {
    "ABS": "100 - p", "CEILING": "100 - p, 7", "FLOOR": "100 - p, 7", "EVEN": "q - 20", "ODD": "q - 20", "INT": "20 - p", "TRUNC": "20 - p, 1", "MOD": "20 - q, 7", "ROUND": "20 - p, 1", "ROUNDDOWN": "20 - p, 1", "ROUNDUP": "20 - p, 1",
    "COMBIN": "q + 7, 3", "PERMUT": "q + 7, 3", "EXP": "q / 10", "LN": "p", "LOG10": "p", "FISHER": "d", "FISHERINV": "d", "NORMSDIST": "d * 20 - 1", "NORMSINV": "0.01 + d * 9",
    "ISLEAPYEAR": "1990 + q", "DATE": "1990 + q, n, 28", "YEAR": "t", "MONTH": "t", "DAY": "t", "TIME": "n, q, 15", "HOUR": "t", "MINUTE": "t", "SECOND": "t", "DAYS360": "t, t + q * 40, TRUE", "YEARFRAC": "t, t + q * 40, 3",
    "FV": "r, n + 3, -100, p, 1", "PV": "r, n + 3, -100, p, 1", "PMT": "r, n + 3, p, 100, 1", "IPMT": "r, 2, n + 3, p, 100, 1", "PPMT": "r, 2, n + 3, p, 100, 1", "NPER": "r, -p, p * 5, 0, 1", "SLN": "p, p / 10, n", "SYD": "p, p / 10, n + 3, 2",
}


@query("macro_library", "SELECT name, count(*) AS agree FROM lineitem CROSS JOIN (VALUES " + ", ".join(f"('{n}')" for n in _CALLS) + ") AS f(name) GROUP BY name")
def macro_library(spark, sf_dir):
    """Each function as a macro agrees with its native column within 0.01 (relative beyond 1) on every row."""
    df = read_table(spark, sf_dir, "lineitem").selectExpr("l_extendedprice AS p", "l_quantity AS q", "l_discount AS d", "CAST(l_linenumber AS DOUBLE) AS n", "0.01D + l_discount AS r", "datediff(CAST(l_shipdate AS DATE), DATE'1899-12-30') + l_quantity / 100 + 0.003D AS t")
    columns, parts = {c: type_of_column(t) for c, t in df.dtypes}, []
    for name, call in _CALLS.items():  # a plan each: one for all is too long to compile
        graph = from_formulas({f"{name}_": f"{name}({call})"})
        both = compile_graph(graph, columns).apply(df).withColumnRenamed(f"{name}_", "native")
        both = compile_graph(graph, columns, macros.library().use_macro(name)).apply(both).withColumnRenamed(f"{name}_", "macro")
        a, b = F.col("native"), F.col("macro")
        one = both.agg(F.count_if(F.abs(a - b) <= 0.01 * F.greatest(F.lit(1.0), F.abs(a))).alias("agree"), F.count("*").alias("rows"))
        parts.append(one.where("rows > 0").select(F.lit(name).alias("name"), "agree"))
    return reduce(DataFrame.unionAll, parts)


_FRAMES = "CASE WHEN l_linenumber <= 2 THEN {0} WHEN l_linenumber <= 4 THEN {1} ELSE {2} END"


@query("table_lookups", f"SELECT l_orderkey AS k, l_linenumber AS n, {_FRAMES.format(10e0, 20e0, 30e0)} AS v, {_FRAMES.format(chr(39) + 'a' + chr(39), chr(39) + 'b' + chr(39), chr(39) + 'c' + chr(39))} AS t, {_FRAMES.format(1e0, 2e0, 3e0)} AS h, CASE WHEN l_linenumber = 3 THEN 20e0 WHEN l_linenumber = 1 THEN 10e0 WHEN l_linenumber = 5 THEN 30e0 END AS e FROM lineitem")
def table_lookups(spark, sf_dir):
    """VLOOKUP with and without its fourth argument, in text columns, and HLOOKUP."""
    df = read_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n")
    table = '{1, 10, "a"; 3, 20, "b"; 5, 30, "c"}'
    return evaluate(df, {"v": f"VLOOKUP(n, {table}, 2)", "t": f"VLOOKUP(n, {table}, 3, TRUE)", "h": "HLOOKUP(n, {1, 3, 5; 1, 2, 3}, 2)", "e": f"VLOOKUP(n, {table}, 2, FALSE)"})


def _checked(spark, sf_dir) -> tuple[DataFrame, Graph]:
    """Line items whose expected balance is wrong on every tenth order."""
    graph = from_formulas({"av_bal": _AVERAGE})
    plan = compile_graph(graph, {c: NUMBER for c in ("Length", "Rate", "Balance")})
    done = predict(plan, _loans(spark, sf_dir))
    return done.withColumn("av_bal", F.col("av_bal_predicted") + F.when(F.col("k") % 10 == 0, 1.0).otherwise(0.0)), plan.graph


@query("accuracy_summary", "SELECT count(*) FILTER (l_orderkey % 10 <> 0) AS av_bal_correct, count(*) FILTER (l_orderkey % 10 <> 0) AS all_correct, count(*) AS total FROM lineitem")
def accuracy_summary(spark, sf_dir):
    return accuracy(_checked(spark, sf_dir)[0], {"av_bal": NUMBER})


@query("mismatches", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_orderkey % 10 = 0")
def mismatch_rows(spark, sf_dir):
    return mismatches(_checked(spark, sf_dir)[0], {"av_bal": NUMBER}).select("k", "n")


@query("io_projection", f'SELECT CAST(l_linenumber AS DOUBLE) AS "Length", l_discount AS "Rate", l_extendedprice AS "Balance", round({_AVERAGE_SQL}, 4) AS av_bal FROM lineitem')
def io_projection(spark, sf_dir):
    return evaluate(_loans(spark, sf_dir), {"av_bal": _AVERAGE}, keep=False).withColumn("av_bal", F.round("av_bal", 4))


# Cubes -------------------------------------------------------------------------------------------

_DIMS = ["Geography", "Time"]
_SALES = "WITH sales AS (SELECT r_name AS region, r_name || '/' || n_name AS nation, CAST(year(o_orderdate) AS VARCHAR) AS yr, CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS mon, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _sales(spark, sf_dir) -> DataFrame:
    o, c, n, r = (read_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("r_name").alias("region"), F.concat_ws("/", "r_name", "n_name").alias("nation"), F.year("o_orderdate").cast("string").alias("yr"), F.date_format("o_orderdate", "yyyy-MM").alias("mon"), F.col("o_totalprice").alias("v"))


def _hierarchy(spark, sf_dir) -> DataFrame:
    """All members from one pass over the sales."""
    member = lambda d, code, parent: F.struct(F.lit(d).alias("dimension"), code.alias("code"), code.alias("description"), parent.alias("parent"))
    lit, col = F.lit, F.col
    tops = spark.createDataFrame([("Geography", "Top_Geography", "Top_Geography", None), ("Time", "Top_Time", "Top_Time", None), ("Geography", "World", "World", "Top_Geography")], "dimension string, code string, description string, parent string")
    each = F.array(member("Geography", col("region"), lit("World")), member("Geography", col("nation"), col("region")), member("Time", col("yr"), lit("Top_Time")), member("Time", col("mon"), col("yr")))
    own = _sales(spark, sf_dir).select(F.explode(each).alias("m")).select("m.*").distinct()
    return cube.levels(cube.settled(tops.unionByName(own)))


def _report(spark, sf_dir) -> DataFrame:
    """Totals and details mixed: all combinations of levels, as a report shows them."""
    s = _sales(spark, sf_dir)
    members = F.explode(F.array(F.lit("World"), "region", "nation")).alias("Geography")
    return s.select(members, "yr", "mon", "v").select("Geography", F.explode(F.array("yr", "mon")).alias("Time"), "v").groupBy(*_DIMS).agg(F.sum("v").alias("value"))


_REPORT = _SALES + ", report AS (SELECT g AS \"Geography\", t AS \"Time\", sum(v) AS value FROM (SELECT unnest([struct_pack(a := 'World'), struct_pack(a := region), struct_pack(a := nation)]).a AS g, yr, mon, v FROM sales) CROSS JOIN LATERAL (SELECT unnest([yr, mon]) AS t) GROUP BY 1, 2)"
_H = _SALES + """, h AS (SELECT DISTINCT 'Geography' AS dimension, nation AS code, region AS parent, 3 AS level FROM sales
UNION SELECT 'Geography', region, 'World', 2 FROM sales UNION SELECT 'Geography', 'World', 'Top_Geography', 1 UNION SELECT 'Geography', 'Top_Geography', NULL, 0
UNION SELECT 'Time', mon, yr, 2 FROM sales UNION SELECT 'Time', yr, 'Top_Time', 1 FROM sales UNION SELECT 'Time', 'Top_Time', NULL, 0)"""


@query("cube_levels", _H + " SELECT dimension, code, parent, level FROM h")
def cube_levels(spark, sf_dir):
    return _hierarchy(spark, sf_dir).select("dimension", "code", "parent", "level")


@query("cube_ancestors", _H + " SELECT a.code, b.code AS ancestor FROM h a JOIN h b ON a.dimension = b.dimension AND (b.code = a.code OR b.code = a.parent OR b.level = 0 OR (b.level = 1 AND a.dimension = 'Geography' AND a.level >= 1)) WHERE a.dimension = 'Geography'")
def cube_ancestors(spark, sf_dir):
    return cube.ancestors(_hierarchy(spark, sf_dir), "Geography").select("code", "ancestor")


@query("cube_report", _REPORT + ' SELECT "Geography", "Time", round(value, 2) AS value FROM report')
def cube_report(spark, sf_dir):
    return _report(spark, sf_dir).withColumn("value", F.round("value", 2))


@query("cube_atomic", _SALES + ' SELECT nation AS "Geography", mon AS "Time", round(sum(v), 2) AS value FROM sales GROUP BY 1, 2')
def cube_atomic(spark, sf_dir):
    """Atoms of the whole report are its leaves: all totals cancel out."""
    return cube.atomic(_report(spark, sf_dir), _hierarchy(spark, sf_dir), _DIMS).withColumn("value", F.round("value", 2))


@query("cube_reserve", _SALES + """, g AS (SELECT region AS "Geography", yr AS "Time", sum(v) AS value FROM sales GROUP BY 1, 2)
 SELECT "Geography", "Time", round(value, 2) AS value FROM g""")
def cube_reserve(spark, sf_dir):
    """Facts that stop above the leaves keep their members."""
    s = _sales(spark, sf_dir).select(F.col("region").alias("Geography"), F.col("yr").alias("Time"), "v").groupBy(*_DIMS).agg(F.sum("v").alias("value"))
    h = _hierarchy(spark, sf_dir)
    whole = s.unionByName(s.groupBy("Time").agg(F.sum("value").alias("value")).select(F.lit("World").alias("Geography"), "Time", "value"))
    return cube.atomic(whole, h, _DIMS).withColumn("value", F.round("value", 2))


@query("cube_required", _REPORT + ' SELECT "Geography", "Time" FROM report')
def cube_required(spark, sf_dir):
    leaves = _sales(spark, sf_dir).select(F.col("nation").alias("Geography"), F.col("mon").alias("Time")).distinct()
    return cube.required(leaves, _hierarchy(spark, sf_dir), _DIMS)


@query("cube_missing", _REPORT + """ SELECT "Geography", "Time" FROM report WHERE "Geography" = 'World'""")
def cube_missing(spark, sf_dir):
    return cube.missing_rows(_report(spark, sf_dir).where("Geography <> 'World'"), _hierarchy(spark, sf_dir), _DIMS)


@query("cube_conflicts", _REPORT + """ SELECT "Geography", "Time", round(value, 2) AS old_value, round(value + 1, 2) AS new_value FROM report WHERE "Time" LIKE '____'""")
def cube_conflicts(spark, sf_dir):
    old = _report(spark, sf_dir)
    new = old.withColumn("value", F.col("value") + F.when(F.length("Time") == 4, 1.0).otherwise(0.001))
    return cube.conflicts(old, new, _DIMS).select(*_DIMS, F.round("old_value", 2).alias("old_value"), F.round("new_value", 2).alias("new_value"))


@query("cube_new_facts", _REPORT + """ SELECT "Geography", "Time", round(value, 2) AS value FROM report WHERE "Time" LIKE '____-%'""")
def cube_new_facts(spark, sf_dir):
    whole = _report(spark, sf_dir)
    return cube.new_facts(whole.where(F.length("Time") == 4), whole, _DIMS).withColumn("value", F.round("value", 2))


@query("cube_merge", _SALES + ' SELECT nation AS "Geography", mon AS "Time", round(sum(v), 2) AS value FROM sales GROUP BY 1, 2')
def cube_merge(spark, sf_dir):
    """Years first, months added: the years' reserves cancel out."""
    h, whole = _hierarchy(spark, sf_dir), _report(spark, sf_dir)
    years = whole.where(F.length("Time") == 4)
    old = cube.atomic(years, h, _DIMS)
    fresh = cube.atomic(whole.join(years.select(*_DIMS), _DIMS, "left_anti"), h, _DIMS, tolerance=0.0)
    return cube.merge_atomic(old, fresh, _DIMS).select(*_DIMS, F.round("value", 2).alias("value"))


@query("cube_balance", _H + ", b AS (SELECT dimension, code, parent, level FROM h UNION ALL SELECT 'Geography', code || '_Reserve_3', code, 3 FROM h WHERE dimension = 'Geography' AND level = 2 UNION ALL SELECT 'Geography', 'World_Reserve_2', 'World', 2 UNION ALL SELECT 'Geography', 'World_Reserve_3', 'World_Reserve_2', 3 UNION ALL SELECT 'Time', code || '_Reserve_2', code, 2 FROM h WHERE dimension = 'Time' AND level = 1) SELECT * FROM b")
def cube_balance(spark, sf_dir):
    return cube.balance(_hierarchy(spark, sf_dir)).select("dimension", "code", "parent", "level")


@query("cube_flatten", _SALES + """ SELECT nation AS "Geography_3", nation AS "Geography_3_description", region AS "Geography_2", region AS "Geography_2_description", 'World' AS "Geography_1", 'World' AS "Geography_1_description", mon AS "Time_2", mon AS "Time_2_description", yr AS "Time_1", yr AS "Time_1_description", round(sum(v), 2) AS value FROM sales GROUP BY nation, region, mon, yr""")
def cube_flatten(spark, sf_dir):
    h = _hierarchy(spark, sf_dir)
    return cube.flatten(cube.atomic(_report(spark, sf_dir), h, _DIMS), h, _DIMS).withColumn("value", F.round("value", 2))


@query("cube_rollup_check", _SALES + " SELECT region, yr, round(sum(v), 2) AS value FROM sales GROUP BY ROLLUP (region, yr)")
def cube_rollup_check(spark, sf_dir):
    """Totals from the flattened facts are the report's again."""
    h = _hierarchy(spark, sf_dir)
    flat = cube.flatten(cube.atomic(_report(spark, sf_dir), h, _DIMS), h, _DIMS)
    return flat.rollup(F.col("Geography_2").alias("region"), F.col("Time_1").alias("yr")).agg(F.round(F.sum("value"), 2).alias("value"))


@query("cube_query_set", _H + """, geo AS (SELECT code, level FROM h WHERE dimension = 'Geography' AND (code IN ('World', 'ASIA', 'EUROPE') OR parent = 'ASIA')) SELECT geo.code AS "rowsDim1_code", geo.code AS "rowsDim1_description", geo.level AS "rowsDim1_rel_level", '1995' AS "filterDim1_code", '1995' AS "filterDim1_description" FROM geo""")
def cube_query_set(spark, sf_dir):
    h = _hierarchy(spark, sf_dir)
    asia = [r["code"] for r in h.where("parent = 'ASIA'").collect()]
    return cube.query_set(h, {"Geography": [*asia, "EUROPE"], "Time": ["1995"]})


_NAMED = {"rowsDim1": "Geography", "rowsDim2": "Time"}


def _extract(spark, sf_dir, where: str = "true") -> DataFrame:
    """The report as a spreadsheet shows it: parents above children, places outside, times inside."""
    s = _sales(spark, sf_dir)
    at = lambda path, code, level: F.struct(path.alias("path"), code.alias("code"), F.lit(level).alias("level"))
    place = F.array(at(F.lit("World"), F.lit("World"), 1), at(F.concat_ws("/", F.lit("World"), "region"), F.col("region"), 2), at(F.concat_ws("/", F.lit("World"), "nation"), F.col("nation"), 3))
    time = F.array(at(F.col("yr"), F.col("yr"), 1), at(F.concat_ws("/", "yr", "mon"), F.col("mon"), 2))
    rows = s.where(where).select(F.explode(place).alias("g"), "yr", "mon", "v").select("g", F.explode(time).alias("t"), "v").groupBy("g", "t").agg(F.sum("v").alias("value"))
    named = [c.alias(f"{p}_{n}") for p, x in (("rowsDim1", "g"), ("rowsDim2", "t")) for n, c in (("code", F.col(f"{x}.code")), ("description", F.col(f"{x}.code")), ("rel_level", F.col(f"{x}.level")))]
    return rows.select(F.concat_ws("\x01", "g.path", "t.path").alias("at"), *named, "value")


@query("cube_parents", _H + " SELECT dimension, code, parent, level FROM h")
def cube_parents(spark, sf_dir):
    """Parents from the order and levels of a report's rows."""
    return cube.build_hierarchy(_extract(spark, sf_dir), "at", _NAMED).select("dimension", "code", "parent", "level")


@query("cube_found", _SQL["cube_flatten"])
def cube_found(spark, sf_dir):
    """A report alone becomes a star table."""
    return cube.found(_extract(spark, sf_dir), "at", _NAMED)["flattened"].withColumn("value", F.round("value", 2))


def _founding(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    """(a cube without the nations of ASIA, the report of ASIA to be added)."""
    whole = _extract(spark, sf_dir)
    asia = F.col("rowsDim1_code").startswith("ASIA/")
    return cube.found(whole.where(~asia), "at", _NAMED), whole.where(asia | F.col("rowsDim1_code").isin("World", "ASIA"))


@query("cube_assign", """SELECT * FROM (VALUES ('rowsDim1', 'Geography'), ('rowsDim2', 'Time')) AS t(prefix, dimension)""")
def cube_assign(spark, sf_dir):
    founded, more = _founding(spark, sf_dir)
    return spark.createDataFrame(list(cube.assign_dimensions(more, founded["hierarchy"]).items()), "prefix string, dimension string")


@query("cube_increment", _SQL["cube_atomic"])
def cube_increment(spark, sf_dir):
    """The atoms of a cube that grew are those of the whole."""
    founded, more = _founding(spark, sf_dir)
    return cube.increment(founded, more, "at")["atomic"].select(*_DIMS, F.round("value", 2).alias("value"))


@query("cube_ranks", _H + """, p AS (SELECT code, CASE level WHEN 0 THEN code WHEN 1 THEN 'Top_Geography/' || code WHEN 2 THEN 'Top_Geography/World/' || code ELSE 'Top_Geography/World/' || parent || '/' || code END AS path FROM h WHERE dimension = 'Geography') SELECT code, CAST(row_number() OVER (ORDER BY path DESC) AS INT) AS rank FROM p""")
def cube_ranks(spark, sf_dir):
    return cube.ranks(_hierarchy(spark, sf_dir), "Geography")


# Windows in time -----------------------------------------------------------------------------------


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    out = windowed_sums(read_table(spark, sf_dir, "events"), "ts", ["event_type"], "value", "1 hour")
    return out.select("window_start", "event_type", F.round("total", 4).alias("total"), "n")


@query("event_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g) SELECT min(ts) AS window_start, user_id, round(sum(value), 4) AS total, count(*) AS n FROM s GROUP BY user_id, sess")
def event_sessions(spark, sf_dir):
    out = sessions(read_table(spark, sf_dir, "events"), "ts", ["user_id"], "value", "30 minutes")
    return out.select("window_start", "user_id", F.round("total", 4).alias("total"), "n")
