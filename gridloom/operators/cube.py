"""Hierarchical cubes: report extracts with totals and details to additive facts and star tables.

A hierarchy is (dimension, code, description, parent, level) with a Top_<dimension> of level 0.
Levels are few, so loops run over levels and dimensions, never over rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.01
HIERARCHY = "dimension string, code string, description string, parent string, level int"
_CODE = re.compile(r"(rowsDim|filterDim)(\d+)_code")
NAMES = dict(zip(("rowsDim1", "rowsDim2", "filterDim1", "filterDim2"), ("Geography", "Time", "Metric", "Product")))
BROADCAST_MEMBERS = 100_000


class CubeError(ValueError):
    """A cube that breaks a rule; rows holds the offending rows, if any."""

    def __init__(self, message: str, rows: DataFrame | None = None):
        self.rows = rows
        super().__init__(message)


def settled(df: DataFrame) -> DataFrame:
    """A hierarchy as literal rows where a count shows few members: its plan ends there, and the
    planner knows its size when it chooses joins. A larger one stays as it is, kept in storage."""
    rows = df.limit(BROADCAST_MEMBERS + 1).collect()
    return literal_rows(df, rows) if len(rows) <= BROADCAST_MEMBERS else df.persist()


def literal_rows(df: DataFrame, rows: list) -> DataFrame:
    """The rows as a table that remembers them, so that no later step collects it again."""
    out = df.sparkSession.createDataFrame(rows, df.schema)
    out._members = rows
    return out


def _members(hierarchy: DataFrame) -> list | None:
    """The rows of a hierarchy that a count shows to be small, else None."""
    if (known := getattr(hierarchy, "_members", None)) is not None:
        return known
    rows = hierarchy.limit(BROADCAST_MEMBERS + 1).collect()
    return rows if len(rows) <= BROADCAST_MEMBERS else None


def find_dimensions(df: DataFrame) -> dict[str, list[str]]:
    """{"rows": [...], "filters": [...]} column prefixes; all faults are told at once."""
    columns, wrong = set(df.columns), []
    found = {"rows": [], "filters": []}
    for c in sorted(columns):
        if m := _CODE.fullmatch(c):
            prefix = m[1] + m[2]
            found["rows" if m[1] == "rowsDim" else "filters"].append(prefix)
            needed = [f"{prefix}_description"] + [f"{prefix}_rel_level"] * (m[1] == "rowsDim")
            wrong += [f"{n} is missing" for n in needed if n not in columns]
    if "value" not in columns:
        wrong.append("value is missing")
    if not found["rows"] and not found["filters"]:
        wrong.append("there is no dimension")
    if wrong:
        raise CubeError("; ".join(wrong))
    return found


def check_filters(df: DataFrame, filters: list[str]) -> None:
    """Each filter dimension has exactly one member."""
    if filters:
        r = df.agg(*[F.count_distinct(f"{p}_code").alias(p) for p in filters]).first()
        if bad := [p for p in filters if r[p] != 1]:
            raise CubeError(f"not exactly one member in {', '.join(bad)}")


def infer_parents(df: DataFrame, prefix: str, dimension: str, order: str, above: bool = True) -> DataFrame:
    """dimension, code, description, parent, rel_level of a row dimension's members.

    A member's parent is the nearest row of the level before it above (else below) its first row
    in order. One report's rows are one ordered sequence; each level is one running value.
    """
    first = df.groupBy(F.col(f"{prefix}_code").alias("code")).agg(F.min_by(f"{prefix}_description", order).alias("description"), F.min_by(f"{prefix}_rel_level", order).cast("int").alias("rel_level"), F.min(order).alias("at"))
    top = first.agg(F.max("rel_level").alias("m"), F.count_if(F.col("rel_level").isNull()).alias("n")).first()
    if top["n"]:
        raise CubeError(f"{dimension}: a level is null")
    frame = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1) if above else Window.orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    nearest = F.last if above else F.first
    parent = F.lit(None).cast("string")
    for level in range(2, (top["m"] or 0) + 1):
        parent = F.when(F.col("rel_level") == level, nearest(F.when(F.col("rel_level") == level - 1, F.col("code")), True).over(frame)).otherwise(parent)
    out = first.withColumn("parent", F.when(F.col("rel_level") == 1, F.lit(f"Top_{dimension}")).otherwise(parent))
    if gap := out.where("parent is null").select("code").first():
        raise CubeError(f"{dimension}: {gap['code']} has no parent")
    return out.select(F.lit(dimension).alias("dimension"), "code", "description", "parent", "rel_level")


def build_hierarchy(df: DataFrame, order: str, names: dict[str, str] | None = None, above: bool = True) -> DataFrame:
    """The hierarchy of a founding extract whose row order is column ``order``."""
    names, found = names or NAMES, find_dimensions(df)
    check_filters(df, found["filters"])
    spark = df.sparkSession
    dims = found["rows"] + found["filters"]
    tops = spark.createDataFrame([(names[p], f"Top_{names[p]}", f"Top node for the {names[p]} dimension", None, 0) for p in dims], HIERARCHY)
    parts = [tops]
    for p in found["filters"]:
        parts.append(df.groupBy(F.col(f"{p}_code").alias("code")).agg(F.min_by(f"{p}_description", order).alias("description")).select(F.lit(names[p]).alias("dimension"), "code", "description", F.lit(f"Top_{names[p]}").alias("parent"), F.lit(1).alias("level")))
    for p in found["rows"]:
        parts.append(infer_parents(df, p, names[p], order, above).withColumnRenamed("rel_level", "level"))
    return settled(reduce(DataFrame.unionByName, [x.select("dimension", "code", "description", "parent", "level") for x in parts]))


def extend_hierarchy(hierarchy: DataFrame, df: DataFrame, order: str, names: dict[str, str], above: bool = True) -> DataFrame:
    """The hierarchy with an increment's members that it lacks; levels follow from parents."""
    parts = [infer_parents(df, p, names[p], order, above) for p in find_dimensions(df)["rows"]]
    new = reduce(DataFrame.unionByName, parts).join(hierarchy.select("dimension", "code"), ["dimension", "code"], "left_anti")
    both = hierarchy.select("dimension", "code", "description", "parent").unionByName(new.select("dimension", "code", "description", "parent"))
    # A member that starts its report at level 1 hangs where the hierarchy has it; new ones need a parent there.
    return settled(levels(settled(both)))


def levels(hierarchy: DataFrame, most: int = 50) -> DataFrame:
    """Levels from parents: the root is 0. CubeError where members don't reach a root."""
    if (rows := _members(hierarchy)) is not None:
        parent, level = {(r["dimension"], r["code"]): r["parent"] for r in rows}, {}
        for d, c in parent:
            chain = []
            while c is not None and (d, c) not in level and (d, c) in parent and len(chain) <= most:
                chain.append(c)
                c = parent[d, c]
            at = -1 if c is None else level.get((d, c))
            for k, member in enumerate(reversed(chain)):
                level[d, member] = None if at is None else at + 1 + k
        if None in level.values():
            raise CubeError("members form a circle or lack a root")
        return hierarchy.sparkSession.createDataFrame([(r["dimension"], r["code"], r["description"], r["parent"], level[r["dimension"], r["code"]]) for r in rows], HIERARCHY)
    frontier = hierarchy.where("parent is null").withColumn("level", F.lit(0))
    parts, total = [frontier], hierarchy.count()
    n = frontier.count()
    for level in range(1, most):
        up = frontier.select("dimension", F.col("code").alias("parent"))
        frontier = hierarchy.join(up, ["dimension", "parent"]).select("dimension", "code", "description", "parent").withColumn("level", F.lit(level))
        here = frontier.count()
        if not here:
            break
        parts.append(frontier)
        n += here
    if n != total:
        raise CubeError("members form a circle or lack a root")
    return reduce(DataFrame.unionByName, parts).select("dimension", "code", "description", "parent", "level")


def assign_dimensions(df: DataFrame, hierarchy: DataFrame) -> dict[str, str]:
    """Which dimension each of an increment's column groups is, from members that the hierarchy has."""
    found, out = find_dimensions(df), {}
    for p in found["rows"] + found["filters"]:
        members = df.select(F.col(f"{p}_code").alias("code"), *([F.col(f"{p}_rel_level").alias("rel")] if p in found["rows"] else [F.lit(1).alias("rel")])).distinct()
        tops = members.where("rel = 1")
        known = tops.join(hierarchy, "code").groupBy("dimension").agg(F.count_distinct("code").alias("n"), F.count_distinct("level").alias("l")).collect()
        if len(known) != 1 or known[0]["n"] != tops.count() or known[0]["l"] != 1:
            raise CubeError(f"{p}: its top members are not all of one dimension and level")
        out[p] = known[0]["dimension"]
    if len(set(out.values())) != len(out):
        raise CubeError("two column groups are one dimension")
    return out


def facts(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One code column per dimension, and value; repeated rows once. Null codes are an error."""
    names, found = names or NAMES, find_dimensions(df)
    dims = found["rows"] + found["filters"]
    out = df.select(*[F.col(f"{p}_code").alias(names[p]) for p in dims], F.col("value").cast("double").alias("value")).distinct()
    nulls = out.where(reduce(lambda a, b: a | b, [F.col(names[p]).isNull() for p in dims]))
    if not nulls.isEmpty():
        raise CubeError("a code is null", nulls)
    return out


def deep_dimensions(hierarchy: DataFrame) -> list[str]:
    """The dimensions with a level of 2 or more."""
    if (rows := _members(hierarchy)) is not None:
        return sorted({r["dimension"] for r in rows if r["level"] >= 2})
    return sorted(r["dimension"] for r in hierarchy.where("level >= 2").select("dimension").distinct().collect())


def self_and_parent(hierarchy: DataFrame, dimension: str) -> DataFrame:
    """prior, member, sign: each member itself (+1) and, from level 2 on, its parent (-1)."""
    h = hierarchy.where((F.col("dimension") == dimension) & (F.col("level") >= 1))
    pairs = F.when(F.col("level") >= 2, F.array(F.struct(F.col("code").alias("member"), F.lit(1).alias("sign")), F.struct(F.col("parent").alias("member"), F.lit(-1).alias("sign")))).otherwise(F.array(F.struct(F.col("code").alias("member"), F.lit(1).alias("sign"))))
    return h.select(F.col("code").alias("prior"), F.explode(pairs).alias("p")).select("prior", "p.*")


def required(fact: DataFrame, hierarchy: DataFrame, dims: list[str]) -> DataFrame:
    """All rows that the facts need above them: every combination of a member and its ancestors.

    A fact at level 1 of a deep dimension asks for nothing more there than itself.
    """
    out = fact.select(*dims).distinct()
    for d in deep_dimensions(hierarchy):
        closure = ancestors(hierarchy, d).where("level >= 1").select(F.col("code").alias("prior"), F.col("ancestor").alias("member"))
        out = out.join(closure, out[d] == closure["prior"]).select(*[F.col("member").alias(d) if c == d else F.col(c) for c in dims]).distinct()
    return out


def ancestors(hierarchy: DataFrame, dimension: str, most: int = 50) -> DataFrame:
    """code, ancestor, level (of the ancestor): each member's ancestors and itself. CubeError where a chain has more than ``most`` ancestors."""
    if (rows := _members(hierarchy)) is not None:
        rows = [r for r in rows if r["dimension"] == dimension]
        up, out = {r["code"]: (r["parent"], r["level"]) for r in rows}, []
        for code in up:
            above, n = code, 0
            while above in up and n <= most:
                out.append((code, above, up[above][1]))
                above, n = up[above][0], n + 1
            if above in up:
                raise CubeError(f"{dimension}: {code} has more than {most} ancestors")
        return hierarchy.sparkSession.createDataFrame(out, "code string, ancestor string, level int")
    h = hierarchy.where(F.col("dimension") == dimension)
    step = h.select("code", F.col("code").alias("ancestor"), "level", "parent")
    parts = [step.select("code", "ancestor", "level")]
    up = (h.select(F.col("code").alias("ancestor"), F.col("level"), F.col("parent")))
    depth = h.agg(F.max("level")).first()[0] or 0
    if depth > most:
        raise CubeError(f"{dimension}: a member has more than {most} ancestors")
    for _ in range(depth):
        step = step.select("code", F.col("parent").alias("ancestor")).where("ancestor is not null").join(up, "ancestor").select("code", "ancestor", "level", "parent")
        parts.append(step.select("code", "ancestor", "level"))
    return settled(reduce(DataFrame.unionByName, parts))


def missing_rows(fact: DataFrame, hierarchy: DataFrame, dims: list[str]) -> DataFrame:
    """Required rows that the facts lack."""
    return required(fact, hierarchy, dims).join(fact.select(*dims), dims, "left_anti")


def children_first(df: DataFrame, hierarchy: DataFrame, dims: list[str]) -> DataFrame:
    """Rows ordered so that members come before their ancestors, dimension by dimension."""
    for d in dims:
        df = df.join(paths(hierarchy, d).select(F.col("code").alias(d), F.col("path").alias(f"__{d}")), d, "left")
    return df.orderBy(*[F.desc(f"__{d}") for d in dims]).drop(*[f"__{d}" for d in dims])


def paths(hierarchy: DataFrame, dimension: str) -> DataFrame:
    """code, path: codes from the root down, which sort as the tree does."""
    chain = ancestors(hierarchy, dimension)
    return chain.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "ancestor"))), lambda x: x["ancestor"]), "/").alias("path"))


def ranks(hierarchy: DataFrame, dimension: str) -> DataFrame:
    """code, rank: a post-order in which children come before parents."""
    return paths(hierarchy, dimension).select("code", F.row_number().over(Window.orderBy(F.desc("path"))).alias("rank"))


def atomic(fact: DataFrame, hierarchy: DataFrame, dims: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Additive facts by inclusion and exclusion; what cancels out goes.

    The operator is a product of one map per dimension, so it is applied dimension by dimension
    with a sum between: rows at most double before each sum, instead of doubling with every dimension.
    """
    for d in deep_dimensions(hierarchy):
        m = self_and_parent(hierarchy, d)
        fact = fact.join(m, fact[d] == m["prior"]).select(*[F.col("member").alias(d) if c == d else F.col(c) for c in dims], (F.col("value") * F.col("sign")).alias("value")).groupBy(*dims).agg(F.sum("value").alias("value"))
    return fact.groupBy(*dims).agg(F.sum("value").alias("value")).where(F.abs("value") > tolerance)


def conflicts(old: DataFrame, new: DataFrame, dims: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Keys that both have with values apart; a missing value is apart from a number."""
    apart = F.coalesce(F.abs(F.col("old_value") - F.col("new_value")) > tolerance, F.col("old_value").isNull() != F.col("new_value").isNull())
    return old.withColumnRenamed("value", "old_value").join(new.withColumnRenamed("value", "new_value"), dims).where(apart)


def new_facts(old: DataFrame, new: DataFrame, dims: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of new whose keys old lacks; CubeError on conflicts."""
    apart = conflicts(old, new, dims, tolerance)
    if not apart.isEmpty():
        raise CubeError("facts conflict with earlier ones", apart)
    return new.join(old.select(*dims), dims, "left_anti")


def merge_atomic(old: DataFrame, new: DataFrame, dims: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Sums of both by key, without what cancels out."""
    return old.unionByName(new).groupBy(*dims).agg(F.sum("value").alias("value")).where(F.abs("value") > tolerance)


def balance(hierarchy: DataFrame) -> DataFrame:
    """The hierarchy with a chain of reserve members below each member above the last level."""
    deepest = hierarchy.groupBy("dimension").agg(F.max("level").alias("deepest"))
    above = hierarchy.join(deepest, "dimension").where("level >= 1 and level < deepest")
    chain = above.select("dimension", F.col("code").alias("member"), F.col("level").alias("at"), F.explode(F.sequence(F.col("level") + 1, F.col("deepest"))).alias("level"))
    name = lambda level: F.concat("member", F.lit("_Reserve_"), level.cast("string"))
    extra = chain.select("dimension", name(F.col("level")).alias("code"), F.lit("<Reserve>").alias("description"), F.when(F.col("level") == F.col("at") + 1, F.col("member")).otherwise(name(F.col("level") - 1)).alias("parent"), "level")
    return hierarchy.select("dimension", "code", "description", "parent", "level").unionByName(extra)


def to_leaves(fact: DataFrame, hierarchy: DataFrame, dims: list[str]) -> DataFrame:
    """Facts on members above the last level move to their last reserve member."""
    deepest = hierarchy.groupBy("dimension").agg(F.max("level").alias("deepest"))
    moves = hierarchy.join(deepest, "dimension").where("level >= 1 and level < deepest").select("dimension", "code", F.concat("code", F.lit("_Reserve_"), F.col("deepest").cast("string")).alias("leaf"))
    for d in dims:
        m = moves.where(F.col("dimension") == d).select(F.col("code").alias("__c"), "leaf")
        fact = fact.join(m, fact[d] == m["__c"], "left").withColumn(d, F.coalesce("leaf", d)).drop("__c", "leaf")
    return fact


def denormalize(balanced: DataFrame, dimension: str) -> DataFrame:
    """One row per leaf with <dimension>_<level> and its description from the leaf up to level 1."""
    h = balanced.where(F.col("dimension") == dimension)
    deepest = h.agg(F.max("level")).first()[0]
    at = lambda level: h.where(F.col("level") == level).select(F.col("code").alias(f"{dimension}_{level}"), F.col("description").alias(f"{dimension}_{level}_description"), F.col("parent").alias(f"__p{level}"))
    out = at(deepest)
    for level in range(deepest - 1, 0, -1):
        up = at(level)
        out = out.join(up, out[f"__p{level + 1}"] == up[f"{dimension}_{level}"])
    return out.drop(*[f"__p{i}" for i in range(1, deepest + 1)])


def flatten(fact: DataFrame, hierarchy: DataFrame, dims: list[str], keep_codes: bool = False) -> DataFrame:
    """Star-joined facts, value last; a dimension of one level gives its description (and code if asked).

    CubeError for repeated members; a fact whose member the hierarchy lacks fails the query that reads it.
    """
    twice = hierarchy.groupBy("dimension", "code").count().where("count > 1")
    if not twice.isEmpty():
        raise CubeError("members repeat", twice)
    balanced = settled(balance(hierarchy))
    out, names = to_leaves(fact, hierarchy, dims), []
    for d in dims:
        wide = denormalize(balanced, d)
        key = wide.columns[0]
        out = out.join(wide, out[d] == wide[key], "left")
        # The check is part of the plan: no fact may be lost, and none is read twice to see it.
        shown = f"{d}_1_description"
        out = out.withColumn(shown, F.when(F.col(key).isNull(), F.raise_error(F.concat(F.lit(f"facts have an unknown member of {d}: "), F.col(d)))).otherwise(F.col(shown)))
        if len(wide.columns) == 2:
            out = out.withColumnRenamed(f"{d}_1_description", f"{d}_description")
            names += [f"{d}_1"] * keep_codes + [f"{d}_description"]
        else:
            names += wide.columns
    return out.select(*names, "value")


def query_set(hierarchy: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The rows of a query for the wanted members: one member makes a filter dimension, more make a
    row dimension with all their ancestors below the root; dimensions not named give level 1.

    The product of the member lists is the request itself; lists come from arguments.
    """
    parts, n = [], {"filterDim": 0, "rowsDim": 0}
    for d in sorted(r["dimension"] for r in hierarchy.select("dimension").distinct().collect()):
        members = wanted.get(d) or [r["code"] for r in hierarchy.where((F.col("dimension") == d) & (F.col("level") == 1)).collect()]
        h = hierarchy.where(F.col("dimension") == d)
        kind = "filterDim" if len(members) == 1 else "rowsDim"
        n[kind] += 1
        p = f"{kind}{n[kind]}"
        if kind == "filterDim":
            part = h.where(F.col("code") == members[0]).select(F.col("code").alias(f"{p}_code"), F.col("description").alias(f"{p}_description"))
        else:
            chain = ancestors(hierarchy, d).where(F.col("code").isin(members) & (F.col("level") >= 1)).select(F.col("ancestor").alias("code")).distinct()
            part = h.join(chain, "code").join(paths(hierarchy, d), "code").select(F.col("code").alias(f"{p}_code"), F.col("description").alias(f"{p}_description"), F.col("level").alias(f"{p}_rel_level"), F.col("path").alias(f"__{p}"))
        parts.append(part.withColumn("__one", F.lit(1)))
    out = reduce(lambda a, b: a.join(b, "__one"), parts).drop("__one")
    order = [c for c in out.columns if c.startswith("__")]
    return out.orderBy(*[F.desc(c) for c in order]).drop(*order)


def found(df: DataFrame, order: str, names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """hierarchy, all_facts, atomic, flattened of a founding extract."""
    names = names or NAMES
    shape = find_dimensions(df)
    dims = [names[p] for p in shape["rows"] + shape["filters"]]
    hierarchy = build_hierarchy(df, order, names)
    all_facts = facts(df, names).persist()
    lacking = missing_rows(all_facts, hierarchy, dims)
    if not lacking.isEmpty():
        raise CubeError("rows are missing", children_first(lacking, hierarchy, dims))
    own = atomic(all_facts, hierarchy, dims)
    return {"hierarchy": hierarchy, "all_facts": all_facts, "atomic": own, "flattened": flatten(own, hierarchy, sorted(dims))}


def increment(cube: dict[str, DataFrame], df: DataFrame, order: str) -> dict[str, DataFrame]:
    """The cube with an increment: only new facts are worked on, and their atoms added."""
    names = assign_dimensions(df, cube["hierarchy"])
    dims = [c for c in cube["all_facts"].columns if c != "value"]
    hierarchy = extend_hierarchy(cube["hierarchy"], df, order, names)
    incoming = facts(df, names).select(*dims, "value")
    fresh = new_facts(cube["all_facts"], incoming, dims)
    every = cube["all_facts"].unionByName(fresh).persist()
    lacking = missing_rows(every, hierarchy, dims)
    if not lacking.isEmpty():
        raise CubeError("rows are missing", children_first(lacking, hierarchy, dims))
    own = merge_atomic(cube["atomic"].select(*dims, "value"), atomic(fresh, hierarchy, dims, tolerance=0.0), dims)
    return {"hierarchy": hierarchy, "all_facts": every, "atomic": own, "flattened": flatten(own, hierarchy, sorted(dims))}


def reserve_code(code: Column, level: int) -> Column:
    return F.concat(code, F.lit(f"_Reserve_{level}"))
