"""Cubes on a small extract with known atoms, and incremental merges."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import cube
from gridloom.streaming import incremental

PLACES = [("World", 1, None), ("North", 2, "World"), ("A", 3, "North"), ("B", 3, "North"), ("South", 2, "World")]
TIMES = [("2023", 1, None), ("Jan", 2, "2023"), ("Feb", 2, "2023")]
VALUES = {("A", "Jan"): 5.0, ("A", "Feb"): 2.0, ("B", "Jan"): 1.0, ("North", "Jan"): 8.0, ("North", "Feb"): 9.0, ("South", "Jan"): 4.0, ("South", "Feb"): 4.0}


def total(place, time):
    leaves = {"2023": ["Jan", "Feb"]}.get(time, [time])
    if place == "World":
        return total("North", time) + total("South", time)
    return sum(VALUES.get((place, t), 0.0) for t in leaves)


def extract(spark, places, times=TIMES, bump=0.0):
    rows, at = [], 0
    for p, pl, _ in places:
        for t, tl, _ in times:
            rows.append((at, p, p.lower(), pl, t, t, tl, "Revenue", "Revenue", "Toys", "Toys", total(p, t) + bump))
            at += 1
    d = "rowsDim1_code string, rowsDim1_description string, rowsDim1_rel_level int, rowsDim2_code string, rowsDim2_description string, rowsDim2_rel_level int, filterDim1_code string, filterDim1_description string, filterDim2_code string, filterDim2_description string"
    return spark.createDataFrame(rows, f"at int, {d}, value double")


@pytest.fixture(scope="module")
def founding(spark):
    return cube.found(extract(spark, [p for p in PLACES if p[0] != "B"]), "at")


def atoms(df):
    return {(r["Geography"], r["Time"]): round(r["value"], 6) for r in df.collect()}


def test_hierarchy(founding):
    h = {(r["dimension"], r["code"]): (r["parent"], r["level"]) for r in founding["hierarchy"].collect()}
    assert h[("Geography", "A")] == ("North", 3) and h[("Geography", "South")] == ("World", 2) and h[("Time", "Feb")] == ("2023", 2)
    assert h[("Metric", "Revenue")] == ("Top_Metric", 1) and h[("Geography", "Top_Geography")] == (None, 0)


def test_atoms(founding):
    a = atoms(founding["atomic"])
    assert a == {("A", "Jan"): 5.0, ("A", "Feb"): 2.0, ("North", "Jan"): 3.0, ("North", "Feb"): 7.0, ("South", "Jan"): 4.0, ("South", "Feb"): 4.0}
    assert sum(a.values()) == total("World", "2023")


def test_flattened(founding):
    flat = founding["flattened"]
    assert flat.columns[-1] == "value" and "Geography_3" in flat.columns and "Metric_description" in flat.columns
    codes = {r["Geography_3"] for r in flat.collect()}
    assert codes == {"A", "North_Reserve_3", "South_Reserve_3"}
    again = flat.groupBy("Geography_2").agg(F.sum("value").alias("v")).collect()
    assert {r["Geography_2"]: r["v"] for r in again} == {"North": 17.0, "South": 8.0}


def test_increment(spark, founding):
    more = cube.increment(founding, extract(spark, [p for p in PLACES if p[0] in ("World", "North", "B")]), "at")
    a = atoms(more["atomic"])
    assert a[("B", "Jan")] == 1.0 and a[("North", "Jan")] == 2.0 and sum(a.values()) == total("World", "2023")
    with pytest.raises(cube.CubeError) as e:
        cube.increment(founding, extract(spark, PLACES[:3], bump=1.0), "at")
    assert e.value.rows.count() == 9


def test_completeness(spark, founding):
    lacking = extract(spark, PLACES).where("not (rowsDim1_code = 'North' and rowsDim2_code = '2023')")
    with pytest.raises(cube.CubeError) as e:
        cube.found(lacking, "at")
    assert [(r["Geography"], r["Time"]) for r in e.value.rows.collect()] == [("North", "2023")]


def test_faults(spark):
    df = extract(spark, PLACES)
    with pytest.raises(cube.CubeError) as e:
        cube.find_dimensions(df.drop("rowsDim1_rel_level", "value"))
    assert "rel_level" in str(e.value) and "value" in str(e.value)
    with pytest.raises(cube.CubeError):
        cube.found(df.withColumn("filterDim1_code", F.col("rowsDim1_code")), "at")
    with pytest.raises(cube.CubeError):
        cube.found(df.where("rowsDim1_code <> 'North'"), "at")
    with pytest.raises(cube.CubeError):
        cube.facts(df.withColumn("rowsDim1_code", F.lit(None).cast("string")))
    loop = spark.createDataFrame([("d", "a", "a", "b"), ("d", "b", "b", "a")], "dimension string, code string, description string, parent string")
    with pytest.raises(cube.CubeError):
        cube.levels(loop)


def test_deep_chains_fail_loudly(spark, monkeypatch):
    rows = [("d", f"m{k:02}", "m", f"m{k - 1:02}" if k else None, k) for k in range(60)]
    h = lambda n: spark.createDataFrame(rows[:n], cube.HIERARCHY)
    assert cube.levels(h(60).drop("level")).count() == 60
    assert cube.ancestors(h(51), "d").where("code = 'm50'").count() == 51
    with pytest.raises(cube.CubeError):
        cube.ancestors(h(60), "d")
    monkeypatch.setattr(cube, "BROADCAST_MEMBERS", 0)
    with pytest.raises(cube.CubeError):
        cube.ancestors(h(60), "d")


def test_query_set_and_ranks(founding):
    h = founding["hierarchy"]
    q = cube.query_set(h, {"Geography": ["A", "South"], "Time": ["Jan"]}).collect()
    assert [r["rowsDim1_code"] for r in q] and {r["rowsDim1_code"] for r in q} == {"A", "North", "World", "South"}
    rank = {r["code"]: r["rank"] for r in cube.ranks(h, "Geography").collect()}
    assert rank["A"] < rank["North"] < rank["World"] < rank["Top_Geography"]


def test_streams(spark, founding, tmp_path):
    dims = ["Geography", "Time", "Metric", "Product"]
    facts = founding["all_facts"].select(*dims, "value")
    facts.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
    incremental.merge_stream(stream(), founding["hierarchy"], dims, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    last = sorted((tmp_path / "out").iterdir())[-1]
    got = spark.read.parquet(str(last)).where("abs(value) > 0.01")
    assert atoms(got) == atoms(founding["atomic"])
    q = incremental.atomic_stream(stream(), founding["hierarchy"], dims).writeStream.outputMode("complete").format("memory").queryName("atoms").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert atoms(spark.table("atoms").where("abs(value) > 0.01")) == atoms(founding["atomic"])
