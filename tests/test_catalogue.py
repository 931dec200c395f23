"""Ad-hoc SQL over the whole catalogue, footprints in one pass, top-k over many exemplar blocks."""
import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from carelake.operators import generic as gen
from carelake.operators import reaimed
from carelake.plans.warehouse import Warehouse


class Recorded(dict):
    """A catalogue that notes which tables were built."""

    def __init__(self, lake):
        super().__init__()
        self.w, self.built = Warehouse(lake), []

    def __contains__(self, name):
        return name in self.w

    def __getitem__(self, name):
        self.built.append(name)
        return self.w[name]


def test_adhoc_sql_builds_just_what_it_names(spark, lake):
    got = Recorded(lake)
    text = """WITH dim_vendor AS (SELECT 1 AS x) SELECT p.plant, count(*) AS n FROM dim_plant p
              JOIN kpi_fill_rate f ON p.plant = f.plant WHERE EXISTS (SELECT 1 FROM kpi_stock_value s WHERE s.plant = p.plant)
              AND (SELECT max(x) FROM dim_vendor) = 1 GROUP BY p.plant"""
    assert gen.adhoc_sql(spark, text, catalogue=got).count() > 5
    assert sorted(got.built) == ["dim_plant", "kpi_fill_rate", "kpi_stock_value"]      # not dim_vendor: a CTE hides it
    assert not [t for t in spark.catalog.listTables() if t.isTemporary and t.name in got.built]
    with pytest.raises(AnalysisException, match="no_such_table"):
        gen.adhoc_sql(spark, "SELECT * FROM no_such_table", catalogue=got)
    with pytest.raises(AnalysisException, match="wrong_column"):
        gen.adhoc_sql(spark, "SELECT wrong_column FROM dim_plant", catalogue=got)


def test_adhoc_sql_says_when_it_is_cut(spark, lake):
    q = "SELECT plant FROM dim_plant ORDER BY plant"
    n = lake.dim_plant.count()
    assert {r["truncated"] for r in gen.adhoc_sql(spark, q, n - 1, Warehouse(lake)).collect()} == {True}
    assert {r["truncated"] for r in gen.adhoc_sql(spark, q, n, Warehouse(lake)).collect()} == {False}


def test_footprint_meets_the_codes_once(spark):
    dim = spark.createDataFrame([("1", "Gear A"), ("2.0", "gear b"), ("3", "Bolt"), (None, "gear c")], "material string, material_desc string")
    tables = {"t1": spark.createDataFrame([("1",), ("1.0",), ("2",), ("3",), (None,)], "material string"),
              "t2": spark.createDataFrame([(2,), (2,), (4,)], "material_id int"), "t3": spark.createDataFrame([("1",)], "plant string"),
              "t4": spark.createDataFrame([("9",)], "material string"), "mart_x": spark.createDataFrame([("1",)], "material string")}
    got = reaimed.item_footprint(dim, tables, " gear ")
    assert {r["table_name"]: r["rows"] for r in got.collect()} == {"t1": 3, "t2": 2, "t4": 0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "LeftSemi" not in plan


def test_top_k_over_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    ex, rows = rng.normal(size=(10_000, 6)), rng.normal(size=(60, 6))
    ex[17], ex[4001] = 0, ex[5]      # a zero vector, two equal exemplars
    rows[3] = 0
    names = [f"e{i:05d}" for i in range(len(ex))]
    edf = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, ex)], "label string, centroid array<double>").repartition(4)
    vec = [(i, v.tolist()) for i, v in enumerate(rows)] + [(0, rows[0].tolist()), (99, ex[5].tolist())]      # a repeated row
    df = spark.createDataFrame(vec, "vec_id int, embedding array<double>").repartition(3)
    want = []
    for i, v in vec:
        v = np.array(v)
        nv, ne = np.sqrt(v @ v), np.sqrt((ex * ex).sum(1))
        sim = np.where((nv == 0) | (ne == 0), 0.0, (ex @ v) / np.where((nv == 0) | (ne == 0), 1.0, nv * ne))
        order = sorted(range(len(ex)), key=lambda j: (-round(float(sim[j]), 12), names[j]))[:4]
        want += [(i, r + 1, names[j], round(float(sim[j]), 6)) for r, j in enumerate(order) if sim[j] >= 0.32]
    for block in (4096, 700, 20_000):
        got = [tuple(r) for r in reaimed.cosine_topk(df, edf, block=block).collect()]
        assert sorted(got) == sorted(want)
    assert (3, 1) not in {w[:2] for w in want} and [w[2] for w in want if w[0] == 99][:2] == ["e00005", "e04001"]
    assert reaimed.cosine_topk(df, edf.where("1 = 0")).count() == 0
