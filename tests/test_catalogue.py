import duckdb
import pytest
from oracle import connection, same

import __spark_entry__
from waymark import catalogue
from waymark.operators import knn

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", ["ivf_trained", "lsh_ann"])
def test_recall(spark, name, sf_dir):
    q, db = catalogue.sides(spark, sf_dir)
    pairs = lambda df: {(r[0], r[1]) for r in df.select("query_id", "item_id").collect()}
    exact, found = pairs(knn.without_self(knn.knn(q, db, catalogue.K + 1), catalogue.K)), pairs(catalogue.QUERIES[name](spark, sf_dir))
    recall = len(exact & found) / len(exact)
    print(name, sf_dir, recall)
    assert recall >= 0.9


def test_k_beyond_a_large_database(spark, tmp_path):
    made = spark.range(1, 111_130).where("id = 100 OR id % 100 <> 0").selectExpr("id AS vec_id", "array(CAST(id AS FLOAT), 1F) AS embedding", "0 AS label")
    made.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalogue.QUERIES["knn_k_gt_n"](spark, str(tmp_path)).count() == 111_129 - 1111 + 1


def test_l2_normalize_rounds_as_its_sql(spark, tmp_path):
    """Signs of zeros, halves, zero and huge vectors, nulls: written out, as -0.0 equals 0.0."""
    ties = [[(2 * k + 1) / 2e6, 0.0] for k in range(0, 5000, 7)]
    vecs = [[1.0, -1e-7], [1.0, -0.0], [0.0, -0.0], [-1e-12, 1e-12], [1e25, -1e20], [3.0, -4.0], [-2.0**-7, 1.0], None, *ties]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    got = {r["item_id"]: (r["unit"], r["norm"]) for r in catalogue.QUERIES["l2_normalize"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {r[0]: (r[1], r[2]) for r in con.execute(catalogue.ORACLE_SQL["l2_normalize"]).fetchall()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))
    assert repr(got[0][0]) == "[1.0, -0.0]"


def test_hamming_near_dups_joins_no_rows_pair_by_pair(spark):
    plan = catalogue.QUERIES["hamming_near_dups"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
