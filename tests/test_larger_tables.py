"""What jobs on larger tables must not do twice."""
from pyspark.sql import functions as F

from labelaudit.operators import views as vw


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_row_is_parsed_once_for_all_its_views(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [(1, '{"Accept": "a/1.2", "dnt": "1", "cf-ray": "x"}', '{"k": 1, "cpc": "{{cpc}}"}'), (2, "no json", None), (3, '{"a": 1, "a": 2}', "[1]")]
    spark.createDataFrame(rows, "id long, headers string, request string").write.parquet(path)
    df = spark.read.parquet(path)
    pool = vw.view_pool(df, 3)
    above = plan(pool).split("Generate explode")[0]
    assert "from_json" in plan(pool) and "from_json" not in above
    assert pool.columns == ["id", "headers", "request", "view"]
    alone = df.withColumn("view", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(
        "id", "view", vw.augment_headers(F.col("headers"), "medium_http_aug", 42, F.col("view"), F.col("id")).alias("headers"),
        vw.augment_request(F.col("request"), "medium_http_aug", 42, F.col("view"), F.col("id")).alias("request"))
    assert sorted(map(str, pool.select(*alone.columns).collect())) == sorted(map(str, alone.collect()))
