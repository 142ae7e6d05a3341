import duckdb
import pytest

import __spark_entry__ as entry  # registers all queries
from healthloom.plans.table_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(name, spark, duck):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = sorted((plain(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((plain(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    spark.catalog.clearCache()


def test_every_query_is_registered(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_streaming_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from healthloom.operators import findings as P
    from healthloom.plans.table_queries import normal
    from healthloom.streaming.health import windowed_impact

    rows = P.mark_eligible(normal(spark, SF)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.select("ts", "module", "category", "tier", "eligible").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windowed_impact(stream).writeStream.outputMode("complete").format("memory").queryName("impact").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("impact").collect())) == sorted(map(tuple, windowed_impact(rows).collect()))
