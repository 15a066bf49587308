from pyspark.sql import functions as F

from formspark.functions.text import fold
from formspark.operators.rules import Model, run_rules
from formspark.plans.tables import FORM_FIELDS, spark_table
from formspark.streaming import per_batch

SF = "/root/testdata/sf0.001"


def test_findings_of_a_stream(spark, tmp_path):
    fields = spark_table(spark, SF, FORM_FIELDS)
    fields.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields.schema).parquet(str(tmp_path / "in"))
    query = per_batch(stream, lambda df: run_rules(Model(df), ["R04", "R14"]), str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = run_rules(Model(fields), ["R04", "R14"]).groupBy("rule").count().collect()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("rule").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_expressions_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("Código",), (" Año ",)], "x string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string").parquet(str(tmp_path / "in")).select(fold("x").alias("x"))
    query = stream.writeStream.format("memory").queryName("folded").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.x for r in spark.table("folded").select(F.col("x")).collect()} == {"codigo", "ano"}
