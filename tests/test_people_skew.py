from pyspark.sql import functions as F

from ledgerline.operators import people


def test_a_hot_key_of_a_large_registry_is_split(spark, monkeypatch):
    """Half of all rows have one address and half none: no task reads them all."""
    monkeypatch.setattr(people, "BROADCAST_ROWS", 0)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        registry = spark.range(5000).select(F.col("id").cast("string").alias("canonical_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("o").alias("org"), F.array(F.concat(F.lit("m"), "id")).alias("emails"))
        rows = spark.range(0, 60_000, 1, 16).select("id", F.when(F.col("id") % 2 == 0, "m7").alias("mail"), F.concat(F.lit("x"), "id").alias("called"))
        out = people.resolved(rows, registry, "mail", "called").select("id", "person_name")
        assert out.groupBy("person_name").count().filter("count > 1").collect() == [("n7", 30_000)]
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
