from pyspark.sql import functions as F

from daftar.session import local_session


def test_group_after_union_of_equally_partitioned_inputs(spark):
    spark = local_session()  # sets what right results need
    a = spark.range(200).select((F.col("id") % 5).alias("k"), "id").groupBy("k", "id").count()
    b = spark.range(40).select((F.col("id") % 5).alias("k"), "id").groupBy("k", "id").count()
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    assert a.unionByName(b).groupBy("k", "id").agg(F.sum("count")).count() == 200
