"""Row numbers stay with their rows, however a frame is read."""

import pytest
from pyspark.sql import functions as F

from quillstone.session import numbered


def rows_by_text(df):
    found = {r.text: r.row for r in numbered(df).select("doc.text", "row").collect()}
    assert len(set(found.values())) == len(found)
    return found


@pytest.mark.parametrize("files", [1, 5, 70])
def test_numbers_do_not_follow_the_splits(spark, tmp_path, files):
    path = str(tmp_path / "a table, with ü")
    spark.range(700).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(files).write.option("parquet.block.size", 1024).parquet(path)
    found = []
    for splits, size in ((1, "128m"), (40, "2k")):
        spark.conf.set("spark.sql.files.minPartitionNum", splits)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append(rows_by_text(spark.read.parquet(path)))
        found.append(rows_by_text(spark.read.parquet(path).where("id >= 0").withColumn("more", F.lit(1))))
        found.append(rows_by_text(spark.read.parquet(path).select("text")))
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(f == found[0] for f in found) and len(found[0]) == 700


def test_other_frames_are_written_once(spark):
    drawn = spark.range(50).select(F.rand().cast("string").alias("text"))
    kept = numbered(drawn)
    assert kept.collect() == kept.collect() and kept.select("row").distinct().count() == 50
    both = numbered(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "row long, doc string"))
    assert both.columns == ["doc", "row"] and both.select("doc.row", "doc.doc").count() == 3
    assert numbered(spark.range(0)).count() == 0
