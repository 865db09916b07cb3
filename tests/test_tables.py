import glob

from pyspark.sql import functions as F

from plumbline.operators import tables


def test_settings_at_their_default_are_found(spark):
    spark.conf.unset(tables.BATCH)
    assert tables.setting(spark, "spark.sql.no.such.setting") is None
    assert tables.setting(spark, tables.BATCH) == tables.USUAL
    tables.small_batches(spark)
    assert spark.conf.get(tables.BATCH) == tables.SMALL
    spark.conf.set(tables.BATCH, "1m")
    tables.small_batches(spark)
    assert spark.conf.get(tables.BATCH) == "1m"
    spark.conf.unset(tables.BATCH)


def test_a_written_table_is_written_with_cleanup_of_its_shuffles(spark, monkeypatch):
    spark.conf.unset(tables.CLEANUP)
    seen = []
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    write = type(frame).write.fget
    monkeypatch.setattr(type(frame), "write", property(lambda self: (seen.append(spark.conf.get(tables.CLEANUP)), write(self))[1]))
    kept = tables.Tables(spark, "test")
    assert kept.put(frame, "x").count() == 7
    assert seen == ["true"] and spark.conf.get(tables.CLEANUP) == "false"
    kept.drop("x")
    assert not glob.glob(f"{kept.folder.removeprefix('file://')}/x-*")
