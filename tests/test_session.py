"""Intermediate tables of an application."""

from faktorium.session import clear_work, configure, work_folder, work_path


def test_work_is_cleared_by_its_owner(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        first, second = work_path(spark, "a"), work_path(spark, "a")
        assert first != second and first.startswith(work_folder(spark))
        spark.range(3).write.parquet(first)
        assert clear_work(spark) and not clear_work(spark)
        assert not list(tmp_path.rglob("*.parquet"))
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)


def test_small_files_are_read_together(spark, tmp_path):
    configure(spark)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text("x")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
        read = spark.read.option("wholetext", True).text(str(tmp_path))
        assert read.count() == 300 and read.rdd.getNumPartitions() <= max(16, 2 * spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
