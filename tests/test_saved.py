import pytest
from pyspark.sql import functions as F

from voxlake.streaming import saved


def opened(spark, *names):
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "n long, path string")


def listed(spark, folder):
    return [r.path for r in saved.restore(spark, folder).orderBy("rank").collect()]


def test_lists_are_merged_and_kept(spark, tmp_path):
    folder = str(tmp_path)
    assert saved.current(spark, folder) is None and listed(spark, folder) == []
    for names, want in ((("a", "b", "a", "c"), ["c", "a", "b"]), (("b",), ["b", "c", "a"]), ((), ["b", "c", "a"]), (map(str, range(9)), [*"876543210", "b"])):
        # the list is derived from the one that it replaces
        saved.save(saved.merged(saved.restore(spark, folder), opened(spark, *names) if names else opened(spark, "x").where("false"), "path", ["n"]), folder)
        assert listed(spark, folder) == want
        assert [r.rank for r in saved.restore(spark, folder).orderBy("rank").collect()] == list(range(1, len(want) + 1))
    assert len(list(tmp_path.glob("v-*"))) == 2
    saved.cleared(spark, folder)
    assert listed(spark, folder) == [] and saved.restore(spark, folder).columns == ["path", "rank"]


def test_a_save_that_fails_leaves_the_list(spark, tmp_path):
    folder = str(tmp_path)
    saved.save(saved.merged(saved.restore(spark, folder), opened(spark, "a", "b"), "path", ["n"]), folder)
    bad = saved.restore(spark, folder).withColumn("path", F.raise_error(F.lit("the executor is lost")).cast("string"))
    with pytest.raises(Exception, match="executor is lost"):
        saved.save(bad, folder)
    assert listed(spark, folder) == ["b", "a"]
    saved.save(saved.restore(spark, folder).where("rank = 1"), folder)
    assert listed(spark, folder) == ["b"]


def test_a_list_that_changed_meanwhile_is_left(spark, tmp_path):
    folder = str(tmp_path)
    saved.save(opened(spark, "a").select("path", F.lit(1).alias("rank")), folder, None)
    seen = saved.current(spark, folder)
    saved.save(opened(spark, "b").select("path", F.lit(1).alias("rank")), folder, seen)
    with pytest.raises(saved.Changed):
        saved.save(opened(spark, "c").select("path", F.lit(1).alias("rank")), folder, seen)
    assert listed(spark, folder) == ["b"]


def test_a_reader_keeps_what_it_reads(spark, tmp_path):
    folder = str(tmp_path)
    saved.save(opened(spark, "a").select("path", F.lit(1).alias("rank")), folder)
    reading = saved.restore(spark, folder)
    saved.save(opened(spark, "b").select("path", F.lit(1).alias("rank")), folder)
    assert [r.path for r in reading.collect()] == ["a"] and listed(spark, folder) == ["b"]
