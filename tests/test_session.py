"""Where intermediate tables go."""

import pytest
from pyspark.sql import functions as F

from unitloom.session import SHUFFLE_CLEANUP, TASK_SETTINGS, cut_lineage, shared_folder, tune


class FakeSession:
    """Stands for a session's settings and context."""

    def __init__(self, master, named=None):
        self.master, self.named, self.folder = master, named, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" and self.named else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_cluster_names_its_folder():
    assert shared_folder(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("yarn"))


def test_a_local_master_makes_one_folder():
    session = FakeSession("local[2]")
    assert shared_folder(session) == shared_folder(session) == session.folder


def test_a_step_is_written_once(spark):
    made = cut_lineage(spark.range(5).selectExpr("id", "uuid() as u"), "step")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, made.collect()))
    assert made.columns == ["id", "u"] and "/step-" in made.inputFiles()[0]


def test_steps_can_be_dropped(spark):
    from unitloom.session import cut_lineage, drop_steps, steps_written
    before = steps_written()
    assert cut_lineage(spark.range(3)).count() == 3
    new = [path for path in steps_written() if path not in before]
    drop_steps(spark, new)
    assert len(new) == 1 and steps_written() == before
    target = spark._jvm.org.apache.hadoop.fs.Path(new[0])
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def test_a_written_step_leaves_no_shuffle_files(spark):
    import time

    def files():
        held = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.size())}

    before, was = files(), spark.conf.get(SHUFFLE_CLEANUP)
    df = spark.range(1000).repartition(5, "id")
    step = cut_lineage(df)
    for _ in range(100):
        left = {name for name in files() - before if name.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(SHUFFLE_CLEANUP) == was
    # what was written can still be computed again
    assert step.count() == df.count() == 1000


def test_task_settings_are_put_back(spark):
    key = next(iter(TASK_SETTINGS))
    before = spark.conf.get(key, None)
    spark.conf.set(key, "5m")
    try:
        for _ in range(2):
            assert tune(spark, small_tasks=True).conf.get(key) == TASK_SETTINGS[key]
        assert tune(spark).conf.get(key) == "5m" == tune(spark).conf.get(key)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_a_setting_made_between_two_queries_over_facts_is_put_back(spark):
    key = next(iter(TASK_SETTINGS))
    before = spark.conf.get(key, None)
    try:
        tune(spark, small_tasks=True)
        spark.conf.set(key, "5m")
        tune(spark, small_tasks=True)
        assert tune(spark).conf.get(key) == "5m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_many_rows_in_small_files_are_not_broadcast(spark):
    """A million rows in a few MB of files would all be gathered by the driver."""
    import os

    try:
        tune(spark, small_tasks=True)
        ended = cut_lineage(spark.range(1_000_000).selectExpr("id", "'passed' as outcome"))
        items = cut_lineage(spark.range(1_000_000).selectExpr("id", "uuid() as text"))
        few = cut_lineage(spark.createDataFrame([("passed", 1)], "outcome string, code int"))
        size = sum(os.path.getsize(path.removeprefix("file:").replace("//", "/")) for path in ended.inputFiles())
        assert size < 10_000_000
        met = items.join(ended, "id").join(few, "outcome").agg(F.count("text"))
        rows = met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert rows[0][0] == 1_000_000 and plan.count("BroadcastHashJoin [outcome") >= 1 and "BroadcastHashJoin [id" not in plan
    finally:
        tune(spark)


def test_rising_columns_of_a_step_are_stored_as_differences(spark):
    import os

    rows = spark.range(200_000).selectExpr("id", "cast(nullif(id * 7, 21) as int) as at").coalesce(1)
    plain, rising = cut_lineage(rows, "plain"), cut_lineage(rows, "rising", rising=("id", "at"))
    assert rising.exceptAll(rows).isEmpty() and rising.count() == 200_000

    def size(df):
        return sum(os.path.getsize(path.removeprefix("file:").replace("//", "/")) for path in df.inputFiles())
    assert size(rising) < size(plain) / 2
