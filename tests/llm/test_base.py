import os

import pytest

from plumbline.llm import base


class Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default=None):
        return self.folder or default


class Session:
    def __init__(self, folder, master):
        self.conf = Conf(folder)
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_folder_is_that_of_the_setting_or_a_local_one():
    assert base.shared_folder(Session("s3a://b/x/", "spark://host:7077")) == "s3a://b/x"
    own = base.shared_folder(Session(None, "local[2]"))
    assert os.path.isdir(own) and base.shared_folder(Session(None, "local-cluster[1,1,1]")) == own
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        base.shared_folder(Session(None, "spark://host:7077"))


def test_tables_of_a_stage_are_deleted_at_its_end(spark):
    with base.stage_tables(spark):
        inner = base.stored(spark.range(3))
        kept = base.stored(inner, note=False)
        (path,) = {os.path.dirname(p).removeprefix("file://") for p in inner.inputFiles()}
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 3


def test_checkpointed_keeps_partitions(spark):
    df = base.checkpointed(spark.range(100).repartitionByRange(3, "id").sortWithinPartitions("id"))
    parts = [r.p for r in df.selectExpr("spark_partition_id() AS p", "id").orderBy("id").collect()]
    assert parts == sorted(parts) and df.count() == 100
