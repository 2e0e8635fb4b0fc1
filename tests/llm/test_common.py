from __future__ import annotations

import os

import pytest

from docspark.llm import common


def test_scratch_tables_come_and_go(spark):
    made = common.materialize(spark, spark.range(5), "numbers")
    assert made.count() == 5 and os.path.isdir(made._docspark_path) and made._docspark_path.startswith(common.shared_dir(spark))
    common.discard(made)
    assert not os.path.exists(made._docspark_path)
    common.discard(spark.range(1))
    kept = common.materialize(spark, spark.range(2), "more")
    common.clean_up(spark)
    assert not os.path.exists(kept._docspark_path)


def test_batches_are_bounded_but_never_widened(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000000")
        common.bounded_batches(spark)
        assert spark.conf.get(key).rstrip("b") == "1000000"
        spark.conf.unset(key)
        common.bounded_batches(spark)
        assert int(spark.conf.get(key).rstrip("b")) == common.BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_byte_sizes_may_have_units(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", common.BATCH_BYTES), ("1g", common.BATCH_BYTES), ("256k", 256 << 10)):
            spark.conf.set(key, given)
            common.bounded_batches(spark)
            now = spark.conf.get(key)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) == want
    finally:
        spark.conf.set(key, before)


def test_a_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)
        set = staticmethod(lambda key, value: None)

    class Session:
        conf = Conf

        class sparkContext:
            master = "spark://head:7077"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    os.rmdir(common.shared_dir(Session))


def test_clashing_columns_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "doc_id int, Kept string, input_Kept string, text string")
    out = common.apart(df, "kept", "fp")
    assert out.columns == ["doc_id", "input_input_Kept", "input_Kept", "text"] and out.first().input_input_Kept == "a"
