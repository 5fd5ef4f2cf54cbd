import os

import pytest

from spanwise.llm import common


def test_tables_live_in_the_sessions_folder_until_cleared(spark):
    folder = common.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir", None) in (folder, None)
    own = common.session_dir(spark)
    assert own.startswith(f"{folder}/spanwise/") and own == common.session_dir(spark)
    table = common.stored(spark.range(3), "t")
    other = spark.newSession()
    other.conf.set("spark.spanwise.shared", folder)
    kept = common.stored(other.range(4), "t")
    assert common.session_dir(other) != own and os.listdir(own.removeprefix("file:"))
    common.clear(spark)
    assert not os.path.exists(own.removeprefix("file:")) and kept.count() == 4
    with pytest.raises(Exception, match="exist|FILE_NOT_EXIST|FileNotFound"):
        table.count()
    common.clear(other)


def test_no_folder_of_one_machine_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster)


def test_free_names(spark):
    assert common.free_name(spark.createDataFrame([], "a int, __Row int, ___row int"), "row") == "____row"


def test_remainder(spark):
    import zlib

    rows = spark.createDataFrame([(k,) for k in (None, 0, 7, -3, 10**12)], "i long").select("i", common.id_remainder("i", 7).alias("r")).collect()
    assert [r["r"] for r in rows] == [zlib.crc32(("" if r["i"] is None else str(r["i"])).encode()) % 7 for r in rows]


def test_a_folder_stands_in_where_none_is_set(spark):
    class Unset:
        class conf:
            kept: dict = {}
            get = classmethod(lambda cls, key, default: cls.kept.get(key, default))
            set = classmethod(lambda cls, key, value: cls.kept.update({key: value}))

        class sparkContext:
            master = "local[2]"

    assert common.shared_dir(Unset) == common.shared_dir(Unset) and common.shared_dir(Unset).startswith("file:///")
