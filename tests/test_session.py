import os

import pytest

from grainstore import session


def test_written_tables_lie_in_the_shared_folder_and_are_removed(spark):
    with session.scratch_space(spark):
        df = session.written(spark.range(5), "numbers")
        plain = lambda x: x.replace("file://", "").replace("file:", "")
        file = plain(df.inputFiles()[0])
        assert df.count() == 5 and file.startswith(plain(session.shared_dir(spark)).rstrip("/")) and os.path.exists(file)
    assert not os.path.exists(file)


def test_a_cluster_must_name_the_folder():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())
