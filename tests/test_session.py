"""The shared folder: required off local masters."""

import pytest

from textlab import session


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    master = "local-cluster[3,2,3000]"

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return _Conf()


class _Session:
    sparkContext = _Context()
    conf = _Conf()


def test_non_local_master_needs_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session())


def test_local_session_has_a_folder(spark):
    assert session.ensure_checkpoint_dir(spark)
