import pytest

from loreframe import session


def test_only_a_local_session_takes_its_own_folder(spark, monkeypatch):
    assert session.is_local("local") and session.is_local("local[8]")
    assert not session.is_local("local-cluster[3,2,1024]") and not session.is_local("yarn")
    assert session.shared_dir(spark)
    if spark.conf.get(session.CHECKPOINT_KEY, None) is None:
        monkeypatch.setattr(session, "is_local", lambda master: False)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(spark)
