import pytest

from holdfast import session


class FakeSession:
    """Just the settings the checkpoint folder depends on."""

    def __init__(self, configured, current, master):
        self.known = {"configured": configured, "current": current}
        self.conf = self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return self.known["configured"] or default

    def getCheckpointDir(self):
        return self.known["current"]

    def setCheckpointDir(self, folder):
        self.known["current"] = folder


def test_named_folder_is_used():
    fake = FakeSession("hdfs://shared", None, "yarn")
    assert session.checkpoint_root(fake) == "hdfs://shared"
    assert fake.known["current"] == "hdfs://shared"
    assert session.scratch_path(fake, "x").startswith("hdfs://shared/holdfast-")


def test_folder_set_on_the_context_is_used():
    assert session.checkpoint_root(FakeSession(None, "s3a://b/c", "yarn")) == "s3a://b/c"


def test_only_local_sessions_may_go_without(tmp_path, monkeypatch):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(FakeSession(None, None, "yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(FakeSession(None, None, "local-cluster[2,1,1024]"))
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path))
    assert session.checkpoint_root(FakeSession(None, None, "local[2]")) == str(tmp_path)


def test_saved_rows_no_longer_depend_on_their_source(spark):
    rows = session.saved(spark.range(10).selectExpr("id", "uuid() AS u"))
    assert rows.collect() == rows.collect() and rows.count() == 10
