import pytest

from trailmark.llm import storage


class Session:
    """As much of a session as the folder's name needs."""

    def __init__(self, master):
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default):
        return default


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        storage.shared_dir(Session(master))


def test_tables_are_written_qualified_and_deleted(spark, tmp_path):
    assert storage.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    df, path = storage.table(spark.range(5), "five")
    assert path.startswith("file:///") and df.count() == 5
    storage.delete(spark, path)
    assert path not in storage._made
