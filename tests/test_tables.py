def test_checkpoint_dir_is_read_from_the_session(spark):
    from storelens.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_checkpoint_dir_refuses_a_machine_local_folder_on_a_cluster():
    import pytest
    from storelens.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, key, value):
            raise AssertionError("no folder may be chosen for a cluster")

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
