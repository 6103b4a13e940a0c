"""The shared checkpoint folder named by the session is used, never replaced."""

from ragtide.operators.ingest import scratch_path
from ragtide.session import checkpoint_dir


def test_checkpoint_dir_from_session(spark):
    d = spark.conf.get("spark.checkpoint.dir")
    assert d and checkpoint_dir(spark) == d
    assert checkpoint_dir(spark) == d  # stable: never reset once named
    assert scratch_path(spark, "x").startswith(d) and scratch_path(spark, "x") != scratch_path(spark, "x")
