"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from dosegrid.session import shared_folder


class Cluster:
    """A session on a cluster, as far as the folder depends on it."""

    def __init__(self, master, folder=None, context_folder=None):
        self.folder = folder
        self.conf = SimpleNamespace(get=lambda key, default: self.folder or default)
        self.sparkContext = SimpleNamespace(
            master=master,
            getCheckpointDir=lambda: self.context_folder,
            setCheckpointDir=lambda path: setattr(self, "context_folder", path),
        )
        self.context_folder = context_folder


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(master))
    assert shared_folder(Cluster(master, "hdfs://n/shared")) == "hdfs://n/shared"
    assert shared_folder(Cluster(master, context_folder="hdfs://n/c")) == "hdfs://n/c"


@pytest.mark.parametrize("master", ["local", "local[4]"])
def test_one_process_may_use_its_own_disk(master):
    assert "dosegrid-" in shared_folder(Cluster(master))


def test_tables_of_a_run_are_removed_at_its_end(spark, tmp_path):
    from pathlib import Path

    from dosegrid.session import _STORED, durable, measured_bytes, run_store

    kept = durable(spark.range(5))
    with run_store(spark) as folder:
        inside = durable(spark.range(10))
        with run_store(spark) as inner:
            durable(spark.range(3))
            assert len(list(Path(inner.removeprefix("file:")).iterdir())) == 1
        assert not Path(inner.removeprefix("file:")).exists()
        assert inside.count() == 10 and inside in _STORED
        inside.write.parquet(str(tmp_path / "result"))
    assert not Path(folder.removeprefix("file:")).exists() and inside not in _STORED
    assert kept.count() == 5 and measured_bytes(kept) > 0
    assert spark.read.parquet(str(tmp_path / "result")).count() == 10


def test_a_failed_run_is_removed_too(spark):
    from pathlib import Path

    from dosegrid.session import durable, run_store

    with pytest.raises(ValueError), run_store(spark) as folder:
        durable(spark.range(10))
        raise ValueError
    assert not Path(folder.removeprefix("file:")).exists()
    assert durable(spark.range(2)).count() == 2


def test_what_is_known_of_a_table_is_made_once(spark):
    from dosegrid.session import remembered

    made = []
    table, other = spark.range(1), spark.range(1)
    for df in (table, table, other):
        remembered(df, "count", lambda df=df: made.append(df) or df.count())
    assert made == [table, other]
    assert remembered(table, "more", lambda: 7) == 7


def test_a_dozen_broadcasts_fit_the_driver():
    from dosegrid.session import BROADCAST_BYTES

    assert 12 * BROADCAST_BYTES < 1000e6


def test_sites_are_dealt_to_all_cores(spark, tmp_path):
    from checks import inputs

    spark.sql("SELECT id AS p_partkey, 'A' AS p_type, 5 AS p_size FROM range(50)").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT id AS s_suppkey, concat('S', id) AS s_name FROM range(3)").write.parquet(f"{tmp_path}/supplier.parquet")
    for lines in (inputs.catalogue_lines(spark, str(tmp_path)), inputs.associations_raw(spark, str(tmp_path))):
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    assert inputs.sites(spark, str(tmp_path)).count() == 50
