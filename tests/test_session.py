"""The folder for intermediate tables: never a machine's own one on a cluster, and gone with the driver's process."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from fairlake import session

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from fairlake.session import local_session, shared_dir
spark = local_session("1")
path = shared_dir(spark, "probe")
spark.range(3).write.parquet(path)
assert spark.read.parquet(path).count() == 3
print(path)
"""


def test_intermediate_tables_go_with_the_process():
    root = str(Path(session.__file__).parents[1])
    out = subprocess.run([sys.executable, "-c", SCRIPT, root], capture_output=True, text=True, timeout=300, check=True).stdout
    path = out.strip().splitlines()[-1].removeprefix("file:")
    assert "probe-" in path and not Path(path).exists()


@pytest.mark.parametrize("master, warehouse, allowed", [
    ("spark://h:7077", "file:/home/x/spark-warehouse", False), ("yarn", "spark-warehouse", False), ("yarn", "hdfs://n/warehouse", True), ("local[4]", "file:/x", True)])
def test_a_machines_own_folder_is_refused_on_clusters(master, warehouse, allowed, monkeypatch):
    monkeypatch.setattr(session, "_MADE", [])
    settings = {"spark.sql.warehouse.dir": warehouse}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: settings.get(k, d)), sparkContext=SimpleNamespace(master=master))
    if allowed:
        assert session.shared_dir(spark, "t").startswith(f"{warehouse}/_intermediate/t-")
    else:
        with pytest.raises(ValueError):
            session.shared_dir(spark, "t")
