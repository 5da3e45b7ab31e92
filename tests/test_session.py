from __future__ import annotations

import os
import subprocess
import sys

from preciario import session


def test_shared_folder_is_the_one_the_cluster_names(tmp_path):
    """Read from the session, in a process of its own: it is a core setting."""
    code = (
        "from preciario.session import build_session, scratch_path, written\n"
        f"spark = build_session('x', 'local[2]', **{{'spark.checkpoint.dir': '{tmp_path}', 'spark.ui.enabled': 'false'}})\n"
        "print(scratch_path(spark, 'a'))\n"
        "assert written(spark.range(3).toDF('i'), 'b').count() == 3\n"
    )
    root = os.path.dirname(os.path.dirname(session.__file__))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    assert done.returncode == 0, done.stderr
    assert f"{tmp_path}/a-" in done.stdout and any(f.startswith("b-") for f in os.listdir(tmp_path))


def test_paths_are_never_reused(spark):
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_shuffles_follow_the_input(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert session.size_shuffles(spark, "/root/testdata/sf0.001") == 8
        monkeypatch.setattr(session, "BYTES_PER_PARTITION", 1000)
        many = session.size_shuffles(spark, "/root/testdata/sf0.001")
        assert many > 500 and spark.conf.get("spark.sql.shuffle.partitions") == str(many)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
