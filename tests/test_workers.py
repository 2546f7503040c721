"""Python workers need no copy of the package: Spark starts in another folder, with the package on the driver's path only."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from tabwright.session import local_session
spark = local_session(2)
for name in sys.argv[2:]:
    print(name, len(entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
"""


def run_elsewhere(folder, *names):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTEST_CURRENT_TEST")}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, *names], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return dict(line.split() for line in done.stdout.splitlines() if line.startswith(names))


def test_queries_run_from_another_folder(tmp_path):
    got = run_elsewhere(tmp_path, "nearest_distances_v01", "linear_utility_wide_v07", "impute_neighbours_f13",
                        "nearest_points_pruned_j06", "approximate_neighbours_j06")  # with a pivot tree; with random buckets
    assert len(got) == 5 and all(int(n) > 0 for n in got.values())


PLAIN = """
import sys
sys.path.insert(0, sys.argv[1])
from tabwright.session import local_session, materialize, stored, work_dir
spark = local_session(2)
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None, "the run must have no preset folder"
print("folder", work_dir(spark) == work_dir(spark), work_dir(spark) == sys.argv[2])
print("rows", materialize(spark.range(5)).count() + stored(spark.range(6)).count())
"""


def test_work_folder_without_any_setting(tmp_path):
    conf, own = tmp_path / "conf", tmp_path / "own"
    conf.mkdir()
    own.mkdir()
    for folder in (str(own), ""):
        env = {k: v for k, v in os.environ.items() if k != "TABWRIGHT_WORK_DIR"} | {"SPARK_CONF_DIR": str(conf)}
        env |= {"TABWRIGHT_WORK_DIR": folder} if folder else {}
        done = subprocess.run([sys.executable, "-c", PLAIN, ROOT, folder], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"folder True {bool(folder)}" in done.stdout and "rows 11" in done.stdout
    assert list(own.iterdir())
