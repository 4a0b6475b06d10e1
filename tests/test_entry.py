import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 100


def test_entry_runs(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["group", "feature_id", "abundance", "position"]
    assert out.count() > 0


def test_task_functions_reach_workers_from_any_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r})\n"
        "from tests.compare import make_session\n"
        "import __spark_entry__ as e\n"
        "spark = make_session(2)\n"
        "q = e.queries()\n"
        "sf = '/root/testdata/sf0.001'\n"
        "print(len(q['e7_euclidean'](spark, sf).collect()), len(q['e12_convex_hull'](spark, sf).collect()))\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split()[0] == "45"
