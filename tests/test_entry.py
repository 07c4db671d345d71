import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_names_have_sql_and_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    """Neither the library nor the entry module needs that subpackage or the pipeline."""
    for p in REPO.rglob("*.py"):
        name = p.relative_to(REPO)
        if "llm" not in name.parts and name.name != "corpus_pipeline.py" and ".git" not in name.parts:
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(p.read_text())
    code = "import __spark_entry__ as e; import bench, shelfmark.cli, shelfmark.plans.medallion; assert 'pipeline' not in e.queries() and len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
