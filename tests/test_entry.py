"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "importance_score" in df.columns


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_optional_subpackage(tmp_path):
    """What is left when the subpackage and the pipeline are deleted still answers."""
    shutil.copytree(f"{entry.ROOT}/weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{entry.ROOT}/__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e\n"
        "assert 'feed_top_page' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert 'pipeline' not in e.queries() and e.oracle_sql() and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


def test_what_breaks_inside_the_subpackage_is_an_error(tmp_path):
    shutil.copytree(f"{entry.ROOT}/weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{entry.ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "weftline" / "llm" / "common.py").write_text("import no_such_module\n") if (tmp_path / "weftline" / "llm").exists() else None
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert (done.returncode != 0) == (tmp_path / "weftline" / "llm").exists()
