import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queries_are_there_without_the_corpus_operators(tmp_path):
    """What is left after those folders have been removed still imports."""
    for p in ROOT.iterdir():
        if p.name not in ("snaplake", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "snaplake").mkdir()
    for p in (ROOT / "snaplake").iterdir():
        if p.name != "llm":
            (tmp_path / "snaplake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(x.startswith('op') for x in q); e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
