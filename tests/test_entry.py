import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_module_without_the_training_operators(tmp_path):
    """Both folders and the pipeline can be deleted; the rest still imports and registers its queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(o) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})


def test_a_fault_inside_the_training_operators_is_raised(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    with (copy / "chunkwright" / "llm" / "bpe.py").open("a") as out:
        out.write("\nimport no_such_module\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})
    assert found.returncode and "no_such_module" in found.stderr


def test_nothing_else_imports_the_training_operators():
    for path in (ROOT / "chunkwright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "chunkwright.llm" not in path.read_text(), path


def test_flagship_query(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0].asDict().keys() == {"i0", "i1", "i2", "value"}
