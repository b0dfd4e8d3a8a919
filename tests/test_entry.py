import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') for n in q))"


def run(folder):
    return subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True)


def test_without_the_corpus_operators(tmp_path):
    """Deleted as a whole they are absent; what they need must not be."""
    for part in ("feedweir", "__spark_entry__.py"):
        copy = shutil.copytree if (HERE / part).is_dir() else shutil.copy
        copy(HERE / part, tmp_path / part)
    shutil.rmtree(tmp_path / "feedweir" / "llm", ignore_errors=True)
    assert run(tmp_path).stdout.split()[1] == "False"
    (tmp_path / "corpus_pipeline.py").write_text("import feedweir.llm.ngram_join")
    assert run(tmp_path).stdout.split()[1] == "False"
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in run(tmp_path).stderr
