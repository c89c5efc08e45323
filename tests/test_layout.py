from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "tidewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tidewright.llm" not in path.read_text()
