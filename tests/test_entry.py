"""The driver's entry module."""

import subprocess
import sys
from pathlib import Path


def test_imports_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'lint_report' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
