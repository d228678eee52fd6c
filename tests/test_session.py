"""Where lineage is cut."""

import os
import subprocess
import sys

import pytest

from sievework.session import SMALL_TABLE_ROWS, small_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
from sievework.session import build_session, cut_lineage, shared_folder
conf = {"spark.checkpoint.dir": sys.argv[1]} if len(sys.argv) > 1 else {}
spark = build_session("t", 1, **conf)
written = cut_lineage(spark.range(5))
print("FOLDER", shared_folder(spark), written.count(), written.inputFiles()[0])
"""


@pytest.mark.parametrize("named", [True, False])
def test_written_tables_go_to_the_shared_folder(tmp_path, named):
    args = [str(tmp_path)] if named else []
    done = subprocess.run([sys.executable, "-c", SCRIPT, *args], capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": ROOT}, cwd=str(tmp_path))
    folder, rows, file = next(line for line in done.stdout.splitlines() if line.startswith("FOLDER")).split()[1:]
    assert rows == "5" and folder in file and (folder == str(tmp_path)) is named


def test_only_small_tables_are_hinted(spark):
    def hinted(n):
        table = small_table(spark, [(i,) for i in range(n)], "i INT")
        return "broadcast" in table._jdf.queryExecution().logical().toString().lower()

    assert hinted(3) and not hinted(SMALL_TABLE_ROWS + 1)
