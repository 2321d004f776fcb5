import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p4_found", "p5_found"} <= set(queries)


def test_nothing_outside_imports_the_text_subpackage():
    for path in (ROOT / "weftline").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"weftline\.llm|from \.+llm", path.read_text()), path
