"""Every query of the text operators over the whole smallest tables."""

from pathlib import Path

import pytest

from graphloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
COLUMNS = {"p2_found": ["path"], "p3_found": ["node_id"], "p4_found": ["path"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and rows and len({tuple(map(str, r)) for r in rows}) == len(rows)


def test_nothing_else_imports_the_text_operators():
    root = Path(__file__).resolve().parents[2] / "graphloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "graphloom.llm" not in path.read_text() and "from .llm" not in path.read_text()
