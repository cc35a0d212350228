import pathlib
import re

import __spark_entry__ as entry
from strandline import catalog

ROOT = pathlib.Path(entry.__file__).parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "file_id"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.queries()) <= set(queries)
    assert len(catalog.oracle_sql()) >= 70


def test_only_the_entry_knows_the_training_data_part():
    for path in (ROOT / "strandline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "strandline").parts:
            assert not re.search(r"strandline\.llm|from \.+llm", path.read_text()), path
    for path in (ROOT / "tests").glob("*.py"):
        assert "import strandline.llm" not in path.read_text().replace("# ", "") or path.name == "test_entry.py"


def test_no_local_checkpoints_or_cross_joins():
    for path in (ROOT / "strandline").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin", path.read_text()), path
