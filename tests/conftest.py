import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from broadsheet.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"
# Test modules build columns when they are imported, which needs a running session.
SESSION = local_session(8, "tests")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(DATA).is_dir():
        pytest.skip("no fixture tables")
    return DATA


@pytest.fixture
def one(spark):
    """Evaluate an expression over a column ``v`` of given values, in order."""

    def run(expression, values, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in rows.coalesce(1).orderBy("i").select(expression).collect()]

    return run
