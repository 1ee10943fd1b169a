import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from evenhand.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "*", "evenhand-tests", 4, spark_checkpoint_dir=str(tmp_path_factory.mktemp("work")))
    session.sparkContext.setLogLevel("ERROR")
    return session


def collect(df, *keys):
    """Rows as dicts, in key order."""
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[k]) for k in keys))
