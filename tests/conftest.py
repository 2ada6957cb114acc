import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

TRANSCRIPT = "id string, telegram_user_internal_id string, telegram_user_id string, created_at string, file_name string, transcription_text string"


@pytest.fixture(scope="session")
def spark():
    from turnwise.session import get_spark

    session = get_spark(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def transcripts(spark):
    """Transcripts from (id, user, created_at, text) rows, with an extra column whose name clashes with inner ones."""

    def make(rows):
        full = [(r[0], r[1], None, r[2], None, r[3], "x") for r in rows]
        return spark.createDataFrame(full, TRANSCRIPT + ", _spoken string")

    return make
