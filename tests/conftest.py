import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duolex.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def corpus(spark):
    """(row_id, lang, text): a third language and uneven sizes."""
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else ("fr" if i % 2 else "de")
        rows.append((i, lang, " ".join(f"{lang}word{(i * 7 + j) % 23}" for j in range(25 + i % 5))))
    return spark.createDataFrame(rows, "row_id bigint, lang string, text string").repartition(3)
