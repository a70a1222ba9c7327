from __future__ import annotations

import hashlib
import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tasklattice.schema import TASK_SCHEMA  # noqa: E402
from tasklattice.session import build_session  # noqa: E402

START = datetime(2024, 1, 15, 10, 30)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            # Compiling code for a handful of rows takes longer than running it.
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.maxMetadataStringLength": "10000",
            # Equal rows would compress to nothing and hide the skew under test.
            "spark.shuffle.compress": "false",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def sha(text) -> str:
    return hashlib.sha1(str(text).encode()).hexdigest()


def task(name, **fields):
    """A task row with the usual defaults; `name` gives the id and the title."""
    row = {
        "id": sha(name),
        "parent": None,
        "priority": "medium",
        "state": "INBOX",
        "kind": "BUG",
        "title": str(name),
        "description": f"About {name}",
        "author": "A <a@example.com>",
        "created": START,
        "updated": START,
        "source": "",
        "blocked_by": None,
        "tags": "",
    }
    for link in ("parent", "blocked_by"):
        if fields.get(link) is not None:
            fields[link] = sha(fields[link])
    if isinstance(fields.get("created"), int):
        fields["created"] = START + timedelta(seconds=fields["created"])
    row.update(fields)
    return row


@pytest.fixture(scope="session")
def make_tasks(spark):
    def make(*rows):
        return spark.createDataFrame([tuple(r[n] for n in TASK_SCHEMA.names) for r in rows], TASK_SCHEMA)

    return make


def names(df, column="title"):
    return [row[column] for row in df.collect()]
