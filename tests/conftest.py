from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tollbook import schemas  # noqa: E402
from tollbook.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tollbook-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    """Build a star schema from rows; dimensions default to the seeds and what facts need."""

    def build(events=(), customers=(), objects=(), offers=None):
        def frame(rows, schema):
            rows = [tuple(r[n] for n in schema.names) if isinstance(r, dict) else r for r in rows]
            return spark.createDataFrame(list(rows), schema)

        tables = dict(schemas.seed_tables(spark))
        if offers is not None:
            tables["offers"] = frame(offers, schemas.OFFERS)
        tables["customers"] = frame(customers, schemas.CUSTOMERS)
        tables["objects"] = frame(objects, schemas.OBJECTS)
        tables["cdr_events"] = frame(events, schemas.CDR_EVENTS)
        return tables

    return build
