"""Rows of the star schema for tests, and results as dictionaries."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from tollbook import schemas

NOW = datetime(2024, 3, 31, 12, 0)


def event(number: int, cust: int, at: datetime, **fields) -> dict:
    row = {name: None for name in schemas.CDR_EVENTS.names}
    row.update(
        cdr_event_id=number,
        cdr_id=str(number),
        creation_time=at,
        cust_num=cust,
        object_id=cust * 10,
        operation_type_id=1,
        charge_amount=Decimal("0.00"),
    )
    for name, value in fields.items():
        known = row.get(name, ...)
        assert known is not ..., name
        is_amount = name.endswith("_amount") or name.startswith("current_amount_p")
        row[name] = Decimal(str(value)) if is_amount and value is not None else value
    return row


def rows_of(frame) -> list[dict]:
    return [row.asDict() for row in frame.collect()]


def keyed(frame, key: str) -> dict:
    return {row[key]: row.asDict() for row in frame.collect()}
