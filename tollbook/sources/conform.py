"""From raw text columns to typed facts and dimension rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.schemas import AMOUNT, CDR_EVENTS

# What the extract's headers, once normalized, are called in the tables.
FACT_NAMES = {
    "object_type": "object_type_code",
    "operation_type": "operation_type_id",
    "curent_amount": "current_amount_pre",
    "curent_amount_2": "current_amount_post",
    "charge_amount_expire_time": "charge_expire_time",
    "curent_amount_expire_time": "current_amount_expire_time",
}
OFFER_NAMES = {"offerid": "offer_id", "nom de l'offre": "offer_name"}

ID_COLUMNS = ("cust_num", "object_id", "offer_id", "operation_type_id")
AMOUNT_COLUMNS = ("deduct_amount", "charge_amount", "current_amount_pre", "current_amount_post")
TIME_COLUMNS = ("creation_time", "charge_expire_time", "current_amount_expire_time")
REQUIRED_COLUMNS = ("cdr_id", "creation_time", "cust_num", "operation_type_id")
FACT_COLUMNS = tuple(f.name for f in CDR_EVENTS if f.name != "cdr_event_id")

CUSTOMER_TYPES = ("S", "A")
CONFIRMED_OPERATIONS = (1, 5)


def normalize_headers(frame: DataFrame, dots: str = "_") -> DataFrame:
    """Trimmed lower-case column names, dots replaced."""
    return frame.toDF(*[name.strip().lower().replace(".", dots) for name in frame.columns])


def rename(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    return frame.withColumnsRenamed(names)


def project_known(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that the frame has, in the listed order."""
    present = set(frame.columns)
    return frame.select([name for name in columns if name in present])


def _on_present(frame: DataFrame, columns: Sequence[str], change) -> DataFrame:
    present = [name for name in columns if name in frame.columns]
    return frame.withColumns({name: change(F.col(name)) for name in present})


def whole_number(text: Column, kind: str = "bigint") -> Column:
    """An integer written plainly or as ``12.0``; anything else is NULL."""
    number = text.try_cast("decimal(30,6)")
    written_out = F.when(number == F.floor(number), number.try_cast(kind))
    return F.coalesce(text.try_cast(kind), written_out)


def amount(text: Column) -> Column:
    return text.try_cast(AMOUNT)


# Fourteen digits as they stand, perhaps with the ``.0`` of a spreadsheet.
_PLAIN_CLOCK = r"^\s*[1-9][0-9]{13}([.]0{1,6})?\s*$"


def clock_digits(text: Column) -> Column:
    """The digits of a time or other whole number; other spellings of numbers go by decimals."""
    plain = F.substring(F.trim(text), 1, 14)
    return F.when(text.rlike(_PLAIN_CLOCK), plain).otherwise(whole_number(text).cast("string"))


def _clock(digits: Column, text: Column) -> Column:
    def part(start: int, length: int) -> Column:
        return F.substring(digits, start, length).cast("int")

    from_digits = F.try_make_timestamp_ntz(
        part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), part(13, 2)
    )
    return F.when(F.length(digits) == 14, from_digits).when(
        digits.isNull(), text.try_cast("timestamp_ntz")
    )


def wall_clock(text: Column) -> Column:
    """``yyyyMMddHHmmss``, also when a spreadsheet made it ``...00.0``, or an ISO time."""
    return _clock(clock_digits(text), text)


def coerce_numeric(frame: DataFrame) -> DataFrame:
    """Identifiers and amounts as numbers; what cannot be read becomes NULL.

    ``cdr_id`` stays text: the tables declare it so, and not every id is a number.
    """
    kinds = {"offer_id": "int", "operation_type_id": "smallint"}
    for name in ID_COLUMNS:
        frame = _on_present(
            frame, [name], lambda c, kind=kinds.get(name, "bigint"): whole_number(c, kind)
        )
    return _on_present(frame, AMOUNT_COLUMNS, amount)


def fill_amounts(frame: DataFrame) -> DataFrame:
    """Missing amounts count as zero."""
    return _on_present(frame, AMOUNT_COLUMNS, lambda c: F.coalesce(c, F.lit(0).cast(AMOUNT)))


def parse_times(frame: DataFrame) -> DataFrame:
    """The time columns as wall-clock times. Their digits are projected first, so that the eight
    places that use them share one reading of the text."""
    present = [name for name in TIME_COLUMNS if name in frame.columns]
    digits = frame.withColumns({f"{name} digits": clock_digits(F.col(name)) for name in present})
    parsed = {name: _clock(F.col(f"`{name} digits`"), F.col(name)) for name in present}
    return digits.withColumns(parsed).select(frame.columns)


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def conform(raw: DataFrame) -> DataFrame:
    """A raw extract with table column names and types, row for row.

    Type codes are upper-cased here and in the seeds, so ``c`` and ``C`` are one type.
    """
    named = rename(normalize_headers(raw), FACT_NAMES)
    named = _on_present(named, ("cdr_id", "cust_type"), _blank_to_null)
    named = _on_present(named, ("object_type_code",), lambda c: F.upper(_blank_to_null(c)))
    return fill_amounts(parse_times(coerce_numeric(named)))


def conform_offers(raw_offers: DataFrame) -> DataFrame:
    named = rename(normalize_headers(raw_offers, dots="."), OFFER_NAMES)
    return named.select(
        whole_number(F.col("offer_id"), "int").alias("offer_id"),
        _blank_to_null(F.col("offer_name")).alias("offer_name"),
    )


def missing_required(columns: Sequence[str] = REQUIRED_COLUMNS) -> Column:
    """The names of required columns a row lacks, as one text; NULL when it lacks none."""
    names = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return F.nullif(names, F.lit(""))


def drop_invalid(frame: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    return frame.na.drop(subset=list(columns))


def quarantine(frame: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The rows ``drop_invalid`` leaves out, each with the reason."""
    return frame.withColumn("missing_columns", missing_required(columns)).filter(
        F.col("missing_columns").isNotNull()
    )


def _unseen(rows: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not stored yet.

    The stored keys are first cut to those the rows mention. A small load then travels to
    a large table's scan, and the table itself is not shuffled.
    """
    if existing is None:
        return rows
    stored = existing.select(key)
    mentioned = stored.join(rows.select(key), key, "left_semi")
    return rows.join(mentioned, key, "left_anti")


def _first_per_key(frame: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the least in the given order, then in that of all columns.

    A minimum of structs is combined before the shuffle, so a key with very many copies
    sends one row per task.
    """
    others = [name for name in frame.columns if name != key]
    choice = F.struct(*order, F.struct(*others).alias("row"))
    best = frame.groupBy(key).agg(F.min(choice).alias("best"))
    return best.select(key, "best.row.*").select(frame.columns)


def _null_last(column: str) -> list[Column]:
    return [F.col(column).isNull().alias(f"{column}_missing"), F.col(column).alias(f"{column}_first")]


def build_customers(conformed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New customers with the type of their earliest record; other types are refused."""
    candidates = conformed.filter(
        F.col("cust_num").isNotNull() & F.col("cust_type").isin(*CUSTOMER_TYPES)
    ).select(F.col("cust_num").alias("cust_num_bigint"), "cust_type", "creation_time")
    # At most two rows a customer are left to choose from, and this fold needs no sort.
    folded = candidates.groupBy("cust_num_bigint", "cust_type").agg(
        F.min("creation_time").alias("creation_time")
    )
    first = _first_per_key(folded, "cust_num_bigint", _null_last("creation_time"))
    return _unseen(first.drop("creation_time"), existing, "cust_num_bigint")


def build_object_types(conformed: DataFrame, existing: DataFrame) -> DataFrame:
    """Type codes not known yet, numbered after the known ones in code order."""
    codes = (
        conformed.filter(F.length("object_type_code") == 1)
        .select("object_type_code")
        .distinct()
    )
    known = existing.select(F.upper("object_type_code").alias("object_type_code"))
    fresh = codes.join(known, "object_type_code", "left_anti")
    # Codes are single characters, so one group holds at most an alphabet of them.
    listed = fresh.agg(F.array_sort(F.collect_set("object_type_code")).alias("codes"))
    last = existing.agg(F.coalesce(F.max("object_type_id"), F.lit(0))).scalar()
    return listed.select(F.posexplode("codes").alias("place", "object_type_code")).select(
        (last + F.col("place") + 1).cast("int").alias("object_type_id"),
        "object_type_code",
        F.concat(F.lit("Auto-imported type "), "object_type_code").alias("description"),
    )


def build_offers(conformed_offers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Offers not stored yet; of several names for one id the first in text order."""
    named = conformed_offers.na.drop(subset=["offer_id", "offer_name"])
    return _unseen(_first_per_key(named, "offer_id", []), existing, "offer_id")


def build_operation_types(
    conformed: DataFrame,
    existing: DataFrame,
    descriptions: DataFrame,
    confirmed: tuple[int, int] = CONFIRMED_OPERATIONS,
) -> DataFrame:
    """Confirmed operations seen in the extract and not stored; stored labels stay."""
    seen = (
        conformed.filter(F.col("operation_type_id").between(*confirmed))
        .select("operation_type_id")
        .distinct()
    )
    return _unseen(seen, existing, "operation_type_id").join(
        descriptions, "operation_type_id", "left"
    )


def build_objects(
    conformed: DataFrame, object_types: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """New balance objects; of several records for one id the earliest expiry, then type."""
    types = object_types.select(
        F.upper("object_type_code").alias("object_type_code"), "object_type_id"
    )
    candidates = (
        conformed.filter(F.col("object_id").isNotNull() & F.col("cust_num").isNotNull())
        .join(types, "object_type_code")
        .select(
            F.col("object_id").alias("object_id_bigint"),
            F.col("cust_num").alias("cust_num_bigint"),
            "object_type_id",
            F.col("current_amount_expire_time").alias("expiry_date"),
        )
    )
    order = _null_last("expiry_date") + [F.col("object_type_id").alias("type_first")]
    folded = candidates.groupBy("object_id_bigint", "cust_num_bigint", "object_type_id").agg(
        F.min("expiry_date").alias("expiry_date")
    )
    first = _first_per_key(folded, "object_id_bigint", order)
    return _unseen(first, existing, "object_id_bigint")


def new_events(valid: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Facts whose ``cdr_id`` is not stored, once each: the earliest record of an id.

    ``cdr_event_id`` is a hash of ``cdr_id``, the same on every load. It breaks ties and
    marks a row as present; ``cdr_id`` is what identifies an event.
    """
    facts = project_known(valid, FACT_COLUMNS)
    first = _first_per_key(facts, "cdr_id", [F.col("creation_time").alias("earliest")])
    unseen = _unseen(first, existing, "cdr_id")
    return unseen.select(F.xxhash64("cdr_id").alias("cdr_event_id"), *facts.columns)


# Why a fact is refused, in the order in which reasons are told.
UNKNOWN_CUSTOMER, UNKNOWN_OBJECT = "unknown customer", "unknown object"
UNKNOWN_OPERATION, UNKNOWN_OFFER = "unknown operation", "unknown offer"


def judge_references(
    facts: DataFrame,
    customers: DataFrame,
    objects: DataFrame,
    offers: DataFrame,
    operation_types: DataFrame,
) -> DataFrame:
    """The facts with ``refused_because``: the references that do not exist, else NULL.

    References fail for few keys. The distinct keys of the facts are compared with the
    dimensions, and only the missing ones travel to the facts.
    """
    judged = facts
    reasons = []
    for column, known, key, reason in (
        ("cust_num", customers, "cust_num_bigint", UNKNOWN_CUSTOMER),
        ("object_id", objects, "object_id_bigint", UNKNOWN_OBJECT),
        ("operation_type_id", operation_types, "operation_type_id", UNKNOWN_OPERATION),
        ("offer_id", offers, "offer_id", UNKNOWN_OFFER),
    ):
        stored = known.select(F.col(key).alias(column))
        missing = facts.select(column).na.drop().distinct().join(stored, column, "left_anti")
        judged = judged.join(missing.withColumn(reason, F.lit(reason)), column, "left")
        none = F.when(F.col(column).isNull(), F.lit(reason)) if reason != UNKNOWN_OFFER else None
        reasons.append(F.coalesce(F.col(f"`{reason}`"), none) if none is not None else F.col(f"`{reason}`"))
    because = F.nullif(F.concat_ws(", ", *reasons), F.lit(""))
    return judged.select(*facts.columns, because.alias("refused_because"))


def enforce_references(
    facts: DataFrame,
    customers: DataFrame,
    objects: DataFrame,
    offers: DataFrame,
    operation_types: DataFrame,
) -> DataFrame:
    """Facts whose customer, object, operation and, where given, offer exist."""
    judged = judge_references(facts, customers, objects, offers, operation_types)
    return judged.filter(F.col("refused_because").isNull()).drop("refused_because")
