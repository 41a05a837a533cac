"""Validation and enrichment of landed events, the same for batch and stream.

Fields land as text. A bad value is a finding on its row: rows are never dropped and
no read fails. Every step is a projection, so validating needs no shuffle.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmill.functions.timeparts import instant
from metricmill.schemas import DOMAIN_OF_TYPE, LANDED_FIELDS, PAYLOADS

FIELDS: dict[str, T.DataType] = {}
for _schema in PAYLOADS.values():
    FIELDS.update({f.name: f.dataType for f in _schema.fields})

# All payload fields of all types, as text.
LANDED = T.StructType([T.StructField(name, T.StringType()) for name in FIELDS])
MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_type", "type", "event_timestamp", "timestamp", "data", "_bad")]
)

TYPED = "t_"  # prefix of the typed columns between parsing and checking
OPTIONAL = {"satisfaction_score", "nps_score", "arr"}
# ---- fixed values: range rules of the typed events -----------------------------
ABOVE_ZERO = {"revenue", "quantity"}
FROM_ZERO = {"inventory_level", "fulfillment_time_hours", "arr"}
BETWEEN = {"satisfaction_score": (1, 5), "nps_score": (0, 10)}
# ---- end of fixed values -------------------------------------------------------


# The years 1 to 9999 in Unix seconds.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


DIGITS = r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"


def parse_time(text: Column, quoted: Column | None = None) -> Column:
    """ISO text (``Z`` allowed) or Unix seconds of the years 1 to 9999; null when it is neither.

    ``quoted`` tells that the value was text in a JSON message: digits in quotes are not a time.
    """
    number = text.rlike(DIGITS)
    seconds = text.try_cast("double")
    if quoted is not None:
        seconds = F.when(~F.coalesce(quoted, F.lit(False)), seconds)
    inside = F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds)
    return F.when(number, F.timestamp_micros((inside * 1_000_000).cast("bigint"))).otherwise(F.try_to_timestamp(text))


def _in_quotes(text: Column, value: Column, path: Column) -> Column:
    """Whether a JSON message gives the value at a path as text; looked up for digits only.

    A message that is not strict JSON, with a bare NaN say, is searched for a quoted time.
    """
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return F.when(value.rlike(DIGITS), F.coalesce(kind == "STRING", text.rlike(r'timestamp"\s*:\s*"'))).otherwise(F.lit(False))


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to (event_type, declared, sent_at, payload, raw_data, sent_quoted, stamp_quoted).

    The payload is the ``data`` object, or the whole message when there is none. Text
    that is not JSON is kept in ``raw_data`` and goes on as a system event.
    """
    text = F.col(column)
    message = F.from_json(text, MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    m = raw.withColumn("m", message)
    nested = F.col("m.data").startswith("{")
    payload = F.from_json(F.when(nested, F.col("m.data")).otherwise(text), LANDED)
    return m.select(
        F.coalesce("m.event_type", F.lit("system")).alias("event_type"),
        F.coalesce("m.event_type", "m.type").alias("declared"),
        F.coalesce("m.event_timestamp", "m.timestamp").alias("sent_at"),
        payload.alias("payload"),
        F.when(F.col("m._bad").isNotNull() | F.col("m").isNull(), text).alias("raw_data"),
        text.alias("event"),
        _in_quotes(text, F.col("m.event_timestamp"), F.lit("$.event_timestamp")).alias("named_quoted"),
        _in_quotes(text, F.col("m.timestamp"), F.lit("$.timestamp")).alias("plain_quoted"),
        _in_quotes(text, payload["timestamp"], F.lit("$.data.timestamp")).alias("data_quoted"),
        F.col("m.event_timestamp").isNotNull().alias("named"),
        F.coalesce(nested, F.lit(False)).alias("nested"),
    ).withColumns(
        {
            "sent_quoted": F.when(F.col("named"), F.col("named_quoted")).otherwise(F.col("plain_quoted")),
            "stamp_quoted": F.when(F.col("nested"), F.col("data_quoted")).otherwise(F.col("plain_quoted")),
        }
    ).drop("named_quoted", "plain_quoted", "data_quoted", "named", "nested")


def landed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one known type with text (or typed) columns, in the shape of parsed messages.

    A blank cell is a null; a column the source lacks is null throughout. Cells have no quotes, so
    digits in a time column are Unix seconds.
    """
    def text(name: str) -> Column:
        if name not in rows.columns:
            return F.lit(None).cast("string")
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))

    fields = [text(name).alias(name) for name in FIELDS]
    return rows.select(
        F.lit(kind).alias("event_type"),
        F.lit(kind).alias("declared"),
        F.coalesce(text("event_timestamp"), text("timestamp")).alias("sent_at"),
        F.struct(*fields).alias("payload"),
        F.lit(None).cast("string").alias("raw_data"),
        F.struct(*[F.col(c) for c in rows.columns]).alias("event"),
        F.lit(False).alias("sent_quoted"),
        F.lit(False).alias("stamp_quoted"),
    )


def _typed(name: str) -> Column:
    text = F.col(f"payload.{name}")
    kind = FIELDS[name]
    if name == "timestamp":
        return parse_time(text, F.col("stamp_quoted"))
    if isinstance(kind, T.IntegerType):
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    value = text.try_cast(kind)
    # NaN compares above every number and would pass the range rules; neither it nor infinity is an amount.
    return F.when(F.abs(value) < float("inf"), value) if isinstance(kind, T.DoubleType) else value


def _field_errors(name: str) -> list[Column]:
    """Messages for one field; each is null when the rule holds."""
    given, value = F.col(f"payload.{name}"), F.col(TYPED + name)
    checks = []
    if name not in OPTIONAL:
        checks.append(F.when(given.isNull(), F.lit(f"{name}: field required")))
    if not isinstance(FIELDS[name], T.StringType):
        checks.append(F.when(given.isNotNull() & value.isNull(), F.lit(f"{name}: not a valid {FIELDS[name].simpleString()}")))
    if name in ABOVE_ZERO:
        checks.append(F.when(value <= 0, F.lit(f"{name}: must be greater than 0")))
    if name in FROM_ZERO:
        checks.append(F.when(value < 0, F.lit(f"{name}: must be at least 0")))
    if name in BETWEEN:
        low, high = BETWEEN[name]
        checks.append(F.when((value < low) | (value > high), F.lit(f"{name}: must be between {low} and {high}")))
    return checks


def _errors() -> Column:
    generic = [
        F.when(F.col("declared").isNull(), F.lit("event_type: field required")),
        F.when(
            F.col("sent_at").isNotNull() & F.col("t_sent").isNull(),
            F.lit("timestamp: not a valid timestamp"),
        ),
    ]
    choice = F.when(F.col("event_type") == "system", F.array(*generic))
    for kind, schema in LANDED_FIELDS.items():
        checks = [c for name in schema.names for c in _field_errors(name)]
        choice = choice.when(F.col("event_type") == kind, F.array(*checks))
    unknown = F.array(F.lit("event_type: unknown value"))
    return F.filter(choice.otherwise(unknown), lambda e: e.isNotNull())


def _own(name: str) -> Column:
    owners = [kind for kind, schema in PAYLOADS.items() if name in schema.names]
    return F.when(F.col("event_type").isin(owners), _typed(name))


def validate(events: DataFrame, as_of, counters: Observation | str | None = None) -> DataFrame:
    """Adds ``record`` (typed fields), ``event_timestamp`` and ``errors`` (empty when valid).

    The event time is the one sent, else the payload's, else ``as_of``; ``given_time`` is null in the last
    case. Fields that do not
    belong to the event's type are left out of the record. Counts of received, processed
    and failed rows are observed on the way; the observation also keeps a later filter on
    ``errors`` above the parsing, so that no row is parsed twice. ``counters`` receives the
    counts, or names them in a stream's progress.
    """
    counters = counters or f"ingest-{uuid.uuid4().hex}"
    given = F.coalesce("t_sent", F.col(TYPED + "timestamp"))
    ok = F.size("errors") == 0
    return (
        events.withColumns({TYPED + name: _own(name) for name in FIELDS} | {"t_sent": parse_time(F.col("sent_at"), F.col("sent_quoted"))})
        .withColumn("errors", _errors())
        .select(
            "event_type", "raw_data", "event", "errors",
            F.coalesce(given, instant(as_of)).alias("event_timestamp"),
            given.alias("given_time"),
            F.struct(*[F.col(TYPED + name).alias(name) for name in FIELDS]).alias("record"),
        )
        .observe(
            counters,
            F.count("*").alias("received"),
            F.count_if(ok).alias("processed"),
            F.count_if(~ok).alias("failed"),
        )
    )


def valid_rows(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0)


def invalid_rows(validated: DataFrame) -> DataFrame:
    """Quarantine rows: the event as it came and why it was refused."""
    came_as_text = dict(validated.dtypes)["event"] == "string"
    event = F.col("event") if came_as_text else F.to_json("event")  # only refused rows are serialised
    return validated.filter(F.size("errors") > 0).select(
        "event_type", event.alias("event"), F.array_join("errors", "; ").alias("error")
    )


def validation_stats(validated: DataFrame) -> DataFrame:
    """One row of totals; the rate is 0 for an empty input."""
    rate = F.try_divide(F.count_if(F.size("errors") == 0), F.count("*")) * 100
    return validated.agg(
        F.count("*").alias("total"),
        F.count_if(F.size("errors") == 0).alias("valid"),
        F.count_if(F.size("errors") > 0).alias("invalid"),
        F.coalesce(rate, F.lit(0.0)).alias("valid_rate"),
    )


def error_counts(validated: DataFrame) -> DataFrame:
    return validated.select("event_type", F.explode("errors").alias("error")).groupBy("event_type", "error").agg(
        F.count("*").alias("events")
    )


def require_valid(validated: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first refused row it meets."""
    message = F.concat(F.lit("invalid event: "), F.array_join("errors", "; "))
    checked = F.when(F.size("errors") > 0, F.raise_error(message).cast("array<string>")).otherwise(F.col("errors"))
    return validated.withColumn("errors", checked).filter(F.size("errors") == 0)


def event_id(kind: Column, when: Column, content: Column) -> Column:
    """Deterministic id: the same type, own time (null if none came) and content give the same id."""
    return F.concat(
        F.lit("evt_"), F.substring(F.md5(F.concat_ws("_", kind, when.cast("string"), content)), 1, 16)
    )


def domain_of(kind: Column) -> Column:
    pairs = [F.lit(x) for item in DOMAIN_OF_TYPE.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[kind], kind)


def enrich(valid: DataFrame, ingested_at) -> DataFrame:
    """Envelope (id, domain, times) with the typed record and its derived fields."""
    r = "record."
    sale, customer = F.col("event_type") == "sale", F.col("event_type") == "customer"
    stamp, weekday = F.col(f"{r}timestamp"), F.weekday(F.col(f"{r}timestamp"))
    score, nps = F.col(f"{r}satisfaction_score"), F.col(f"{r}nps_score")
    content = F.coalesce(F.col("raw_data"), F.to_json("record"))
    return valid.select(
        event_id(F.col("event_type"), F.col("given_time"), content).alias("event_id"),
        "event_type",
        domain_of(F.col("event_type")).alias("domain"),
        "event_timestamp",
        instant(ingested_at).alias("ingested_at"),
        F.when(sale, F.col(f"{r}revenue") * F.col(f"{r}quantity")).alias("total_value"),
        F.when(sale, F.hour(stamp)).alias("hour"),
        F.when(sale, weekday).alias("day_of_week"),
        F.when(sale, weekday >= 5).alias("is_weekend"),
        F.when(customer, F.when(score >= 4, "positive").when(score == 3, "neutral").when(score < 3, "negative"))
        .alias("sentiment"),
        F.when(customer, F.when(nps >= 9, "promoter").when(nps >= 7, "passive").when(nps < 7, "detractor"))
        .alias("nps_category"),
        "record",
    )


def silver(enriched: DataFrame, kind: str) -> DataFrame:
    """Flat typed table of one event type; a payload's own ``event_type`` becomes ``activity``."""
    own = [
        F.col(f"record.{name}").alias("activity" if name == "event_type" else name)
        for name in PAYLOADS[kind].names
    ]
    extra = {"sale": ["total_value", "hour", "day_of_week", "is_weekend"], "customer": ["sentiment", "nps_category"]}
    rows = enriched.filter(F.col("event_type") == kind)
    return rows.select("event_id", "domain", "event_timestamp", "ingested_at", *own, *extra.get(kind, []))


class BatchResult(NamedTuple):
    events: DataFrame
    invalid: DataFrame
    counts: Observation


def process_batch(events: DataFrame, as_of, landing: str | None = None) -> BatchResult:
    """Enriched rows, refused rows and counts; the counts fill when ``events`` or ``invalid`` first runs.

    With a ``landing`` folder the checked rows are written there once, and both frames read them instead of
    parsing the events each.
    """
    counts = Observation()
    checked = validate(events, as_of, counts)
    if landing:
        checked.write.mode("overwrite").parquet(landing)
        checked = events.sparkSession.read.schema(checked.schema).parquet(landing)
    return BatchResult(enrich(valid_rows(checked), as_of), invalid_rows(checked), counts)
