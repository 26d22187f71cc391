"""Record validation as Column expressions: per-field errors, valid/invalid split.

Each rule is a (field, failed-predicate, message) triple; the errors column is
``filter(array(when(failed, struct(field, message))...), notNull)``, computed
row-locally (no shuffle) and split with two filters on ``size(errors) = 0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txguard.schemas import FLAG_FIELDS, REVIEW_STATUSES


def _num_rule(field, lo=None, hi=None, positive=False, lo_msg=None, hi_msg=None):
    c = F.col(field)
    rules = [(field, c.isNull() | F.isnan(c), "Expected number, received " + "null")]
    ok = c.isNotNull() & ~F.isnan(c)
    if positive:
        rules.append((field, ok & (c <= 0), lo_msg or "Number must be greater than 0"))
    if lo is not None:
        rules.append((field, ok & (c < lo), lo_msg or f"Number must be greater than or equal to {lo}"))
    if hi is not None:
        rules.append((field, ok & (c > hi), hi_msg or f"Number must be less than or equal to {hi}"))
    return rules


def ingress_rules() -> list[tuple[str, Column, str]]:
    u = F.col("userId")
    rules = [("userId", u.isNull(), "Required"),
             ("userId", u.isNotNull() & (F.length(u) < 1), "userId is required")]
    rules += _num_rule("amount", positive=True, lo_msg="Amount must be positive")
    rules += _num_rule("lat", -90, 90)
    rules += _num_rule("lon", -180, 180)
    rules += _num_rule("distance_from_home", 0)
    for f in FLAG_FIELDS:
        rules += _num_rule(f, 0, 1)
    return rules


def json_kind(payload: Column, field: str) -> Column:
    """Type of a JSON member: number, string, boolean, null, object, array; undefined when absent."""
    t = F.schema_of_variant(F.try_variant_get(payload, f"$.{field}", "variant"))
    return (F.when(t.isNull(), "undefined").when(t == "VOID", "null").when(t.rlike(NUMERIC_TYPE), "number")
            .when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "array")
            .otherwise("object"))


def request_errors(payload: Column) -> Column:
    """Errors of a JSON request: strict types first, then the ingress rules on members of the right type."""
    items = []
    checks = {"userId": [(lambda c: F.length(c) < 1, "userId is required")],
              "amount": [(lambda c: c <= 0, "Amount must be positive")],
              "lat": _between(-90, 90), "lon": _between(-180, 180), "distance_from_home": _between(0, None)}
    checks.update({f: _between(0, 1) for f in FLAG_FIELDS})
    for field, rules in checks.items():
        want = "string" if field == "userId" else "number"
        kind = json_kind(payload, field)
        value = F.try_variant_get(payload, f"$.{field}", "string" if field == "userId" else "double")
        message = F.when(kind == "undefined", "Required").when(
            kind != want, F.concat(F.lit(f"Expected {want}, received "), kind))
        for failed, text in rules:
            message = message.when(failed(value), text)
        items.append(F.when(message.isNotNull(), F.struct(F.lit(field).alias("field"), message.alias("message"))))
    fields = F.filter(F.array(*items), lambda e: e.isNotNull())

    def whole(text: str) -> Column:
        return F.array(F.struct(F.lit("").alias("field"), F.lit(text).alias("message")))

    return (F.when(payload.isNull(), whole(MALFORMED))
            .when(~F.schema_of_variant(payload).startswith("OBJECT"), whole("Expected object"))
            .otherwise(fields))


def _between(lo, hi):
    rules = [(lambda c: c < lo, f"Number must be greater than or equal to {lo}")]
    return rules + ([(lambda c: c > hi, f"Number must be less than or equal to {hi}")] if hi is not None else [])


def errors_column(rules) -> Column:
    t = F.struct(F.lit("").alias("field"), F.lit("").alias("message"))
    items = [F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, bad, m in rules]
    return F.filter(F.array(*items), lambda e: e.isNotNull()) if items else F.array().cast(F.ArrayType(t.dataType))


INGRESS_COLUMNS = ["userId", "amount", "lat", "lon", "distance_from_home"] + FLAG_FIELDS


def validate_ingress(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows with only the schema columns, rejected rows with ``errors``)."""
    keep = keep or []
    checked = df.withColumn("errors", errors_column(ingress_rules()))
    valid = checked.filter(F.size("errors") == 0).select(*keep, *INGRESS_COLUMNS)
    invalid = checked.filter(F.size("errors") > 0)
    return valid, invalid


def review_rules(status_col: str = "new_status", id_col: str = "_id"):
    s, i = F.col(status_col), F.col(id_col)
    return [("newStatus", s.isNull() | ~s.isin(*REVIEW_STATUSES), "Status must be CLEARED or BLOCKED"),
            ("ids", i.isNull() | (F.length(i) < 1), "String must contain at least 1 character(s)")]


def validate_review(df: DataFrame, status_col: str = "new_status", id_col: str = "_id") -> DataFrame:
    return df.withColumn("errors", errors_column(review_rules(status_col, id_col))) \
             .withColumn("valid", F.size("errors") == 0)


def threshold_valid(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & ~F.isnan(c) & c.between(0, 1)


# ---------------------------------------------------------------- messages --

STRING_FIELDS = ["_id", "userId"]
NUMBER_FIELDS = ["amount", "lat", "lon", "distance_from_home"] + FLAG_FIELDS
NUMERIC_TYPE = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"
MALFORMED = "Malformed JSON"
SCHEMA_FAILED = "Schema validation failed"


def event_time(payload: Column) -> Column:
    """``timestamp`` of a message: ISO text or epoch milliseconds; NULL when absent or unreadable."""
    text = F.try_variant_get(payload, "$.timestamp", "string")
    epoch = F.try_variant_get(payload, "$.timestamp", "double")
    number = F.schema_of_variant(F.try_variant_get(payload, "$.timestamp", "variant")).rlike(NUMERIC_TYPE)
    # beyond these the instant does not fit a timestamp
    in_range = F.abs(epoch) <= 8.64e15
    return F.when(number, F.when(in_range, F.timestamp_millis(epoch.cast("bigint")))).otherwise(F.try_to_timestamp(text))


def validate_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Strict type check of JSON messages; extra keys are kept (``payload``).

    Adds ``valid``, ``error_message`` (NULL when valid), ``retry_count``
    (schema failures go straight to the DLQ with 0; unparsable text is what the
    retry loop would exhaust, so it carries the retry limit) and the typed
    fields.  Uses VARIANT parsing: from_json would coerce a numeric userId
    into a string.

    The text is parsed once into ``payload`` (its own projection: it is
    referenced by every check, and common-subexpression elimination does not
    hoist work out of AND / CASE branches, so inlining would re-parse per use).
    """
    from txguard.schemas import MAX_RETRIES
    out = df.withColumn("payload", F.try_parse_json(value))
    p = F.col("payload")
    types = {f"_t_{f}": F.schema_of_variant(F.try_variant_get(p, f"$.{f}", "variant"))
             for f in STRING_FIELDS + NUMBER_FIELDS}
    types["_t_root"] = F.schema_of_variant(p)
    out = out.withColumns(types)
    ok = F.col("_t_root").startswith("OBJECT")
    for f in STRING_FIELDS:
        ok = ok & (F.col(f"_t_{f}") == "STRING")
    for f in NUMBER_FIELDS:
        ok = ok & F.col(f"_t_{f}").rlike(NUMERIC_TYPE)
    parsed = p.isNotNull()
    out = out.withColumn("valid", parsed & F.coalesce(ok, F.lit(False))).drop(*types)
    # later filters on ``valid`` must not be pushed below the parse (plans.fence)
    from txguard.plans.fence import fence
    out = fence(out, ["payload", "valid"])
    typed = {f: F.try_variant_get(p, f"$.{f}", "string") for f in STRING_FIELDS}
    typed.update({f: F.try_variant_get(p, f"$.{f}", "double") for f in NUMBER_FIELDS})
    typed["timestamp"] = event_time(p)
    out = out.withColumns({
        "error_message": F.when(~parsed, F.lit(MALFORMED)).when(~F.col("valid"), F.lit(SCHEMA_FAILED)),
        "retry_count": F.when(~parsed, F.lit(MAX_RETRIES)).otherwise(F.lit(0)),
    })
    return out.withColumns({k: F.when(F.col("valid"), c) for k, c in typed.items()})
