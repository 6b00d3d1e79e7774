"""Observed transactions: JSON lines and the record contract.

Records are refused, never coerced. JSON is held as VARIANT so that a number
in a text field is told apart from text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threatloom.functions.instants import is_iso_utc
from threatloom.functions.text import CONTROL_CHARS

# Field names, lengths and enumerations of the record contract.
TEXT_FIELDS = {"client_ref": 128, "observed_at": 64, "session_epoch": 64, "accept_language": 256, "accept_encoding": 256, "tls_ja4": 128}
ENUM_FIELDS = {
    "cache_behavior": ("validators_absent", "validators_present_correct", "validators_present_incorrect", "revalidation_ignored"),
    "range_fallback": ("range_honored", "range_ignored", "identity_fallback", "malformed_retry"),
}
LIST_FIELDS = ("header_order", "challenge_body_key_order")
FIELDS = (*TEXT_FIELDS, *ENUM_FIELDS, *LIST_FIELDS)


def json_type(json: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(json, f"$.{name}", "variant"))


def json_text(json: Column, name: str) -> Column:
    """The field when it is JSON text, else null."""
    return F.when(json_type(json, name) == "STRING", F.try_variant_get(json, f"$.{name}", "string"))


def contract_violations() -> Column:
    """Reasons to refuse the record held in the contract's own columns."""
    checks = [F.when(F.col(f).isNull(), F.lit(f"missing required field: {f}")) for f in ("client_ref", "observed_at")]
    for name, limit in TEXT_FIELDS.items():
        value = F.col(name)
        checks.append(F.when(~F.length(value).between(1, limit), F.lit(f"{name} must be 1..{limit} chars")))
        checks.append(F.when(value.rlike(CONTROL_CHARS), F.lit(f"{name} contains control characters")))
    checks.append(F.when(F.col("observed_at").isNotNull() & ~is_iso_utc(F.col("observed_at")), F.lit("observed_at must be ISO-8601 UTC")))
    for name, allowed in ENUM_FIELDS.items():
        checks.append(F.when(~F.col(name).isin(*allowed), F.lit(f"{name} must be one of {', '.join(allowed)}")))
    for name in LIST_FIELDS:
        items = F.col(name)
        bad = (F.size(items) > 64) | F.exists(items, lambda x: x.isNull() | ~F.length(x).between(1, 64)) \
            | (F.size(F.array_distinct(items)) != F.size(items))
        checks.append(F.when(items.isNotNull() & bad, F.lit(f"{name} must be a list of unique short strings (max 64)")))
    return F.array_compact(F.array(*checks))


def validated(records: DataFrame) -> DataFrame:
    """Add ``violations``; an empty array means accepted. Missing optional columns count as absent."""
    for name in FIELDS:
        if name not in records.columns:
            kind = "array<string>" if name in LIST_FIELDS else "string"
            records = records.withColumn(name, F.lit(None).cast(kind))
    return records.withColumn("violations", contract_violations())


def parse_transactions(lines: DataFrame) -> DataFrame:
    """JSON ``line`` to contract columns plus ``violations``; lines that mark a rejection are skipped."""
    json = F.col("_json")
    rows = lines.withColumn("_json", F.try_parse_json("line")).withColumn("_keys", F.json_object_keys("line")) \
        .where(~F.coalesce(F.array_contains("_keys", "rejected"), F.lit(False)))
    present = lambda f: F.coalesce(F.array_contains("_keys", f), F.lit(False))
    types = rows.withColumns({f"_t_{f}": json_type(json, f) for f in FIELDS})
    wrong = [F.when(F.col("_keys").isNull(), F.lit("record must be an object")),
             F.when(F.size(F.array_except("_keys", F.array(*[F.lit(f) for f in FIELDS]))) > 0, F.lit("unknown fields"))]
    wrong += [F.when(present(f) & (F.coalesce(F.col(f"_t_{f}"), F.lit("VOID")) != "STRING"), F.lit(f"{f} must be a string")) for f in (*TEXT_FIELDS, *ENUM_FIELDS)]
    wrong += [F.when(present(f) & ~F.coalesce(F.col(f"_t_{f}"), F.lit("VOID")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(f"{f} must be a list of unique short strings (max 64)"))
              for f in LIST_FIELDS]
    typed = types.withColumns({
        **{f: F.when(F.col(f"_t_{f}") == "STRING", F.try_variant_get(json, f"$.{f}", "string")) for f in (*TEXT_FIELDS, *ENUM_FIELDS)},
        **{f: F.when(F.col(f"_t_{f}").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(json, f"$.{f}", "array<string>")) for f in LIST_FIELDS},
        "_wrong": F.array_compact(F.array(*wrong))})
    return typed.withColumn("violations", F.array_union("_wrong", contract_violations())) \
        .drop("_json", "_keys", "_wrong", *[f"_t_{f}" for f in FIELDS])


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.size("violations") == 0).drop("violations")


def quarantined(records: DataFrame) -> DataFrame:
    return records.where(F.size("violations") > 0)
