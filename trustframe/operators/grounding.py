"""Records taken from text, accepted only when every value is proven by a quote from its block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.entities import stated_values
from ..functions.text import normalize_digits, search_form
from ..session import materialize, spread

FIELD_NAME = r"^[A-Za-z؀-ۿ][\w؀-ۿ]{0,59}$"


def written_in_quote(value: Column, quote: Column, quote_form: Column) -> Column:
    """The value is in the quote as written or as the same number. NULL needs no proof."""
    wanted = search_form(value)
    as_text = (wanted != "") & F.contains(quote_form, wanted)
    digits = normalize_digits(value)
    target = F.when(digits.rlike(r"^-?[0-9.,]+(?:[eE][-+]?[0-9]+)?$"), F.replace(digits, F.lit(","), F.lit("")).try_cast("double"))
    numbers = F.regexp_extract_all(normalize_digits(quote), F.lit(r"\d[\d,٬]*(?:\.\d+)?"), F.lit(0))
    as_number = F.exists(numbers, lambda x: F.abs(F.regexp_replace(x, "[,٬]", "").try_cast("double") - target) < 1e-9)
    return F.when(value.isNull() | F.coalesce(as_text, F.lit(False)), True).otherwise(F.coalesce(as_number, F.lit(False)))


def check_fields(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """fields(record_no, field, value, block_id, quote) with `reason`: NULL where the field is proven.

    A value may also be a date or an amount that its quote writes differently; only values that are not in their quote
    as written are sent to the entity finder.
    """
    source = spread(blocks.select("block_id", "source_id", "text")).select("block_id", "source_id", search_form(F.col("text")).alias("block_form"))
    rows = spread(fields).withColumn("quote_form", search_form(F.col("quote"))).join(source, "block_id", "left")
    missing = F.coalesce(F.col("block_id"), F.lit("")).isin("") | F.coalesce(F.col("quote"), F.lit("")).isin("")
    plain = (F.when(~F.col("field").rlike(FIELD_NAME), "invalid field name")
             .when(missing, "missing source: every value needs a block and a quote")
             .when(F.col("block_form").isNull(), "no such block")
             .when(~F.contains(F.col("block_form"), F.col("quote_form")), "quote not found in that block"))
    kept = ["record_no", "field", "value", "block_id", "source_id", "quote"]
    written = written_in_quote(F.col("value"), F.col("quote"), F.col("quote_form"))
    rows = rows.select(*kept, plain.alias("reason"), F.when(plain.isNull(), written).otherwise(True).alias("written"))
    rows = rows.withColumn("stated", stated_values(F.when(~F.col("written"), F.col("quote"))))
    reason = F.when(F.col("reason").isNull() & ~F.col("written") & ~F.array_contains("stated", F.col("value")),
                    "value does not appear in the quote")
    return rows.select(*kept, F.coalesce("reason", reason).alias("reason"))


def accepted(checked: DataFrame) -> DataFrame:
    """Fields of records in which every field is proven. The checks are read twice, so they are made once and stored."""
    checked = materialize(checked, "checked-fields")
    bad = checked.filter("reason IS NOT NULL").select("record_no").distinct()
    return checked.filter("reason IS NULL").join(bad, "record_no", "left_anti")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NOT NULL").select("record_no", "field", "reason")


def as_records(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row per record with the named fields as columns."""
    return fields.groupBy("record_no").pivot("field", names).agg(F.first("value"))


def upsert(existing: DataFrame, fresh: DataFrame, key: str | None) -> DataFrame:
    """New records replace stored ones with the same key; new columns are added."""
    kept = existing
    if key and key in existing.columns and key in fresh.columns:
        kept = existing.join(fresh.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
