"""Scalar normalisation, buckets, captions and number rendering as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from lossweave.functions.text import clean_or_null, clean_text

# Right-closed reserve buckets as (upper bound, label).
RESERVE_BUCKETS = ((50_000, "<=50k"), (100_000, "50k-100k"), (250_000, "100k-250k"))
RESERVE_TOP_BUCKET = ">250k"
UNKNOWN = "Unknown"

# Labels of the score breakdown.
SCORE_LABELS = {
    "semantic": "Semantic similarity",
    "bm25": "BM25 normalized",
    "rerank": "Rerank",
    "distance": "Distance",
}

# Date forms tried after the ISO form.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")


def number(value: Column) -> Column:
    """Numeric value or null; NaN counts as missing."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


_FRACTION = 1 << 52


def order_bits(value: Column) -> Column:
    """All bits of a double as a long that sorts like the number: equal numbers (and both zeros) give equal
    longs, others different ones; NaN comes last. Scaling by powers of two is exact, so no digit is lost."""
    size = F.abs(value)
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    part = size / F.pow(F.lit(2.0), guess)
    # the logarithm may be off by one next to a power of two
    power = F.greatest(F.least(guess + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0), F.lit(1023)), F.lit(-1022))
    part = size / F.pow(F.lit(2.0), power)
    bits = (power + 1022) * F.lit(_FRACTION) + (part * float(_FRACTION)).cast("long")
    bits = F.when(size == 0, 0).when(size == float("inf"), 2047 * _FRACTION).otherwise(bits)
    return F.when(F.isnan(value), 2047 * _FRACTION + 1).when(value < 0, -bits).otherwise(bits).cast("long")


def order_bits_sql(x: str) -> str:
    """The same for finite numbers in SQL."""
    guess = f"greatest(least(CAST(floor(log2(abs({x}))) AS BIGINT), 1023), -1022)"
    part = f"(abs({x}) / pow(2.0, {guess}))"
    power = f"greatest(least({guess} + CASE WHEN {part} >= 2 THEN 1 WHEN {part} < 1 THEN -1 ELSE 0 END, 1023), -1022)"
    bits = f"(({power} + 1022) * {_FRACTION} + CAST(abs({x}) / pow(2.0, {power}) * {_FRACTION} AS BIGINT))"
    return f"CASE WHEN {x} = 0 THEN 0 WHEN {x} < 0 THEN -{bits} WHEN {x} > 0 THEN {bits} END"


def amount(value: Column) -> Column:
    """Numeric value with missing as zero, as the roll-ups count it."""
    return F.coalesce(number(value), F.lit(0.0))


def iso_text(value: Column, data_type: T.DataType) -> Column:
    """Dates and timestamps in ISO form, numbers and booleans as they print, other values as clean text."""
    if isinstance(data_type, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value.cast("string"))
    return clean_or_null(value)


def loss_year(value: Column, data_type: T.DataType = T.StringType(), formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Year of a date in text or date form, null when it does not parse."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(value)
    text = clean_text(value)
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    return F.year(F.coalesce(*tries))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance)


def reserve_bucket(value: Column) -> Column:
    v = number(value)
    bucket = F.when(v.isNull(), UNKNOWN)
    for upper, label in RESERVE_BUCKETS:
        bucket = bucket.when(v <= upper, label)
    return bucket.otherwise(RESERVE_TOP_BUCKET)


def display_label(manual: Column, automatic: Column, cluster_id: Column) -> Column:
    return F.coalesce(clean_or_null(manual), clean_or_null(automatic), F.concat(F.lit("Cluster "), cluster_id.cast("string")))


def cluster_version(model_key: Column, algorithm: Column, n_clusters: Column, created: Column) -> Column:
    parts = [F.coalesce(clean_or_null(c), F.lit("unknown")) for c in (algorithm, n_clusters, created)]
    return F.concat_ws("|", model_key, *parts)


def claim_caption(claim_id: Column, details: Iterable[Column]) -> Column:
    return F.concat_ws(" - ", clean_text(claim_id), F.nullif(F.concat_ws(" | ", *[clean_or_null(d) for d in details]), F.lit("")))


def snippet(text: Column, size: int = 140) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def selected_flag(cluster_id: Column, selected: int) -> Column:
    return F.when(cluster_id == selected, "Selected cluster").otherwise("Other clusters")


def score_text(value: Column) -> Column:
    return F.format_string("%.3f", F.coalesce(value.try_cast("double"), F.lit(0.0)))


def amount_text(value: Column) -> Column:
    """Thousands-separated whole amount; text that is no number stays as it is."""
    return F.coalesce(F.format_number(number(value), 0), clean_text(value))


def year_text(value: Column) -> Column:
    return F.coalesce(number(value).cast("int").cast("string"), clean_text(value))


def score_items(semantic: Column, similar: Column, bm25: Column, rerank: Column, distance: Column) -> Column:
    """Labelled scores worth showing for a hit."""

    def item(key: str, value: Column, shown: Column) -> Column:
        return F.when(shown, F.struct(F.lit(SCORE_LABELS[key]).alias("label"), score_text(value).alias("value")))

    meaning = F.when(semantic > 0, semantic).when(similar > 0, similar)
    return F.array_compact(
        F.array(
            item("semantic", meaning, meaning.isNotNull()),
            item("bm25", bm25, bm25 > 0),
            item("rerank", rerank, rerank.isNotNull()),
            item("distance", distance, distance.isNotNull()),
        )
    )
