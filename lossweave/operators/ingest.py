"""Record preparation, ingest quality counters, duplicate handling and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lossweave.functions import text as tx, values as vl
from lossweave.runtime import write_once
from lossweave.schema import AMOUNT_FIELDS, METADATA_FIELDS, SHORT_DESCRIPTION_CHARS, ColumnMap
from lossweave.sources.claims import logical_claims

# Separator and null marker of the row digest. Cleaning turns both characters into spaces,
# so neither can occur inside a value.
_UNIT, _NULL = "\x1f", "\x1e"
_LIMB_HEX = 6
_LIMBS = 11


def has_required(claims: DataFrame) -> DataFrame:
    """Rows with an id and a description."""
    return claims.where(tx.has_text(F.col("claim_id")) & tx.has_text(F.col("description")))


def _metadata_value(name: str, data_type: T.DataType) -> Column:
    if name in AMOUNT_FIELDS:
        return vl.number(F.col(name))
    return vl.iso_text(F.col(name), data_type)


def prepare_records(
    source: DataFrame,
    columns: ColumnMap = ColumnMap(),
    carried: tuple[str, ...] = (),
    *,
    model_name: str = "",
    model_path: str = "",
    embedding_version: str = "",
) -> DataFrame:
    """Claims as index records: labelled document, clean description and typed metadata.

    A missing or blank value is a null column. ``carried`` columns of the source follow as they are. One projection over
    the source, no shuffle.
    """
    claims = logical_claims(source, columns, carried)
    types = {f.name: f.dataType for f in claims.schema.fields}
    mapped = columns.mapped()
    # Texts are cleaned in a step of their own: the steps after it reuse the result.
    kept = has_required(claims).select(
        tx.clean_text(F.col("claim_id")).alias("claim_id"),
        tx.clean_text(F.col("description")).alias("claim_description"),
        *[tx.clean_text(F.col(n)).alias(f"text_{n}") for n in tx.DOCUMENT_LABELS if n in mapped and n != "description"],
        *[
            _metadata_value(name, types[name]).alias(name)
            for name in claims.columns
            if name not in ("claim_id", "description", *carried)
        ],
        *carried,
        vl.loss_year(F.col("loss_date"), types["loss_date"]).alias("loss_year"),
    )
    parts = {n: F.col("claim_description" if n == "description" else f"text_{n}") for n in tx.DOCUMENT_LABELS if n in mapped}
    kept = kept.withColumn("document", tx.labelled_document(parts, cleaned=True))
    out = kept.select(
        "*",
        F.length("claim_description").alias("description_length"),
        *[
            F.nullif(F.lit(value), F.lit("")).alias(name)
            for name, value in (
                ("embedding_model", model_name),
                ("embedding_model_path", model_path),
                ("embedding_version", embedding_version),
            )
        ],
        tx.text_hash(F.col("document")).alias("source_text_hash"),
    )
    return out.select("claim_id", "document", "claim_description", *[n for n in METADATA_FIELDS if n != "claim_id"], *carried)


def quality_counters(source: DataFrame, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """One row of ingest counters. Distinct texts are counted by digest, so no text is shuffled."""
    claims = logical_claims(source, columns)
    parts = claims.select(
        tx.clean_text(F.col("claim_id")).alias("id"), tx.clean_text(F.col("description")).alias("text")
    )
    no_id = F.col("id") == ""
    no_text = ~no_id & (F.col("text") == "")
    kept = ~no_id & (F.col("text") != "")
    digest = F.when(kept, F.unhex(F.sha2(tx.fold(F.col("text")), 256)))
    return parts.agg(
        F.count("*").alias("source_rows"),
        F.count_if(kept).alias("indexed_rows"),
        F.count_if(no_text).alias("missing_descriptions"),
        F.count_if(kept & tx.is_short(F.col("text"))).alias("short_descriptions"),
        (F.count_if(kept) - F.count_distinct(digest)).alias("duplicate_descriptions"),
        F.count_if(no_id).alias("missing_claim_ids"),
    )


def kept_counters(source: DataFrame, keys: DataFrame, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """The row of ``quality_counters`` from the keys of the kept rows (``row_keys``): of the source only the rows
    without an id or a text are counted, and no text is cleaned again."""
    claims = logical_claims(source, columns)
    no_id = ~tx.has_text(F.col("claim_id"))
    no_text = ~no_id & ~tx.has_text(F.col("description"))
    size = F.col("description_length")
    kept = keys.agg(
        F.count("*").alias("indexed_rows"),
        F.count_if((size > 0) & (size < SHORT_DESCRIPTION_CHARS)).alias("short_descriptions"),
        (F.count("*") - F.count_distinct("folded")).alias("duplicate_descriptions"),
    )
    all_rows = claims.agg(
        F.count("*").alias("source_rows"),
        F.count_if(no_text).alias("missing_descriptions"),
        F.count_if(no_id).alias("missing_claim_ids"),
    )
    names = ("source_rows", "indexed_rows", "missing_descriptions", "short_descriptions", "duplicate_descriptions", "missing_claim_ids")
    return all_rows.crossJoin(kept).select(*names)


def _id_cuts(ids: DataFrame, key: str, parts: int) -> list[str]:
    """At most ``parts - 1`` ids that cut the key range, picked by smallest hash (a bounded driver list)."""
    picked = ids.select(key).orderBy(F.xxhash64(key), key).limit(parts - 1).collect()
    return sorted({row[0] for row in picked})


def duplicate_ordinals(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Position of each claim among those with the same folded description, in id order.

    Groups of copies are cut into ``parts`` id ranges (as many as shuffle partitions, unless given)
    that are numbered separately and then shifted by the sizes of the ranges before them: no task
    has to hold or sort one whole group.
    """
    parts = parts or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Never null, so that the join on it below adds no null filter that would hash every text again.
    digest = F.coalesce(F.sha2(tx.fold(F.col("claim_description")), 256), F.lit(""))
    base = records.select("claim_id", digest.alias("digest"))
    cuts = _id_cuts(base, "claim_id", parts)
    slot = F.size(F.filter(F.lit(cuts), lambda cut: cut <= F.col("claim_id"))) if cuts else F.lit(0)
    slotted = base.withColumn("slot", slot)
    place = F.row_number().over(Window.partitionBy("digest", "slot").orderBy("claim_id"))
    within = slotted.withColumn("within", place)
    sizes = within.groupBy("digest", "slot").agg(F.max("within").alias("size"))
    before = Window.partitionBy("digest").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("digest", "slot", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    ordinal = F.col("shift") + F.col("within")
    return within.join(shifts, ["digest", "slot"]).select(
        "claim_id", ordinal.alias("ordinal"), (ordinal > 1).alias("is_duplicate")
    )


def _digest_text(name: str, data_type: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = vl.order_bits(value.cast("double"))  # the exact number, whatever its size
    return F.coalesce(value.cast("string"), F.lit(_NULL))


def _row_sums(records: DataFrame, columns: list[str] | None) -> tuple[Column, list[Column], list[Column]]:
    """The digest of a row, the sums over rows of its limbs, and the text of what they are hashed as."""
    names = columns or [n for n in ("claim_id", "document", *METADATA_FIELDS[1:]) if n in records.columns]
    types = {f.name: f.dataType for f in records.schema.fields}
    row = F.sha2(F.concat_ws(_UNIT, *[_digest_text(n, types[n]) for n in names]), 256)
    limbs = [
        F.sum(F.conv(F.substring("h", 1 + i * _LIMB_HEX, _LIMB_HEX), 16, 10).cast("long")).alias(f"l{i}")
        for i in range(_LIMBS)
    ]
    return row, limbs, [F.coalesce(F.col(f"l{i}"), F.lit(0)).cast("string") for i in range(_LIMBS)]


def dataset_hash(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Digest of a record set that ignores row order and reacts to any change, also in row counts.

    Every row is hashed with SHA-256; the 256-bit row digests are added limb by limb (24 bits
    each, so a long holds the sum of 2^39 rows) and the sums are hashed. Sums are combined on
    the map side: each task sends one row. Amounts enter with all their bits. Keys (``row_keys``) hold the digests.
    """
    row, limbs, shown = _row_sums(records, columns)
    digests = records if columns is None and "row_digest" in records.columns else records.select(row.alias("row_digest"))
    sums = digests.select(F.col("row_digest").alias("h")).agg(F.count("*").alias("n"), *limbs)
    return sums.select(
        F.sha2(F.concat_ws(",", F.col("n").cast("string"), *shown), 256).alias("dataset_hash"),
        F.col("n").alias("record_count"),
    )


def bucket_hashes(records: DataFrame, buckets: int = 256, columns: list[str] | None = None) -> DataFrame:
    """(bucket, bucket_hash, record_count): the same digest for each bucket of claim ids, so that two versions of
    a table tell which of their buckets differ. Tasks send one row per bucket."""
    row, limbs, shown = _row_sums(records, columns)
    bucket = F.pmod(F.xxhash64("claim_id"), F.lit(buckets)).cast("int")
    sums = records.select(bucket.alias("bucket"), row.alias("h")).groupBy("bucket").agg(F.count("*").alias("n"), *limbs)
    text = F.concat_ws(",", F.col("n").cast("string"), *shown)
    return sums.select("bucket", F.sha2(text, 256).alias("bucket_hash"), F.col("n").alias("record_count"))


def changed_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Buckets whose content differs between two sets of bucket hashes, those of only one of them included."""
    before = old.select("bucket", F.col("bucket_hash").alias("before"))
    after = new.select("bucket", F.col("bucket_hash").alias("after"))
    return before.join(after, "bucket", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("bucket")


def index_hash(
    dataset: DataFrame,
    *,
    source: str,
    source_identity: str,
    selected_columns: list[str],
    model_key: str,
    model_fingerprint: str,
    embedding_version: str,
) -> DataFrame:
    """Digest of everything an index version depends on, from the one-row dataset hash."""
    payload = F.to_json(
        F.struct(
            F.lit(source).alias("source"),
            F.lit(source_identity).alias("source_identity"),
            F.array(*[F.lit(c) for c in selected_columns]).alias("selected_columns"),
            F.col("dataset_hash"),
            F.lit(model_key).alias("model_key"),
            F.lit(model_fingerprint).alias("model_fingerprint"),
            F.lit(embedding_version).alias("embedding_version"),
        )
    )
    return dataset.select("*", F.sha2(payload, 256).alias("index_hash"))


def _tie(records: DataFrame) -> Column:
    return F.bitwise_not(F.xxhash64(*[F.col(c) for c in sorted(records.columns)]))


def row_keys(records: DataFrame) -> DataFrame:
    """The records without their texts: with the digest of the row, that of the folded description and the hash
    that ``one_per_id`` settles ties by, so that what asks for these reads no text."""
    row = _row_sums(records, None)[0]
    folded = F.unhex(F.sha2(tx.fold(F.col("claim_description")), 256))
    kept = [c for c in records.columns if c not in ("document", "claim_description")]
    return records.select(*kept, row.alias("row_digest"), folded.alias("folded"), _tie(records).alias("tie"))


def one_per_id(records: DataFrame) -> DataFrame:
    """One row per claim id, the one with the greatest text hash; ties fall to a hash of the row. Only ids are
    shuffled to find the repeated ones, and of the records only those. Also takes keys (``row_keys``)."""
    again = records.groupBy("claim_id").agg(F.count("*").alias("n")).where("n > 1").select("claim_id")
    again = write_once(again, "repeated-ids")
    best = F.struct(F.col("source_text_hash"), F.col("tie") if "tie" in records.columns else _tie(records))
    row = F.struct(*[F.col(c) for c in records.columns])
    same = lambda other: records["claim_id"].eqNullSafe(other["claim_id"])
    many = records.join(again, same(again), "left_semi").groupBy("claim_id").agg(F.max_by(row, best).alias("row"))
    return records.join(again, same(again), "left_anti").unionByName(many.select("row.*"))
