import pytest
from pyspark.sql import functions as F

from lossweave.functions import text as tx, values as vl
from lossweave.functions.vectors import unit_vector
from lossweave.operators import ingest
from lossweave.schema import ColumnMap
from lossweave.sources.claims import logical_claims, mapped_scan, sample_rows

DOCUMENT = "\n".join(
    [
        "Claim description: A falling tree crushed the garden shed.",
        "Line of business: Property",
        "Claim type: Water Damage",
        "Cause of loss: Pipe Leakage",
        "Damaged object: Warehouse inventory",
        "Country: DE",
    ]
)


def values(spark, text, *columns):
    rows = spark.createDataFrame([(t,) for t in text], "t string")
    return [tuple(r) if len(columns) > 1 else r[0] for r in rows.select(*columns).collect()]


def test_clean_text_matches_python_whitespace(spark):
    blanks = "".join(chr(c) for c in range(0x3100) if chr(c).isspace()) + "\x00"
    text = ["  Wasser\n\nschaden\t in   Halle  ", None, blanks, f"a{blanks}b", " ".join(f"x{c}y" for c in blanks), "a​b"]
    got = values(spark, text, tx.clean_text(F.col("t")), tx.has_text(F.col("t")))
    want = [" ".join((t or "").replace("\x00", " ").split()) for t in text]
    assert [g[0] for g in got] == want
    assert [g[1] for g in got] == [bool(w) for w in want]


def test_tokens(spark):
    got = values(spark, ["Sturmböen deckten Dächer ab.", "naïve STRAßE \u0130\u212a 12a"], tx.search_tokens(F.col("t")))
    assert got == [["sturmböen", "deckten", "dächer", "ab"], ["na", "ve", "strasse", "12a"]]
    words = values(spark, ["Water damage and leakage in the Warehouse, built-in x1 Straße"], tx.keyword_tokens(F.col("t")))
    assert words == [["water", "leakage", "warehouse", "built-in", "strasse"]]


def test_document_parser(spark):
    texts = [DOCUMENT, "plain text", "claim TYPE: a Country: X Claim type: b", "xCountry: y", None, "Claim type: only"]
    col = F.col("t")
    got = values(
        spark, texts, tx.document_fields(col), tx.keyword_text(col), tx.document_description(col), tx.display_description(col)
    )
    assert got[0][0] == {
        "Claim description": "A falling tree crushed the garden shed.",
        "Line of business": "Property",
        "Claim type": "Water Damage",
        "Cause of loss": "Pipe Leakage",
        "Damaged object": "Warehouse inventory",
        "Country": "DE",
    }
    assert got[0][1] == "A falling tree crushed the garden shed. Water Damage Pipe Leakage Warehouse inventory"
    assert got[0][2] == got[0][3] == "A falling tree crushed the garden shed."
    assert got[1] == ({}, "plain text", "plain text", "plain text")
    assert got[2][0] == {"Claim type": "b", "Country": "X"}
    assert got[2][1] == " b  "
    assert got[3][0] == {"Country": "y"}
    assert got[4] == ({}, "", "", "")
    assert got[5][2] == "Claim type: only"


def test_title_case(spark):
    assert values(spark, ["water / built-in leakage / o"], tx.title_case(F.col("t"))) == ["Water / Built-In Leakage / O"]


def test_values(spark):
    col = F.col("t")
    got = values(spark, ["50000", "50000.01", "250000", "1e6", "x", None], vl.reserve_bucket(col))
    assert got == ["<=50k", "50k-100k", "100k-250k", ">250k", "Unknown", "Unknown"]
    assert values(spark, ["2024-03-10", "soon", None, "10.03.2023", "2022-01-05T10:00:00"], vl.loss_year(col)) == [
        2024, None, None, 2023, 2022,
    ]
    assert values(spark, ["1234567.5", " a  b "], vl.amount_text(col)) == ["1,234,568", "a b"]
    assert values(spark, ["2024.0", "n/a"], vl.year_text(col)) == ["2024", "n/a"]
    assert values(spark, ["0.25"], vl.similarity(col.cast("double"))) == [0.75]
    number = F.col("t").cast("double")
    items = values(spark, ["0.879"], vl.score_items(number, number, F.lit(1.0), F.lit(None).cast("double"), F.lit(0.121)))
    assert [tuple(i) for i in items[0]] == [
        ("Semantic similarity", "0.879"), ("BM25 normalized", "1.000"), ("Distance", "0.121"),
    ]
    version = vl.cluster_version(F.lit("m"), col, F.lit(None).cast("string"), F.lit(" "))
    assert values(spark, ["KMeans"], version) == ["m|KMeans|unknown|unknown"]


def test_unit_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in rows.select(unit_vector(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


FULL = {
    "claim_id": "CLM-1", "claim_description": "Pipe  leak in building.", "line_of_business": "Property", "claim_type": "Water",
    "cause_of_loss": "Pipe", "damaged_object": "Floor", "country": "DE", "claim_status": "Open", "loss_date": "2024-03-10",
    "reserve_amount": 0.0, "paid_amount": float("nan"), "currency": "EUR", "policy_type": " ",
}


def test_prepare_records(spark):
    source = spark.createDataFrame([tuple(FULL.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in FULL.items()))
    row = ingest.prepare_records(source, model_name="m", embedding_version="v").first().asDict()
    assert row["document"] == (
        "Claim description: Pipe leak in building.\nLine of business: Property\nClaim type: Water\n"
        "Cause of loss: Pipe\nDamaged object: Floor\nCountry: DE"
    )
    assert row["loss_year"] == 2024 and row["reserve_amount"] == 0.0 and row["paid_amount"] is None
    assert row["policy_type"] is None and row["embedding_model_path"] is None and row["embedding_model"] == "m"
    assert row["description_length"] == len("Pipe leak in building.")


def test_only_required_columns(spark):
    source = spark.createDataFrame([("1", "Pipe leak in building.")], "claim_id string, claim_description string")
    columns = ColumnMap.of({f: "" for f in ColumnMap().mapped() if f not in ("claim_id", "description")})
    row = ingest.prepare_records(source, columns).first()
    assert row["document"] == "Claim description: Pipe leak in building."
    assert row["line_of_business"] is None
    assert columns.selected() == ["claim_id", "claim_description"] == mapped_scan(source, columns).columns
    assert logical_claims(source, columns).schema["reserve_amount"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        logical_claims(source, ColumnMap.of({"claim_id": " "}))


def test_quality_counters_and_duplicates(spark):
    rows = [("1", "Fire"), ("2", " FIRE "), ("3", None), (None, "Water leak in the whole cellar"), (" ", "")]
    source = spark.createDataFrame(rows, "claim_id string, claim_description string")
    columns = ColumnMap.of({f: "" for f in ColumnMap().mapped() if f not in ("claim_id", "description")})
    got = ingest.quality_counters(source, columns).first().asDict()
    assert got == {
        "source_rows": 5, "indexed_rows": 2, "missing_descriptions": 1, "short_descriptions": 2,
        "duplicate_descriptions": 1, "missing_claim_ids": 2,
    }


def test_duplicate_ordinals_in_a_hot_group(spark):
    rows = [(f"c{i:04d}", "Straße" if i % 3 else "other") for i in range(600)]
    records = spark.createDataFrame(rows, "claim_id string, claim_description string")
    got = {r["claim_id"]: r["ordinal"] for r in ingest.duplicate_ordinals(records, parts=7).collect()}
    for text in ("Straße", "other"):
        members = sorted(i for i, t in rows if t == text)
        assert [got[m] for m in members] == list(range(1, len(members) + 1))


def test_dataset_hash(spark):
    schema = "claim_id string, document string, reserve_amount double"
    rows = [("1", "a", 1.0), ("2", "b", None), ("2", "b", None)]
    def digest(data, parts=1):
        return ingest.dataset_hash(spark.createDataFrame(data, schema).repartition(parts)).first()["dataset_hash"]
    base = digest(rows)
    assert base == digest(rows[::-1], 3)
    assert base != digest(rows[:2]) and base != digest(rows + rows[1:2])
    assert base != digest([("1", "a", 1.01), *rows[1:]]) and base != digest([("1", "b", 1.0), *rows[1:]])


def test_large_samples_equal_small_ones(spark, monkeypatch):
    ids = spark.range(3000).select(F.col("id").cast("string").alias("claim_id"))
    small = sorted(r[0] for r in sample_rows(ids, 700).collect())
    monkeypatch.setattr("lossweave.sources.claims.EDGE_ROWS", 10)
    assert sorted(r[0] for r in sample_rows(ids, 700).collect()) == small
    assert sample_rows(ids, 5000).count() == 3000


def test_sample_rows(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("claim_id"))
    first = [r[0] for r in sample_rows(ids, 10).collect()]
    assert first == [r[0] for r in sample_rows(ids.repartition(7), 10).collect()] and len(first) == 10
    assert sample_rows(ids, None).count() == 100
    with pytest.raises(ValueError):
        sample_rows(ids, 0)
