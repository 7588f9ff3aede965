import hashlib

import pytest
from pyspark.sql import functions as F

from lossweave.operators import encode, ingest
from lossweave.plans.cluster_build import build_clusters
from lossweave.plans.index_build import IndexSettings, build_index
from lossweave.runtime import broadcast_if_small, is_small, pin_small, shared_dir
from lossweave.schema import ColumnMap
from lossweave.sources import exports as ex, reviews as rv, store as st

RECORDS = "claim_id string, document string, source_text_hash string, country string"


def test_upsert_keeps_one_row_per_id(spark):
    base = spark.createDataFrame([("1", "a", "h1", "DE"), ("2", "b", "h2", "DE")], RECORDS)
    new = spark.createDataFrame([("2", "c", "h3", "AT"), ("3", "d", "h4", "AT"), ("3", "d", "h4", "AT")], RECORDS)
    rows = sorted((r["claim_id"], r["document"], r["country"]) for r in st.upsert(base, new).collect())
    assert rows == [("1", "a", "DE"), ("2", "c", "AT"), ("3", "d", "AT")]


def test_patch_ignores_nulls(spark):
    base = spark.createDataFrame([("1", "a", "h1", "DE"), ("2", "b", "h2", "DE")], RECORDS)
    updates = spark.createDataFrame([("1", None, 4), ("2", "AT", None), ("9", "FR", 1)], "claim_id string, country string, cluster_id int")
    rows = {r["claim_id"]: (r["country"], r["cluster_id"]) for r in st.patch(base, updates).collect()}
    assert rows == {"1": ("DE", 4), "2": ("AT", None)}
    assert st.lookup(base, "2").first()["document"] == "b"
    twice = updates.unionByName(spark.createDataFrame([("1", "FR", 5), ("1", "IT", 6)], updates.schema))
    assert st.patch(base, twice).count() == 2


def test_index_versions_and_clusters(spark, tmp_path):
    store = st.ClaimStore(spark, str(tmp_path / "store"))
    columns = ColumnMap.of({f: "" for f in ColumnMap().mapped() if f not in ("claim_id", "description")})
    schema = "claim_id string, claim_description string"
    first = spark.createDataFrame([(str(i), f"water leak number {i}" if i % 2 else f"fire in hall {i}") for i in range(8)], schema)
    second = first.where("claim_id < '7'")
    settings = IndexSettings(model_key="lex-1", model_version="1")
    encoded = []

    def embed(rows):
        encoded.append(1)
        return encode.lexical_encode(rows, encode.fit_lexical_encoder(rows, dimensions=16))

    def build(source, **changes):
        return build_index(store, source, embed, IndexSettings(**{**vars(settings), **changes}), source_name="table", source_identity="t", columns=columns)

    with pytest.raises(RuntimeError):
        build_clusters(store, "lex-1")
    results = [build(first), build(first.repartition(3)), build(second), build(first)]
    assert [r.status for r in results] == ["rebuilt", "current", "rebuilt", "activated_existing"]
    assert [r.manifest["record_count"] for r in results] == [8, 8, 7, 8] and len(encoded) == 2
    assert results[0].collection_name == results[3].collection_name != results[2].collection_name
    assert results[0].manifest["diagnostics"]["indexed_rows"] == 8
    assert store.manifest("lex-1").first()["refresh_strategy"] == "activated_existing_index"
    assert store.manifest_log("lex-1").count() == 3 and store.manifest("other").count() == 0
    with pytest.raises(RuntimeError):
        build(first.where("false"))
    repeated = build(first.unionByName(first.limit(3)))
    assert repeated.status == "current" and repeated.manifest["record_count"] == 8
    assert "search_tokens" in store.read_table(repeated.collection_name).columns

    name = build_clusters(store, "lex-1", 2)
    assert store.read_table(name).where("cluster_id is not null").count() == 8
    clusters = store.clusters("lex-1").collect()
    assert sum(c["size"] for c in clusters) == 8 and clusters[0]["algorithm"] == "KMeans"
    assert store.cluster_map("lex-1").count() == 8
    assert "embedding" not in store.scan(name).columns
    assert build(second).status == "activated_existing"
    assert store.clusters("lex-1").count() == 0  # made for another index version


def _folder_bytes(path, below=""):
    return sum(f.stat().st_size for f in path.rglob("*.parquet") if below in str(f))


def test_versions_share_their_texts(spark, tmp_path):
    store = st.ClaimStore(spark, str(tmp_path / "store"))
    columns = ColumnMap.of({f: "" for f in ColumnMap().mapped() if f not in ("claim_id", "description", "reserve_amount")})
    schema = "claim_id string, claim_description string, reserve_amount double"
    words = [" ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(30)) for i in range(40)]
    frame = spark.createDataFrame([(str(i), f" {w}\n x ", float(i)) for i, w in enumerate(words)], schema)

    def embed(rows):
        assert set(rows.columns) <= {"source_text_hash", "document", "claim_description"}
        return rows.withColumn("embedding", F.array(F.length("document").cast("float"), F.lit(1.0).cast("float")))

    def build(source, key="m", reuse=True):
        settings = IndexSettings(model_key=key, model_version="1")
        return build_index(store, source, embed if reuse else lambda rows: rows.withColumn("embedding", F.array(F.length("document").cast("float"), F.lit(1.0).cast("float"))),
                           settings, source_name="t", source_identity="t", columns=columns, reuse_vectors=reuse)

    first = build(frame)
    one = _folder_bytes(tmp_path)
    moved = frame.withColumn("reserve_amount", F.col("reserve_amount") + 1)
    second = build(moved.unionByName(moved.limit(5)))
    assert (first.embedded, second.embedded) == (40, 0)
    assert _folder_bytes(tmp_path) < 1.3 * one  # another version of the same texts holds none of them again
    whole = build(moved, "w", reuse=False)
    shared, plain = store.read_table(second.collection_name), store.read_table(whole.collection_name)
    names = [c for c in plain.columns if c not in ("embedding_model",)]
    assert shared.columns == plain.columns
    assert sorted(shared.select(*names).collect()) == sorted(plain.select(*names).collect())
    # vectors of a version with whole rows are reused as well
    third = build(frame, "w")
    assert third.embedded == 0 and store.read_table(third.collection_name).count() == 40


def test_build_reads_texts_once_for_hash_and_counters(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    seen = seen.asNondeterministic()
    columns = ColumnMap.of({f: "" for f in ColumnMap().mapped() if f not in ("claim_id", "description")})
    rows = [(str(i), f"Water leak number {i % 7} in some hall of the town") for i in range(20)]
    rows += [("", "no id"), (None, None), ("x", " \n"), ("y", None), ("z", "WATER leak  number 1 in some hall of the town"), ("s", "ß")]
    source = spark.createDataFrame(rows, "claim_id string, claim_description string")
    keys = ingest.row_keys(ingest.prepare_records(source, columns))
    assert ingest.kept_counters(source, keys, columns).first() == ingest.quality_counters(source, columns).first()
    assert ingest.dataset_hash(keys).first() == ingest.dataset_hash(ingest.prepare_records(source, columns)).first()
    none = source.where("false")
    no_keys = ingest.row_keys(ingest.prepare_records(none, columns))
    assert ingest.kept_counters(none, no_keys, columns).first() == ingest.quality_counters(none, columns).first()

    store = st.ClaimStore(spark, str(tmp_path / "store"))
    settings = IndexSettings(model_key="m", model_version="1")
    slow = spark.createDataFrame(rows[:20], source.schema).withColumn("claim_description", seen("claim_description"))
    build = lambda: build_index(
        store, slow, lambda r: r.withColumn("embedding", F.array(F.lit(1.0))), settings, source_name="t", source_identity="t", columns=columns
    )
    assert build().status == "rebuilt"
    before = reads.value
    assert build().status == "current"
    assert reads.value - before <= 20  # a build that finds its version reads every text once


def test_reviews(spark, tmp_path):
    path = str(tmp_path / "reviews")
    assert rv.load_review_log(spark, path).collect() == []
    key = dict(model_key="m", cluster_version="v", cluster_id=1)
    rv.save_review(spark, path, **key, manual_label=" first ", review_status="accepted", notes="")
    rv.save_review(spark, path, **key, manual_label=" second ", review_status="too_mixed", notes=" n ")
    rv.save_review(spark, path, **{**key, "cluster_id": 2}, manual_label="", review_status="unreviewed", notes="")
    log = rv.load_review_log(spark, path)
    rows = {r["cluster_id"]: r for r in rv.current_reviews(log).collect()}
    assert len(rows) == 2 and rows[1]["manual_label"] == "second" and rows[1]["notes"] == "n"
    assert [r["manual_label"] for r in rv.review_history(log).collect()][1:] == ["second", "first"]
    assert rv.invalid_statuses(log).count() == 0
    with pytest.raises(ValueError):
        rv.save_review(spark, path, **key, manual_label="", review_status="bad", notes="")


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    path = str(tmp_path / "csv")
    rows = [("1", 'say "hi",\nthere', 0, 5.0), ("2", "other", 0, 9.0), ("3", "HI", 1, 1.0)]
    claims = spark.createDataFrame(rows, "claim_id string, document string, cluster_id int, reserve_amount double")
    ex.write_csv(ex.cluster_claims_export(claims, 0, "Hi", "largest"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    assert [(r["claim_id"], r["document"]) for r in back.collect()] == [("1", 'say "hi",\nthere')]


def test_size_checks(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("claim_id"))
    assert is_small(ids) and not is_small(ids, rows=99) and not is_small(ids, size=500)
    assert "broadcast" in broadcast_if_small(ids)._jdf.queryExecution().toString()
    pinned, small = pin_small(ids)
    assert small and sorted(pinned.collect()) == sorted(ids.collect()) and pin_small(pinned)[0] is pinned
    assert pin_small(ids, rows=10)[1] is False
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
