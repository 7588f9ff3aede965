import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossweave.functions.values import order_bits
from lossweave.operators import encode, ingest
from lossweave.operators.quantile import exact_quantile
from lossweave.plans.index_build import IndexSettings, build_index
from lossweave.schema import ColumnMap
from lossweave.sources import store as st

INF = math.inf
VALUES = [
    0.0, -0.0, 1.0, -1.0, 0.1, 0.30000000000000004, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-300,
    1.7976931348623157e308, -1.7976931348623157e308, INF, -INF, 1e25, 1e25 + 2**31, 8.0, math.nextafter(8, 0), math.nextafter(8, 9), 4503599627370497.5,
]


def test_order_bits_are_the_numbers_bits(spark):
    rng = np.random.default_rng(5)
    values = VALUES + rng.normal(size=300).tolist() + (2.0 ** rng.integers(-1074, 1023, 300).astype(float)).tolist()
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
    got = {repr(r.v): r.b for r in rows.select("v", order_bits(F.col("v")).alias("b")).collect()}
    for v in values:
        bits = int(np.array(abs(v)).view(np.int64))
        assert got[repr(v)] == (-bits if v < 0 else bits), v
    assert got["None"] is None and got["nan"] > got["inf"]


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.999, 1.0])
def test_quantiles_of_heavy_tails_ties_and_infinities(spark, q):
    rng = np.random.default_rng(3)
    values = {
        "tail": rng.pareto(0.05, 3000), "ties": np.repeat([1.5, -2.5, 7.0], [4000, 1, 30]), "close": 1 + np.arange(500) * 2.0**-52,
        "inf": np.array([-INF, -INF, 1.0, 2.0, INF, INF, INF]), "two": np.array([1.0, 2.0]), "sign": np.concatenate([-rng.random(50), [-0.0, 0.0], rng.random(50)]),
    }
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), (None, 3.0)]
    data = spark.createDataFrame(rows, "`a.k` string, v double").repartition(5)
    got = {r[0]: r[1] for r in exact_quantile(data, ["a.k"], F.col("v"), q, "m").collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        expected = np.sort(v)[[math.floor(q * (len(v) - 1)), math.ceil(q * (len(v) - 1))]]
        assert min(expected) <= got[k] <= max(expected)
        if np.isfinite(expected).all():
            rank = q * (len(v) - 1)
            assert got[k] == pytest.approx(expected[0] + (expected[1] - expected[0]) * (rank - math.floor(rank)), rel=1e-14, abs=1e-300)
    assert exact_quantile(data.where("false"), [], F.col("v"), q, "m").count() == 0


def test_histograms_stay_bounded(spark):
    """A round's window holds at most 2 ** 16 counts per group, however many different values there are."""
    data = spark.range(200_000).select((F.col("id") * 1e-9 + 1).alias("v"))
    assert exact_quantile(data, [], F.col("v"), 0.25, "m").first().m == pytest.approx(1 + 0.25 * 199_999e-9, rel=1e-15)


def test_dataset_hash_sees_every_bit(spark):
    schema = "claim_id string, document string, reserve_amount double"
    digest = lambda rows: ingest.dataset_hash(spark.createDataFrame(rows, schema)).first().dataset_hash
    seen = {digest([("1", "a", v)]) for v in (1.0, 1.00000001, 1e25, 1e25 + 2**31, INF, 5e-324, None, -1.0)}
    assert len(seen) == 8 and digest([("1", "a", 0.0)]) == digest([("1", "a", -0.0)])


def test_bucket_hashes_name_the_buckets_that_changed(spark):
    rows = [(f"c{i}", f"text {i}", float(i)) for i in range(300)]
    frame = lambda data: spark.createDataFrame(data, "claim_id string, document string, reserve_amount double").repartition(3)
    old = ingest.bucket_hashes(frame(rows), 32)
    new = ingest.bucket_hashes(frame([(i, t, v + (1e-8 if i == "c7" else 0)) for i, t, v in rows if i != "c9"] + [("x", "new", None)]), 32)
    bucket = {r.claim_id: r.b for r in frame([*rows, ("x", "", None)]).select("claim_id", F.pmod(F.xxhash64("claim_id"), F.lit(32)).alias("b")).collect()}
    assert {r.bucket for r in ingest.changed_buckets(old, new).collect()} == {bucket[i] for i in ("c7", "c9", "x")}
    assert ingest.changed_buckets(old, old).count() == 0
    assert sum(r.record_count for r in old.collect()) == 300


def test_one_per_id(spark):
    schema = "claim_id string, document string, source_text_hash string, country string"
    rows = [("1", "a", "h1", "x"), ("1", "b", "h9", "x"), ("1", "b", "h9", "y"), ("2", "c", None, "x"), ("2", "d", "h0", "x"), ("3", "e", None, None), (None, "f", "h", "x"), (None, "g", "i", "x")]
    got = {r.claim_id: r for r in ingest.one_per_id(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert len(got) == 4 and got["1"].source_text_hash == "h9" and got["2"].document == "d" and got["3"].document == "e" and got[None].document == "g"


def test_known_texts_are_not_encoded_again(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder():
        def run(texts):
            calls.add(len(texts))
            return [[float(len(t)), float(sum(t.encode()) % 97 + 1)] for t in texts]

        return run

    columns = ColumnMap.of({f: "" for f in ColumnMap().mapped() if f not in ("claim_id", "description", "reserve_amount")})
    rows = [(str(i), f"water leak number {i % 30}", float(i)) for i in range(80)]
    frame = lambda data: spark.createDataFrame(data, "claim_id string, claim_description string, reserve_amount double")
    embed = lambda df: encode.encode(df, "document", encoder)
    settings = IndexSettings(model_key="m", model_version="1")

    def build(store, data, version=settings, reuse=True):
        before = calls.value
        result = build_index(store, frame(data), embed, version, source_name="t", source_identity="t", columns=columns, reuse_vectors=reuse)
        return result, calls.value - before

    store = st.ClaimStore(spark, str(tmp_path / "a"))
    first, n = build(store, rows[:20])
    assert n == first.embedded == 20 and first.status == "rebuilt"
    more, n = build(store, rows)
    assert n == more.embedded == 10
    full, n = build(st.ClaimStore(spark, str(tmp_path / "b")), rows, reuse=False)
    assert n == 80 and full.embedded is None
    vectors = lambda path, r: sorted((x.claim_id, tuple(x.embedding)) for x in st.ClaimStore(spark, str(tmp_path / path)).read_table(r.collection_name).collect())
    assert vectors("a", more) == vectors("b", full) and more.collection_name == full.collection_name
    moved, n = build(store, [(i, t, v + 1e-8) for i, t, v in rows[:2]] + rows[2:] + rows[5:9])
    assert moved.status == "rebuilt" and n == moved.embedded == 0 and moved.manifest["record_count"] == 80
    other, n = build(store, rows, IndexSettings(model_key="m", model_version="2"))
    assert n == other.embedded == 30
