"""What an index build does per text and per token, against plainer forms of the same."""

import glob
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lossweave.functions import keywords, text as tx
from lossweave.operators import encode
from lossweave.operators.keyword import with_search_tokens
from lossweave.sources.store import ClaimStore

BLANKS = "\x00\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def plan_of(spark, column):
    return spark.range(1).select(F.col("id").cast("string").alias("t")).select(column.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_tokens_of_every_character(spark):
    def letters(batches):
        for batch in batches:
            found = [chr(c) for c in batch.column(0).to_pylist() if not 0xD800 <= c < 0xE000]
            yield pa.RecordBatch.from_arrays([pa.array([f"X{c}1 {c}{c}" for c in found])], names=["t"])

    texts = spark.range(0x110000).mapInArrow(letters, "t string")
    each = F.transform(F.regexp_extract_all(F.col("t"), F.lit(tx.SEARCH_TOKEN), 1), tx.fold)
    assert texts.where(~tx.search_tokens(F.col("t")).eqNullSafe(each)).count() == 0
    assert spark.createDataFrame([(None,)], "t string").select(tx.search_tokens(F.col("t"))).first()[0] == []

    def differs(batches):
        for batch in batches:
            same = keywords.token_lists(batch.column(0)).equals(batch.column(1).cast(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array([not same])], names=["d"])

    assert {r.d for r in texts.select("t", tx.search_tokens(F.col("t"))).mapInArrow(differs, "d boolean").collect()} == {False}
    assert "lambda" not in plan_of(spark, tx.search_tokens(F.col("t")))  # folded once, not token by token


def test_clean_text_of_all_blanks(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice(BLANKS + "  ab\xfc\u200b\x1b") for _ in range(draw.randrange(12))) for _ in range(4000)]
    texts += [f"a{x}b{y}c{x}" for x in BLANKS for y in BLANKS] + ["", " ", "  "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in rows.select("t", tx.clean_text(F.col("t"))).collect():
        assert got == " ".join(w for w in "".join(" " if c in BLANKS else c for c in t).split(" ") if w)


def test_lexical_vectors_are_those_of_spark_ml(spark):
    words = ["a", "bb", "äb", "abcd", "abcde", "straße", "x" * 70, "12", "möbel9"]
    draw = random.Random(2)
    rows = spark.createDataFrame([(i, " ".join(draw.choices(words, k=draw.randrange(30)))) for i in range(300)] + [(300, None), (301, "")], "claim_id int, document string")
    tokens = rows.select("claim_id", tx.search_tokens(F.col("document")).alias("w"))
    stages = [HashingTF(inputCol="w", outputCol="n", numFeatures=11), IDF(inputCol="n", outputCol="i"), Normalizer(inputCol="i", outputCol="v", p=2.0)]
    plain = Pipeline(stages=stages).fit(tokens).transform(tokens).select("claim_id", vector_to_array("v", "float32").alias("v"))
    for given in (rows, with_search_tokens(rows)):
        model = encode.fit_lexical_encoder(given, dimensions=11)
        got = encode.lexical_encode(given, model)
        assert got.join(plain, "claim_id").where(F.col("embedding") == F.col("v")).count() == 302
        assert got.schema["embedding"].dataType.simpleString() == "array<float>"


def test_hashed_counts_in_parts(monkeypatch):
    monkeypatch.setattr(keywords, "_COUNTS_AT_ONCE", 12)
    lists = [["a", "b", "a"], [], None, ["c"] * 40, ["a", None], ["b"] * 5]
    tokens = pa.array([["skipped"], *lists], pa.list_(pa.string())).slice(1)
    parts = list(keywords.hashed_counts(tokens, 4))
    assert len(parts) > 2 and sum(map(len, parts)) == len(lists)
    assert np.concatenate(parts).sum(axis=1).tolist() == [3, 0, 0, 40, 2, 5]


def test_token_lists_of_parts():
    texts = pa.array(["skipped", "", None, "Ab-\xe4", "\xc4b", "c", "", " \xdf ", "\xc3\xe9x"])
    want = [[], [], ["ab", "\xe4"], ["\xe4b"], ["c"], [], ["ss"], ["x"]]
    assert keywords.token_lists(texts.slice(1)).to_pylist() == want
    assert keywords.token_lists(texts.slice(1, 0)).to_pylist() == [] and keywords.token_lists(texts.slice(1, 2)).to_pylist() == [[], []]


def test_texts_and_vectors_are_stored_without_dictionaries(spark, tmp_path):
    store = ClaimStore(spark, str(tmp_path))
    row = ("1", "h", "text " * 9, "text " * 9, [1.0, 0.0], ["text"] * 9, 9)
    rows = spark.createDataFrame([row] * 50, "claim_id string, source_text_hash string, document string, claim_description string, embedding array<float>, search_tokens array<string>, search_token_count int")
    store.write_table("t", rows)
    store.write_texts("p", rows)
    files = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)
    assert len({f.split("/")[-3] for f in files}) == 2
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k).has_dictionary_page for k in range(group.num_columns)}
        assert not any(columns[c] for c in ("document", "claim_description", "embedding.list.element")) and columns["search_tokens.list.element"]
    assert store.read_table("t").count() == 50
