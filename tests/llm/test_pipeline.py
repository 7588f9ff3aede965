import random

import corpus_pipeline
import __spark_entry__
from pyspark.sql import functions as F

CLASHES = ("_did", "_tag", "_spans", "_leak", "_keep", "_again", "_nth", "row", "did", "a.b", "spans", "kept", "predicted", "component_id")


def test_stages_take_effect(spark, tmp_path):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(draw.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0 and i < 160
        rows.append((i, prose(90) + (" vileword nastyword vileword" if toxic else ""), "en", "s", None))
        labels.append((i, 1, int(toxic)))
    base = prose(300)
    rows += [(300, base, "en", "s", 1), (301, base, "en", "s", 1), (301, base, "en", "s", 1), (302, base.upper(), "en", "s", 1)]
    passage = "é".join(vocabulary[:120])
    rows += [(310, prose(80) + passage, "en", "s", 1), (311, passage + prose(80), "en", "s", 1), (312, "\ufffd" + prose(70) + "ß" + passage[1:], "en", "s", 1)]
    item = prose(40)
    rows += [(320, prose(60) + " " + item + " " + prose(60), "en", "s", 1), (330, None, None, None, None), (None, prose(50), "en", "s", 1)]
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in CLASHES}).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        path = f"{sf_dir}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        kept[f"{name} rows"] = docs.count()
    plain = {i for i in range(200) if not (i % 4 == 0 and i < 160)}
    assert plain | {300, 301, 302, 310, 311, 312, 320, 330, None} == set(kept["toxicity"])
    assert set(kept["toxicity"]) - {301, 302} == set(kept["simhash_near_dedup"])
    assert kept["simhash_near_dedup rows"] == len(kept["simhash_near_dedup"])
    after = kept["suffix_array_dedup"]
    assert passage in after[310] and len(after[311]) < 600 and passage[300:400] not in after[311] and after[330] is None
    assert after[312] == "\ufffd" + after[312][1:] and passage[300:400] not in after[312]
    assert set(after) == set(kept["simhash_near_dedup"])
    assert set(kept["benchmark_decontamination"]) == set(after) - {320}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(after) - {320}


def test_everything_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
