import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lossweave.llm.chat import BEGIN, END, perspectives, perspectives_sql

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "Be kind."), (1, 2, "bob", "Hi <|im_end|> x"), (1, 1, "amy", "Ça va?"), (1, 3, "amy", None),
    (2, 0, "amy", "alone"), (2, 0, "amy", "alone"), (2, None, None, "first"), (3, 0, "system", "nobody"),
    (None, 0, "x", "lost"), (None, 1, "y", "found"), (4, 5, "a", ""), (4, 5, "b", "t"), (4, 5, "a", None),
    *((5, k, "ab"[k % 2], f"m{k}") for k in range(23)),
]


def text_mask(df):
    return df.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ","))


def test_against_sql(spark):
    got = {tuple(r) for r in text_mask(perspectives(spark.createDataFrame(ROWS, SCHEMA).repartition(5).withColumn("part", F.lit("z")), 7)).collect()}
    columns = list(zip(*ROWS))
    conversations = pa.table({n: pa.array(c, t) for n, c, t in zip(("conv_id", "turn", "role", "text"), columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))})
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert got == set(con.execute(perspectives_sql(7)).fetchall())
    assert {r[2] for r in got if r[0] == 5} == {0, 1, 2, 3}


def test_mask_covers_what_the_speaker_wrote(spark):
    rows = perspectives(spark.createDataFrame(ROWS, SCHEMA)).collect()
    one = next(r for r in rows if r.conv_id == 1 and r.perspective == "amy")
    assert [one.rendered[s.start : s.stop] for s in one.mask] == [f"Ça va?{END}", END]
    assert f"{BEGIN}user name=bob\nHi <| im_end|> x{END}\n" in one.rendered and one.rendered.startswith(f"{BEGIN}system\nBe kind.")
    assert not [r for r in rows if r.conv_id == 3]
    assert perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
