import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lossweave.llm.packing import Encoder, first_fit, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_first_fit_matches_a_plain_scan():
    draw = random.Random(1)
    for count in (0, 1, 2, 7, 300):
        sizes = sorted((draw.randint(1, 100) for _ in range(count)), reverse=True)
        room, expected = [], []
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            if b == len(room):
                room.append(100)
            expected.append((b, 100 - room[b]))
            room[b] -= s
        assert list(zip(*first_fit(sizes, 100))) == expected


def test_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(PATH)
    texts = [
        "", " ", "a", "  two  spaces\n\n  and\tlines \n", "x<|endoftext|>y z", "don't we'll I'M", " nbsp   a b　",
        "\x1c\x1d a\x85b \x1f", "été naïve 12345 ½ ²", "日本語 テキスト。", "🙂🙃 emoji", "a" * 3000, "word " * 500, "\r\n\r\n x", "x" + " " * 70 + "y",
        "tab\t\t\tend\t", "'s 't 'x", "﻿bom ​zero", "x²3 ½a éα éа a\u0301b Éa×b÷c ß'll İı ŉ ǅ ɏɐ", "I'Ll we'Re 's's a's.'t", "a_b a1b2 <p>x</p>", "ªº µ ¬­®",
    ]
    draw = random.Random(5)
    alphabet = "ab É×÷²½ªº'sl.,_1٣ \n\t\x1c\x85\xa0\u2003日🙂\u0301αǅ<|>\u200d"
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    encoder = Encoder(PATH)
    for text in [*texts, " ".join(texts), *texts]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_every_character_and_long_runs():
    whole, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}, {c}{c}" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    texts += [c * 20_000 for c in (" ", "a", "é", "1", "!")] + ["\n" * 1_000_000 + "x"]
    assert encoder.ranked
    for text, expected in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == np.array(expected.ids, "<u4").tobytes(), text[:50]


def test_pack_keeps_every_id_once(spark):
    draw = random.Random(2)
    words = ["the", "of", "packing", "été", "zz9", "\n"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 3, 50, 400, 3000]))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (3, "again")], "doc_id long, text string")
    rows = pack(docs.withColumn("ids", docs.doc_id), PATH, 256, group_documents=20, keep_ids=True).collect()
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_document.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    tokenizer = Tokenizer.from_file(PATH)
    for k, text in enumerate(texts):
        if k == 3:
            continue
        parts = sorted(by_document[k], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        assert {r.doc_tokens for r in parts} == {len(ids)}
    assert len(by_document[None]) == 1
    assert pack(docs.limit(0), PATH).count() == 0
