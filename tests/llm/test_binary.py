import random
import struct
import types
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stratalog.llm import binary

PATH = public_tokenizers.path("word_bpe_49k.json")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType())])
TEXTS = [
    "Hello, World! it's 3.5 times WE'LL see",
    None,
    "",
    "   \n\t ",
    "Été — naïve ÇA œuvre e\u0301 Straße İstanbul ΣΑΣ",
    "日本語 text с кириллицей ½ ²³ 🙂 a\u00a0b\u2003c\x1cd\x0be",
    "<|endoftext|> and <|startoftext|>",
    "x" * 300 + " " + "don't can't I'd I've o'clock's" * 50,
    "word " * 60_000,
    "a_b-c ''s 's 'st ... ###!!! 12345",
]


def test_crc32c_known_values_and_bit_by_bit():
    assert binary.crc32c([b"123456789", b"", b"\x00" * 32, b"\xff" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA, 0x62A8AB43]
    rng = random.Random(1)
    pieces = [rng.randbytes(n) for n in (1, 7, 8, 9, 1023, 1024, 1025, 3000, 5000, 70_001)]

    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert binary.crc32c(pieces).tolist() == [slow(p) for p in pieces]


def test_ids_are_the_tokenizers_own():
    coder, plain = binary.Encoder(open(PATH, encoding="utf-8").read(), memo=50), Tokenizer.from_file(PATH)
    assert coder.by_word and not coder.wide
    for t in TEXTS:
        assert coder.ids(t) == plain.encode(t or "", add_special_tokens=False).ids, t


def test_round_trip_through_files(spark, tmp_path):
    plain = Tokenizer.from_file(PATH)
    rows = [(7 * i % 97, t, "clash") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", None), (5, TEXTS[0], None), (5, TEXTS[0], None)]
    docs, path = spark.createDataFrame(rows, DOC), str(tmp_path / "records")
    written = binary.write_records(docs, path, PATH, parts=3)
    got = binary.read_records(written, path, wide=False, chunk=1000).orderBy("part", "record").collect()
    want = sorted(((d is not None, d or 0, t is not None, t or ""), d, plain.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows)
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(d, ids) for _, d, ids in want]
    # the framing, read with nothing of ours
    data = (tmp_path / "records" / f"part-{got[0].part:05d}.rec").read_bytes()
    offsets = np.frombuffer((tmp_path / "records" / f"part-{got[0].part:05d}.idx").read_bytes(), "<i8")
    n = struct.unpack("<Q", data[:8])[0]
    assert offsets[0] == 0 and offsets[-1] == len(data) and offsets[1] == n + 16
    unmask = lambda x: ((r := (x - 0xA282EAD8) & 0xFFFFFFFF) << 15 | r >> 17) & 0xFFFFFFFF
    assert unmask(struct.unpack("<I", data[8:12])[0]) == binary.crc32c([data[:8]])[0]
    assert unmask(struct.unpack("<I", data[12 + n : 16 + n])[0]) == binary.crc32c([data[12 : 12 + n]])[0]


def test_shuffled_reads_use_the_index(spark, tmp_path):
    docs, path = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS * 4)], DOC), str(tmp_path / "records")
    written = binary.write_records(docs, path, PATH, parts=2)
    plain = [tuple(r) for r in binary.read_records(written, path, wide=False).orderBy("part", "record").collect()]
    one, again, other = ([tuple(r) for r in binary.read_shuffled(written, path, False, seed, at_once=3).collect()] for seed in (1, 1, 2))
    assert one == again != other and sorted(one) == sorted(other) == sorted(plain) and one != sorted(one)
    empty = binary.write_records(docs.limit(0), str(tmp_path / "none"), PATH)
    assert binary.read_shuffled(empty, str(tmp_path / "none"), False, 1).count() == 0


def test_query_on_small_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(binary.op5_binary(spark, str(tmp_path)).collect())
    plain, start = Tokenizer.from_file(PATH), 0
    for row, text in zip(got, TEXTS, strict=True):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(row) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_damage_is_noticed(spark, tmp_path):
    docs, path = spark.createDataFrame([(1, "some text", None)], DOC), tmp_path / "records"
    written = binary.write_records(docs, str(path), PATH, parts=1)
    file = next(path.glob("*.rec"))
    data = bytearray(file.read_bytes())
    data[30] ^= 1
    file.write_bytes(bytes(data))
    try:
        binary.read_records(written, str(path), wide=False).collect()
    except Exception as error:
        assert "does not match" in str(error)
    else:
        raise AssertionError("damage went unnoticed")


def test_frequent_words_stay_however_many_rare_ones_there_are():
    class Counting:
        def __init__(self, model):
            self.model, self.asked = model, []

        def tokenize(self, word):
            self.asked.append(word)
            return self.model.tokenize(word)

    plain, coder = Tokenizer.from_file(PATH), binary.Encoder(open(PATH, encoding="utf-8").read(), memo=100)
    model = Counting(plain.model)
    coder.tokenizer, coder.model = types.SimpleNamespace(model=model), model
    letters = "abcdefghij"
    rare = ["".join(letters[int(d)] for d in str(k)) for k in range(10_000, 12_000)]
    for k in range(0, len(rare), 10):
        text = " ".join(rare[k : k + 10]) + " often, seen"
        assert coder.payload(text, 2).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
    assert len(model.asked) == len(rare) + 3
