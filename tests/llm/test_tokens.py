import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from permlab.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t\r\x0b\x1c\x85\xa0  　aé'sZ9ß,<|>Â日🙂"
WHOLE = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=60), st.text(max_size=20)), max_size=6))
def test_pieces_encode_as_whole_texts(texts):
    ids, counts = tokens.encoded(pa.array(texts, pa.string()), PATH)
    whole = [x.ids for x in WHOLE.encode_batch([x or "" for x in texts], add_special_tokens=False)] if texts else []
    assert counts.tolist() == [len(x) for x in whole]
    assert ids.tolist() == [y for x in whole for y in x]


def test_table_of_pieces_that_fills_up(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 16)
    monkeypatch.setattr(tokens, "_OPEN", {})
    monkeypatch.setattr(tokens, "STEP", 64)
    text = " ".join(f"word{i % 37}" for i in range(300)) + " " + "x" * 500 + " <|endoftext|> end"
    ids, _ = tokens.encoded(pa.array([text, text]), PATH)
    assert ids.tolist() == WHOLE.encode(text, add_special_tokens=False).ids * 2


@pytest.mark.parametrize("width", [4, 8, 16])
def test_codes_give_every_id_back_one_by_one_and_all_at_once(width):
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint64).astype(np.uint32) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint32)
        code = tokens.Dac(tokens.dac_encode(ids, width))
        assert len(code) == n and np.array_equal(code.all(), ids)
        assert [code[i] for i in range(n)] == ids.tolist()


def test_pieces_that_the_table_lacks_are_encoded_together(monkeypatch):
    r = np.random.default_rng(5)
    odd = [*"ab1.' \n\t\0\x7f", "  ", "\u00a0", "\u0085", "\u00e9", "\u0416", "\u4e2d", "\U0001f600", "<|endoftext|>", "'s", "x" * 47, "y" * 48, "z" * 60]
    texts = ["".join(odd[k] for k in r.integers(0, len(odd), r.integers(0, 40))) for _ in range(3000)] + [" ".join(f"new{k}" for k in range(5000))]
    seen, whole = [], tokens.Pieces.ids_of
    monkeypatch.setattr(tokens, "_OPEN", {})
    monkeypatch.setattr(tokens.Pieces, "ids_of", lambda self, text: seen.append(len(text)) or whole(self, text))
    for _ in range(2):
        ids, counts = tokens.encoded(pa.array(texts, pa.string()), PATH)
        want = [WHOLE.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
    seen.clear()
    tokens.encoded(pa.array([" ".join(f"other{k}" for k in range(5000))]), PATH)
    assert len(seen) <= 2  # one for each word before


def signed(text):
    """Spark's xxhash64 of a text."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_files_hold_all_documents_in_order(spark):
    rows = [(5, "five five", "x"), (None, "none", "x"), (3, None, "x"), (5, "five", "y"), (9, "", "z"), (1, "long word " * 5000, "z"), (5, "five", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = [tuple(r) for r in tokens.token_table(df, PATH).orderBy("start").collect()]
    encode = WHOLE
    at, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((x[1], x[2]) for x in got) == sorted((x[1], x[2]) for x in want)
    assert got == want
    assert tokens.token_table(df.limit(0), PATH).collect() == []


def test_single_tokens_of_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 40)
    monkeypatch.setattr(tokens, "STEP", 64)
    rows = [(i, " ".join(f"word{i * j}" for j in range(i % 13))) for i in range(60)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    segments = tokens.write_tokens(df, f"{tmp_path}/tokens", PATH)
    whole = [(r.start + k, r.doc_id, x) for r in tokens.read_tokens(segments, with_ids=True).collect() for k, x in enumerate(r.ids)]
    assert segments.count() > 8 and segments.select("shard").distinct().count() > 1
    got = tokens.tokens_at(segments, spark.range(-5, len(whole) + 9).withColumnRenamed("id", "position"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(whole, key=lambda r: r[0])
    assert tokens.tokens_at(segments, spark.range(0).withColumnRenamed("id", "position")).collect() == []


def test_files_in_the_order_of_the_files_they_come_from(spark, tmp_path):
    rows = [(i * 7 % 50, f"text {i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "text").sortWithinPartitions("text").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = [r.doc_id for r in tokens.token_table(docs, PATH, order=tokens.file_order(docs)).orderBy("start").collect()]
    assert got == [d for d, _ in sorted(rows, key=lambda r: r[1])]
    assert tokens.file_order(docs.distinct()) is None
