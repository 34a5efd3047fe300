import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from permlab.llm import packing
from permlab.llm.packing import Item, Limits, Packer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sequences(examples, limits, pool=packing.POOL, trim=True):
    packer, out = Packer(limits, pool, trim), []
    for k, loss in enumerate(examples):
        out += packer.add(Item(k, 0, np.arange(len(loss), dtype=np.uint32), np.array(loss, np.int8), len(loss)))
    return out + list(packer.rest())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=70), max_size=40), st.sampled_from([8, 32, 64]), st.integers(1, 6), st.integers(1, 70), st.sampled_from([1, 5, 100]), st.booleans())
def test_every_id_once_within_all_limits(examples, ids, segments, loss, pool, trim):
    out = sequences(examples, Limits(ids, segments, loss), pool, trim)
    found = {k: [] for k in range(len(examples))}
    for s in out:
        assert 0 < sum(len(x.ids) for x in s) <= ids and len(s) <= segments and sum(int(x.loss.sum()) for x in s) <= loss
        if trim:
            used = sum(len(x.ids) for x in s)
            assert used == ids or used & (used - 1) == 0
        for x in s:
            assert x.ids.tolist() == list(range(x.start, x.start + len(x.ids))) and x.loss.tolist() == examples[x.doc_id][x.start : x.start + len(x.ids)]
            found[x.doc_id] += x.ids.tolist()
    assert all(sorted(found[k]) == list(range(len(e))) for k, e in enumerate(examples))


def test_the_largest_product_goes_in_first():
    """By hand: most is asked of the loss (12 of 10, ids 22 of 20, segments 4 of 8), so of two items of 6 ids that with loss goes first; then 0.393 * 0.7 * 6 / 20 for 0 is less than 0.393 * 0.7 * 5 / 20 + 0.429 * 0.4 / 10 for 3."""
    items = [[0] * 6, [1] * 6, [1] * 5, [1] + [0] * 4]
    first = sequences(items, Limits(20, 8, 10), trim=False)[0]
    assert [x.doc_id for x in first] == [1, 3, 0, 2] and [len(x.ids) for x in first] == [6, 5, 6, 3]


def test_few_cuts_and_no_padding():
    rng = np.random.default_rng(3)
    examples = [[1] * int(n) for n in rng.geometric(1 / 300, 3000)]
    out = sequences(examples, Limits())
    short = [s for s in out if sum(len(x.ids) for x in s) < 1024]
    assert len(short) <= 10 and sum(len(s) for s in out) < 1.4 * len(examples)
    assert len(out) <= -(-sum(map(len, examples)) // 1024) + 10


def test_documents(spark):
    rows = [(5, "five words of some text " * 700), (None, "none"), (3, None), (5, "five"), (9, ""), (1, "long word " * 5000), (5, "five")] + [(100 + i, f"text {i} " * (i % 90)) for i in range(300)]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, length string, start int").repartition(3)
    got = packing.packed_pieces(df, PATH).collect()
    encode = Tokenizer.from_file(PATH)
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*encode.encode(t or "", add_special_tokens=False).ids, 0])
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    for d, all_ids in want.items():
        parts = [r for r in got if r.doc_id == d]
        assert sum(r.length for r in parts) == sum(map(len, all_ids))
        for r in parts:
            assert any(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in all_ids)
        if len(all_ids) == 1:
            spans = sorted((r.start, r.start + r.length) for r in parts)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans[:-1], spans[1:], strict=True))
    assert packing.packed_pieces(df.limit(0), PATH).collect() == []


def test_instruction_data(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [int(x) for x in rng.integers(0, 50000, n)], [int(i >= n // 2) for i in range(n)]) for k, n in enumerate(rng.integers(0, 400, 200).tolist())] + [(None, None, None), (7, [1, 2], None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<int>").repartition(2)
    out = packing.pack_examples(df, f"{packing.shared_dir(spark, 'test')}", Limits(512, 4, 200)).collect()
    assert all(len(r.ids) <= 512 and len(r.segments) <= 4 for r in out)
    loss = {k: m or [1] * len(i or []) for k, i, m in rows[:200]}
    assert all(sum(sum(loss[s.doc_id][s.start : s.start + s.length]) for s in r.segments if s.doc_tokens > 2) <= 200 for r in out)
    assert sum(len(r.ids) for r in out) == sum(len(i or []) for _, i, _ in rows)
    with pytest.raises(Exception, match="marks of loss"):
        packing.pack_examples(spark.createDataFrame([(1, [1, 2], [1])], df.schema), f"{packing.shared_dir(spark, 'test')}").collect()
