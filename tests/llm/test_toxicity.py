import zlib

import numpy as np
import pytest

from permlab.llm import toxicity as t

RNG = np.random.default_rng(1)
SYLLABLES = "an the er ing ion be to re st lo vi ma ku so ra".split()
WORD = lambda: "".join(RNG.choice(SYLLABLES, RNG.integers(1, 4)))
BAD = ["idiot", "loser", "scum", "worthless"]


def text(n, bad=None):
    words = [WORD() for _ in range(n)]
    if bad:
        words.insert(int(RNG.integers(0, n)), bad)
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = [(k, text(int(RNG.integers(10, 80)), BAD[k % 4] if k % 5 == 0 else None), int(k % 5 == 0)) for k in range(600)]
    return [*out, (9001, None, 0), (9002, "", 0), (None, text(20, "idiot"), 1), (9003, text(20000, "scum"), 1), (9003, text(10), 1)]


@pytest.fixture(scope="module")
def model(rows):
    tables = np.zeros(t.BINS, np.int64), np.zeros(t.BINS, np.int64)
    t.count_letters(t.lowered([x for _, x, _ in rows]), *tables)
    restored = t.Toxicity(*tables, None).restore([x for _, x, _ in rows])
    return t.Toxicity(*tables, t.fit(restored, [y for *_, y in rows]))


@pytest.mark.parametrize("said, meant", [("1d10t", "idiot"), ("l-o-s-e-r", "loser"), ("s c u m", "scum"), ("5cum", "scum"), ("idiooooot", "idiot"), ("w0rthl3$$", "worthless"), ("l 0 $ e r", "loser"), ("idiot!!", "idiot")])
def test_disguises(model, said, meant):
    restored = model.restore([f"the ing {said}, ion", None, "a\x01b\nc", said])
    assert restored[0].split() == ["the", "ing", meant, "ion"] and restored[1] == "" and restored[2] == "a b c" and restored[3].split() == [meant]
    assert model([f"{text(300)} {said} {text(300)}"])[0] > 0.5 > model([text(600)])[0]


def brute(span, model):
    """All readings, one by one."""
    best = None
    paths = [((" ", " "), 0.0, "")]
    for options in [*t.readings(span), [(" ", 0.0)]]:
        paths = [((a, b), cost + p, x) if not c or c == b == " " else ((b, c), cost + p - model(a, b, c), x + c) for (a, b), cost, x in paths for c, p in options]
    best = min((cost, x) for _, cost, x in paths)
    return best[1].strip()


def test_viterbi_against_all_readings(model):
    letters = t.Letters(*model.tables)
    for _ in range(60):
        span = "".join(RNG.choice(list("aiost013$!. -l"), 8))
        assert t.decode(span, letters) == brute(span, letters)


def test_tables(spark, rows):
    docs = spark.createDataFrame([(a, b, "x") for a, b, _ in rows], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows] + [(3, None), (77777, 1)], "doc_id long, toxic int")
    got = t.scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    truth = {a: y for a, _, y in rows if a is not None and a < 9000}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.97
    kept = t.keep_clean(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.predicted == 0)
    assert t.scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in t.scores(docs.limit(5), labels.limit(0)).collect()} == {0.0}
