import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from permlab.llm import decontaminate, mixing, simhash, toxicity

DIR = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token ids"]


def test_run_against_a_plain_version(spark):
    """Each stage's decisions, document by document, in Python."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    clean = [r for r in rows if model([r[1]])[0] < 0.5]
    assert 0 < len(clean) < len(rows)
    # groups by brute force: fingerprints of five words within two bits, or 0.8 of the shingles in common
    fps = simhash.fingerprints(pa.array([t for _, t, _ in clean]), 5).tolist()
    words = [re.findall(r"[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for _, t, _ in clean]
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in words]
    label, near = list(range(len(clean))), set()
    for i in range(len(clean)):
        for j in range(i):
            alike = bool(grams[i]) and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or alike:
                near |= {i, j}
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    first = {}
    for (d, *_), x in zip(clean, label):
        first[x] = min(d, first.get(x, d))
    single = [r for r, x in zip(clean, label) if first[x] == r[0]]
    assert len(single) < len(clean) and near
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(clean, "doc_id long, text string, source string")).collect()}
    # sections may miss a near copy, and join nothing else
    assert {d for d, *_ in single} <= kept and len(kept) <= len(single) + 0.1 * (len(clean) - len(single))
    single = [r for r in clean if r[0] in kept]
    bench = decontaminate.Benchmark([(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    kept = [r for r in single if not decontaminate.overlaps(pa.array([r[1]]), bench)]
    assert len(kept) < len(single)
    table = spark.createDataFrame(kept, "doc_id long, text string, source string")
    copies = {r.doc_id: (r.copies, r.at, r.source_size, r.target, r.tilt) for r in mixing.mix(table).collect()}
    assert 0 in {c[0] for c in copies.values()} and max(c[0] for c in copies.values()) > 1
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {d: t for d, t, _ in kept}
    turns = []  # every copy at the time when its middle word is demanded
    for d, (n, at, size, target, tilt) in copies.items():
        for e in range(n):
            u = (at + e * size) / target
            turns.append((u if tilt == 0 else 2 * u / (1 + tilt + math.sqrt((1 + tilt) ** 2 - 4 * tilt * u)), d))
    want, at = [], 0
    for _, d in sorted(turns):
        ids = np.array([*encode.encode(text[d] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in corpus_pipeline.run(spark, DIR).orderBy("start").collect()] == want


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_documents_without_ids_and_texts(spark, tmp_path):
    rows = [(None, "one text of some words " * 9, "en", "a", 5), (None, "one text of some words " * 9, "en", "a", 5), (None, None, None, None, None), (7, "", "en", None, 0), (7, "another one " * 30, "en", "b", 1), (8, "x" * 300000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 7, 8} and 8 in {r.doc_id for r in got}
