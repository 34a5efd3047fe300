import hashlib

from permlab.llm import warc

ROWS = [(i * 37 % 5000 - 700, f"http://h{i % 7}.example/{i}" if i % 9 else None, f"<p>tëxt {i}\r\n\r\nWARC/1.1</p>" * (i % 4)) for i in range(400)]
ROWS += [(None, "u", "no key"), (None, "u", None), (8, "u", ""), (8, "u", ""), (1007, "u", "abc"), (1011, "u", "abc"), (9_000_000_000, "far", "x" * 100000)]
SCHEMA = "page_id long, url string, html string, record string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)


def text(r):
    html = r[2] or ""
    uri = f"WARC-Target-URI: {r[1]}\r\n" if r[1] is not None else ""
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if r[0] is None else r[0]}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n{uri}Content-Type: text/html\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}"


def brute(one, other):
    """Records by key, those that agree crossed out, the rest paired in the order of digests."""
    def listed(rows):
        out, at = {}, 0
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(text(r).encode()).hexdigest()))
        for r in order:
            n = len(text(r).encode()) + 4
            out.setdefault(r[0], []).append((at, n, hashlib.sha256(text(r).encode()).hexdigest()))
            at += n
        return out

    a, b, found = listed(one), listed(other), []
    for key in {*a, *b}:
        x, y = list(a.get(key, [])), list(b.get(key, []))
        for r in list(x):
            twin = next((s for s in y if s[2] == r[2]), None)
            if twin:
                x.remove(r)
                y.remove(twin)
        for k in range(max(len(x), len(y))):
            p, q = x[k] if k < len(x) else (None,) * 3, y[k] if k < len(y) else (None,) * 3
            found.append((key, "missing" if q[0] is None else "extra" if p[0] is None else "changed", *p, *q))
    return sorted(found, key=repr)


def test_files_round_trip(spark, tmp_path):
    warc.write_warc(warc.records(frame(spark, ROWS)), str(tmp_path / "w"), per_file=50)
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(((r.page_id, r.url, r.html) for r in back), key=repr) == sorted(((a, b, c or "") for a, b, c in ROWS), key=repr)
    assert sorted(r.record for r in back) == sorted(map(text, ROWS))


def test_audit(spark):
    other = [(a, b, "changed" if a == 8 or a == -330 else c) for a, b, c in ROWS if a != 40 and b != "far"] + [(77777, "new", "n"), (8, "u", "")]
    one, two = warc.records(frame(spark, ROWS)), warc.records(frame(spark, other))
    assert sorted(map(tuple, warc.audit(one, two, bits=7).collect()), key=repr) == brute(ROWS, other)
    assert warc.audit(one, one).collect() == []
    assert warc.audit(one.limit(0), one.limit(0)).collect() == []
    assert len(warc.audit(one.limit(0), two).collect()) == len(other)


def test_descent_opens_only_branches_that_differ(spark):
    one = warc.index(warc.records(frame(spark, ROWS)))
    two = warc.index(warc.records(frame(spark, [(a, b, "?" if a == -330 else c) for a, b, c in ROWS])))
    trees = warc.trees([one, two])
    for a, b in zip(*trees, strict=True):
        x, y = ({r.node: r.hash for r in t.collect()} for t in (a, b))
        assert x.keys() == y.keys() and sum(x[k] != y[k] for k in x) == 1


def test_damage(spark):
    bad = [(a, b, "#" + c[1:] if c and a is not None and a % 1000 == 7 else c) for a, b, c in ROWS if a is None or a % 1000 != 11]
    assert sorted(map(tuple, warc.audit_of_damage(frame(spark, ROWS)).collect()), key=repr) == brute(ROWS, bad)


def test_damaged_files_are_located(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h/{i}", f"<p>text {i}</p>" * (1 + i % 5)) for i in range(300)]
    folder, raw = tmp_path / "w", tmp_path / "raw"
    warc.write_warc(warc.records(frame(spark, rows)), str(folder), per_file=40)
    raw.mkdir()
    names = sorted(p.name for p in folder.glob("part-*"))
    whole = {n: gzip.decompress((folder / n).read_bytes()) for n in names}
    first, second, third, fourth = names[:4]
    starts = {n: [r[0] for r in warc.parse(x)] for n, x in whole.items()}
    ids = {n: [int(r[2]["warc-record-id"][10:-1]) for r in warc.parse(x)] for n, x in whole.items()}
    at = whole[first].index(b"<p>", starts[first][3])
    whole[first] = whole[first][: at + 1] + b"q" + whole[first][at + 2 :]  # a flipped byte
    at = whole[second].index(b"Content-Length: ", starts[second][5]) + 16
    whole[second] = whole[second][:at] + b"9" + whole[second][at + 1 :]  # a wrong length
    whole[third] = whole[third][: starts[third][2] + 30]  # a cut file
    for n, x in whole.items():
        (raw / n.removesuffix(".gz")).write_bytes(x)
    torn = gzip.compress(whole[fourth])
    (raw / fourth.removesuffix(".gz")).write_bytes(torn[: len(torn) // 2])  # a torn gzip file
    back = warc.read_warc(spark, str(raw))
    found = warc.audit(warc.records(frame(spark, rows)), back, placed=True).collect()
    by = {r.page_id: r for r in found}
    name = lambda r: r.file_b.rsplit("/", 1)[1] + ".gz"
    assert (by[ids[first][3]].problem, name(by[ids[first][3]]), by[ids[first][3]].file_offset_b) == ("changed", first, starts[first][3])
    assert (by[ids[second][5]].problem, name(by[ids[second][5]]), by[ids[second][5]].file_offset_b) == ("changed", second, starts[second][5])
    assert {i for i, r in by.items() if r.problem == "missing"} >= set(ids[third][2:]) and all(i in ids[third][2:] + ids[fourth] for i, r in by.items() if r.problem == "missing")
    told = {(r.file.rsplit("/", 1)[1] + ".gz", r.problem): r.file_offset for r in back.where("problem IS NOT NULL").collect()}
    assert told[second, "length"] == starts[second][5] and told[third, "header"] == starts[third][2] and (fourth, "gzip") in told


def test_a_torn_member_costs_its_record_alone():
    import gzip

    records = [text((i, "u", f"<p>{i}</p>" * 50)).encode() + b"\r\n\r\n" for i in range(5)]
    members = [gzip.compress(r) for r in records]
    spoilt = bytearray(members[2])
    spoilt[len(spoilt) // 2] ^= 255
    data, problems = warc.unzipped(b"".join([*members[:2], bytes(spoilt), *members[3:]]))
    kept = {h.get("warc-record-id") for _, _, h, block, problem in warc.parse(data) if problem is None}
    assert kept >= {f"<urn:page:{i}>" for i in (0, 1, 4)} and len(problems) >= 1
    assert warc.unzipped(b"plain") == (b"plain", []) and warc.unzipped(b"".join(members)) == (b"".join(records), [])
