"""WARC files of web pages, and fixity audits of their replicas by Merkle trees.

Files: one `resource` record a page, WARC/1.1, ordered by page_id, written by Spark's text writer with the records' end
as its line end, so any file system that Spark reaches will do. `read_warc` parses them back by Content-Length.

Audit: every record is hashed (SHA-256). A tree's leaves are keys (page_id) in order; an inner node covers up to 256
children, a fixed range of keys, and so an offset range of the archive; its hash is that of its children's places, hashes and
sizes. Each replica's tree is built by itself. Roots are compared first; where they differ, only children of nodes that
differ are compared, level by level, down to keys, and only their records are looked at. As a node's range
of keys is fixed, a lost record changes its own branch alone, though it shifts all offsets after it.

Records go into leaves as sums of digest parts with their number, so a repeated key, however often, is one combined
aggregate; no node ever gathers more than 256 children. Text is hashed where it is read; the sorts and joins carry digests.

Damaged files don't end an audit: read_warc() goes on at the next record and tells what it left, and audit(placed=True) names file and offset.

Cases: a null page_id is a key of its own; a null url has no header, a null html is empty; repeated rows are counted;
two empty archives are equal; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.llm.common import pick, shared_dir, staged

#: Bits of a key that a level of the tree takes off; an inner node has 2 ** BITS children at most.
BITS = 8
_END = "\r\n\r\n"
_NO_KEY = -(1 << 63)


def record(page_id: Column, url: Column, html: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """Text of a record, without the blank lines after it."""
    page_id, html = F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(html, F.lit(""))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]", ""), F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id, F.lit(f">\r\nWARC-Date: {date}\r\n"), uri,
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(_END), html,
    )


def records(pages: DataFrame) -> DataFrame:
    """page_id, record."""
    own = pick(pages, page_id="long", url="string", html="string")
    return own.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def write_warc(archive: DataFrame, path: str, per_file: int = 20000) -> None:
    """archive: page_id, record. Writes gzipped WARC files in the order of page_id."""
    tasks = max(1, int(archive.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = archive.repartitionByRange(tasks, F.col("page_id").asc_nulls_first(), F.xxhash64("record")).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "record")
    ordered.select(F.col("record").alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_NEXT = re.compile(rb"\r\n\r\n(?=WARC/1\.)")
_MEMBER = b"\x1f\x8b\x08"


def unzipped(data: bytes) -> tuple[bytes, list[tuple[int, str]]]:
    """The content of a file, gzipped as a whole or record by record, as far as it can be read; and (byte of the content, problem) of what can't.

    After a member that is torn or damaged the next one is looked for, so a file of one member for each record loses that record alone.
    """
    if data[:2] != _MEMBER[:2]:
        return data, []
    out, problems, at, size = [], [], 0, 0
    while 0 <= at < len(data):
        unzip, step, good = zlib.decompressobj(31), 1 << 16, False
        here = at
        try:
            while here < len(data) and not unzip.eof:
                part = unzip.decompress(data[here : here + step])
                here += step
                out.append(part)
                size += len(part)
            good = unzip.eof
        except zlib.error:
            pass
        if good:
            at = min(here, len(data)) - len(unzip.unused_data)
        else:
            problems.append((size, "gzip"))
            at = data.find(_MEMBER, at + 3)
        if at < len(data) and at >= 0 and data[at : at + 3] != _MEMBER:
            problems.append((size, "gzip"))
            at = data.find(_MEMBER, at)
    return b"".join(out), problems


def parse(data: bytes) -> list[tuple[int, int, dict[str, str], bytes | None, str | None]]:
    """(offset, length with the end, headers in lower case, block, problem) of all records of a file's content.

    problem: null, `length` where the record doesn't end where its Content-Length says (its block then goes to the next record's start), `header` where no
    record can be made out up to the next one; block is null then.
    """
    out, at = [], 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        lines = data[at : max(head, at)].decode(errors="replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        number = headers.get("content-length", "")
        if head >= 0 and lines[0].startswith("WARC/") and number.isdecimal() and number.isascii() and len(number) < 19:
            end = head + 4 + int(number)
            if data[end : end + 4] == b"\r\n\r\n" and (end + 4 == len(data) or data.startswith(b"WARC/1.", end + 4)):
                out.append((at, end + 4 - at, headers, data[head + 4 : end], None))
                at = end + 4
                continue
        sound = head >= 0 and lines[0].startswith("WARC/") and "warc-record-id" in headers
        after = _NEXT.search(data, head if sound else at)  # the block may be empty
        if sound and after and after.start() == head:
            after = _NEXT.search(data, head + 4) if not data.startswith(b"WARC/1.", head + 4) else after
        stop = after.end() if after else len(data)
        last = stop - 4 if after or data.endswith(_END.encode()) else stop
        out.append((at, stop - at, headers if sound else {}, data[head + 4 : max(last, head + 4)] if sound else None, "length" if sound else "header"))
        at = stop
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html, record, file, file_offset, problem of every record of the files in a folder.

    file_offset is of the file's content, before compression. What can't be read is a row of its own without a record: its problem is `header` (no record can be made
    out there), `gzip` (from there on a member can't be unpacked) or `text` (the record isn't UTF-8). `length` is of a record that is read all the same.
    """
    import pandas as pd

    def rows(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                data, torn = unzipped(bytes(content))
                found = [*parse(data), *((at, 0, {}, None, problem) for at, problem in torn)]
                for k in range(0, len(found), 1000):
                    out = []
                    for at, n, headers, block, problem in found[k : k + 1000]:
                        page, record, html = None, None, None
                        if block is not None:
                            name_ = headers.get("warc-record-id", "").removeprefix("<urn:page:").rstrip(">")
                            page = int(name_) if re.fullmatch("-?[0-9]{1,18}", name_) else None
                            try:
                                end = n - 4 if data.startswith(_END.encode(), at + n - 4) else n
                                record, html = data[at : at + end].decode(), block.decode()
                            except UnicodeDecodeError:
                                problem = "text"
                        out.append((page, headers.get("warc-target-uri"), html, record, name, at, problem))
                    part = pd.DataFrame(out, columns=["page_id", "url", "html", "record", "file", "file_offset", "problem"])
                    yield part.assign(page_id=pd.array(part["page_id"], "Int64"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(rows, "page_id long, url string, html string, record string, file string, file_offset long, problem string")


def index(archive: DataFrame) -> DataFrame:
    """archive: page_id, record, perhaps file and file_offset. Returns page_id, key, digest, length, offset, file, file_offset: records in key order, with where each starts."""
    place = [(F.col(c) if c in archive.columns else F.lit(None)).cast(t).alias(c) for c, t in (("file", "string"), ("file_offset", "long"))]
    leaves = staged(archive.where("record IS NOT NULL").select(*place, F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce("page_id", F.lit(_NO_KEY)).alias("key"), F.sha2("record", 256).alias("digest"), (F.octet_length("record") + len(_END)).cast("long").alias("length")), "digests")
    dealt = staged(leaves.repartitionByRange("key", "digest", "row").withColumn("part", F.spark_partition_id()), "ordered")
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.sum("length").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    inner = W.partitionBy("part").orderBy("key", "digest", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumn("within", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(F.broadcast(starts), F.col("part") == F.col("of"))  # a row for each partition
    return staged(rows.select("page_id", "key", "digest", "length", (F.col("start") + F.col("within")).alias("offset"), "file", "file_offset"), "index")


def leaves(rows: DataFrame) -> DataFrame:
    """level 0, node (the key), hash, first and end offset, size and number of records."""
    part = lambda k: F.sum(F.conv(F.substring("digest", 1 + 15 * k, min(15, 64 - 15 * k)), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"), *[part(k).alias(f"s{k}") for k in range(5)])
    return sums.select(F.lit(0).alias("level"), F.col("key").alias("node"), F.sha2(F.concat_ws(":", "n", "size", *[f"s{k}" for k in range(5)]), 256).alias("hash"), "first", "end", "size", "n")


def above(below: DataFrame, level: int, bits: int = BITS) -> DataFrame:
    """The nodes over a level. Keys count as unsigned here, so that all ranges meet in one root."""
    place = F.shiftrightunsigned("node", bits) if level > 1 else F.shiftrightunsigned(F.col("node").bitwiseXOR(F.lit(_NO_KEY)), bits)
    up = below.groupBy(place.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "hash", "size", "n"))).alias("children"), F.min("first").alias("first"), F.max("end").alias("end"), F.sum("size").alias("size"), F.sum("n").alias("n"))
    joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"], c["size"], c["n"])), "|")
    return up.select(F.lit(level).alias("level"), F.col("parent").alias("node"), F.sha2(joined, 256).alias("hash"), "first", "end", "size", "n")


def trees(replicas: list[DataFrame], bits: int = BITS) -> list[list[DataFrame]]:
    """For every replica's index the levels of its tree, from the leaves to a root that covers the same keys in all."""
    out = [[staged(leaves(r), "level")] for r in replicas]
    for level in range(1, -(-64 // bits) + 1):
        for t in out:
            t.append(staged(above(t[-1], level, bits), "level"))
        ends = [t[-1].agg(F.min("node").alias("a"), F.max("node").alias("b")).first() for t in out]
        if len({x for a, b in ends for x in (a, b) if x is not None}) <= 1:
            break
    return out


def audit(one: DataFrame, other: DataFrame, bits: int = BITS, placed: bool = False) -> DataFrame:
    """one, other: page_id, record. A row for each record that only one replica has, or that differs.

    page_id, problem (changed, missing: only in one, extra: only in other), and offset, length, digest in one and in other; offsets are of a replica's records in
    the order of their keys. placed: also file and file_offset in either, of replicas that have these columns.
    Of a key with several records those that agree are left out, and the rest are paired in the order of their digests.
    """
    rows = index(one), index(other)
    both = trees(list(rows), bits)
    differ = None
    for level in reversed(range(len(both[0]))):
        a, b = (t[level].select("node", F.col("hash").alias(h)) for t, h in zip(both, ("a", "b"), strict=True))
        if differ is not None:
            place = F.shiftrightunsigned("node", bits) if level else F.shiftrightunsigned(F.col("node").bitwiseXOR(F.lit(_NO_KEY)), bits)
            a, b = (x.withColumn("parent", place).join(differ.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent") for x in (a, b))
        differ = staged(a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "differ")
        if level == len(both[0]) - 1 and differ.isEmpty():
            break  # the roots agree; no key differs
    nth = W.partitionBy("key", "digest").orderBy("offset")
    sides = []
    for r, side in zip(rows, "ab", strict=True):
        sides.append(r.join(differ.withColumnRenamed("node", "key"), "key", "left_semi").withColumn("nth", F.row_number().over(nth)).select("key", "digest", "nth", "page_id", "offset", "length", "file", "file_offset").alias(side))
    a, b = sides
    same = ["key", "digest", "nth"]
    rank = F.row_number().over(W.partitionBy("key").orderBy("digest", "offset"))
    a, b = a.join(b, same, "left_anti").withColumn("rank", rank), b.join(a, same, "left_anti").withColumn("rank", rank)
    what = ("offset", "length", "digest", *("file", "file_offset") * placed)
    named = lambda df, side: df.select("key", "rank", F.col("page_id").alias(f"page_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in what])
    problem = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    pairs = named(a, "a").join(named(b, "b"), ["key", "rank"], "full_outer")
    return pairs.select(F.coalesce("page_a", "page_b").alias("page_id"), problem.alias("problem"), *[f"{c}_{s}" for s in "ab" for c in what])


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage, for audits: of every 1000 keys, 7 has another first character and 11 is lost."""
    own = pick(pages, page_id="long", url="string", html="string").where(~(F.coalesce(F.col("page_id") % 1000, F.lit(0)) == 11))
    return own.withColumn("html", F.when(F.col("page_id") % 1000 == 7, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def audit_of_damage(pages: DataFrame) -> DataFrame:
    """The audit of pages against a damaged replica that is written to WARC files and read back from them."""
    path = shared_dir(pages.sparkSession, "warc")
    write_warc(records(damaged(pages)), path)
    return audit(records(pages), read_warc(pages.sparkSession, path).select("page_id", "record"))
