"""Token ids of whole texts in a randomly addressable binary file.

File format: a folder of Parquet files written by Spark, each row one segment of consecutive documents of one
shard (shard, segment, first: ids of the shard before it, doc_ids, ends: ids up to each document's end, codes).
`codes` is a directly addressable code (DAC): every id is cut into chunks of `WIDTH` bits, least significant first.
Level k holds chunk k of all ids that have one, a bitmap that tells which of these ids go on, and a rank directory
with the number of set bits before every 512th. Id i is read from position i of level 0; while its bit is
set, its position in the next level is the rank of that bit. No block is decoded for a single id: codes are written without
compression, a segment in a page of its own, and tokens_at() reads single ids out of them in place.

Texts are range-sorted by doc_id (or another order, such as that of the files they come from) before they are encoded, so shards are in that order, and the ids before a
shard follow from a row for each shard. A text is encoded through a table of its pieces: a piece starts at white
space after a character that isn't, a place the tokenizer always cuts, so it encodes pieces alone as in the text.

Cases: a null text is empty and gets the end id alone; null doc_ids come first; repeated rows are separate
documents, and those of one doc_id in the order of a digest of their texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.llm.common import RAW, estimated_bytes, modest_batches, shared_dir, spans_of, text_bytes

WIDTH = 8
RANK_BITS = 512
#: Pieces longer than this many bytes are encoded without the table.
LONGEST = 48
#: Pieces a table holds before it forgets the rarer half; a bound of its memory, not of what is encoded.
PIECES = 1 << 20
#: Bytes of text taken at a time, and ids in a segment after which the next document starts another.
STEP, SEGMENT_IDS = 1 << 20, 1 << 20


# -- directly addressable codes


def dac_encode(ids: np.ndarray, width: int = WIDTH) -> bytes:
    """Header: width, levels, number of ids; per level: chunks, bitmap, ranks (all little-endian)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    out, rest, levels = [], ids, 0
    kind = np.uint8 if width <= 8 else np.uint16
    while True:
        more = rest >> np.uint32(width)
        on = more > 0
        bits = np.packbits(on, bitorder="little")
        blocks = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.uint32) if len(on) else np.zeros(0, np.uint32)
        ranks = np.zeros(len(blocks) + 1, np.uint32)
        np.cumsum(blocks, out=ranks[1:])
        out += [(rest & np.uint32((1 << width) - 1)).astype(kind).tobytes(), bits.tobytes(), ranks.tobytes()]
        levels += 1
        rest = more[on]
        if not len(rest):
            return struct.pack("<BBI", width, levels, len(ids)) + b"".join(out)


class Dac:
    """Reads what dac_encode has written, in place."""

    def __init__(self, data: bytes):
        width, levels, n = struct.unpack_from("<BBI", data)
        self.width, self.n, self.levels, at = width, n, [], struct.calcsize("<BBI")
        kind = np.dtype(np.uint8 if width <= 8 else "<u2")
        for _ in range(levels):
            chunks = np.frombuffer(data, kind, n, at)
            at += n * kind.itemsize
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", (n + RANK_BITS - 1) // RANK_BITS + 1, at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))
            n = int(ranks[-1])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            inside = np.unpackbits(bits[block * (RANK_BITS // 8) : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i, shift = int(ranks[block]) + int(inside.sum()), shift + self.width
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        value = np.zeros(self.n, np.uint32)
        where = None
        for k, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(k * self.width)
            if where is None:
                value |= part
            else:
                value[where] |= part
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            where = np.flatnonzero(on) if where is None else where[on]
        return value


# -- encoding through a table of pieces


class Pieces:
    """A tokenizer with a table of the pieces it has met. A piece is found by a 64-bit hash, then compared with the table's, eight bytes at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.power = np.random.default_rng(7).integers(0, 1 << 63, -(-LONGEST // 8) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        # bytes of each id: its characters stand for a byte each, but those of added ones for themselves
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(known.values(), default=-1) + 1, np.int64)
        self.width[list(known.values())] = [len(x) for x in known]
        for k, x in self.tokenizer.get_added_tokens_decoder().items():
            self.width[k] = len(x.content.encode())
        self.clear()

    def clear(self) -> None:
        self.slots = PIECES * 2
        self.keys, self.value = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.shift = np.uint64(64 - (self.slots.bit_length() - 1))
        self.n = 0
        self.uses = np.zeros(PIECES, np.int32)
        self.text, self.text_at = np.zeros(1 << 20, np.uint8), np.zeros(PIECES + 1, np.int64)
        self.ids, self.ids_at = np.zeros(1 << 20, np.uint32), np.zeros(PIECES + 1, np.int64)

    def forget(self) -> None:
        """Keeps the pieces that were met more often than the median one, half of the table at most; of equal ones the older."""
        n, uses = self.n, self.uses[: self.n].copy()
        kept = np.sort(np.argsort(-uses, kind="stable")[: PIECES // 2])
        kept = kept[uses[kept] > 1]
        hashes = np.zeros(n, np.uint64)
        held = self.value >= 0
        hashes[self.value[held]] = self.keys[held]
        text, text_at, ids, ids_at = self.text, self.text_at, self.ids, self.ids_at
        self.clear()
        self._put(hashes[kept], *_rows(text, text_at[kept], text_at[kept + 1]), *_rows(ids, ids_at[kept], ids_at[kept + 1]))
        self.uses[: len(kept)] = uses[kept] // 2  # what was common long ago counts less

    @staticmethod
    def grown(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, len(array) * 3 // 2) - len(array), array.dtype)])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        value = self.value[slot]
        found = np.where(self.keys[slot] == hashes, value, -1)  # an empty slot's value is -1, whatever its key
        left = np.flatnonzero((value >= 0) & (found < 0))
        while len(left):
            slot[left] = (slot[left] + 1) % self.slots
            at = slot[left]
            value = self.value[at]
            hit = (value >= 0) & (self.keys[at] == hashes[left])
            found[left[hit]] = value[hit]
            left = left[(value >= 0) & ~hit]
        return found

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Pieces, each with another hash, that aren't in the table."""
        text, sizes = _rows(data, starts, ends)
        self._put(hashes, text, sizes, *self.encode(text, sizes))

    def _put(self, hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, k = self.n, len(hashes)
        self.text_at[n + 1 : n + k + 1] = self.text_at[n] + np.cumsum(sizes)
        self.ids_at[n + 1 : n + k + 1] = self.ids_at[n] + np.cumsum(counts)
        self.text, self.ids = self.grown(self.text, self.text_at[n + k] + LONGEST), self.grown(self.ids, self.ids_at[n + k])
        self.text[self.text_at[n] : self.text_at[n + k]] = text
        self.ids[self.ids_at[n] : self.ids_at[n + k]] = ids
        values, slot, left = np.arange(n, n + k, dtype=np.int32), (hashes >> self.shift).astype(np.int64), np.arange(k)
        while len(left):
            free = left[self.value[slot[left]] < 0]
            self.keys[slot[free]], self.value[slot[free]] = hashes[free], values[free]
            left = left[self.value[slot[left]] != values[left]]
            slot[left] = (slot[left] + 1) % self.slots
        self.n += k

    def encode(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, whose texts lie one after another, and the number of each piece."""
        if not len(sizes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # these can stand in one text, which is cut before each of them
        joined = ((text[starts] == 32) | (text[starts] == 10)) & _solid(text, ends - 1)
        several = np.flatnonzero(joined)
        if 1 < len(several):
            inner, own = _rows(text, starts[several], ends[several])
            ids = self.ids_of(inner)
            stops, upto = np.cumsum(own), np.cumsum(self.width[ids])
            last = np.searchsorted(upto, stops)
            if len(ids) and upto[-1] == stops[-1] and np.array_equal(upto[last], stops):
                counts = np.zeros(len(sizes), np.int64)
                counts[several] = np.diff(last + 1, prepend=0)
                alone = np.flatnonzero(~joined)
                others = [self.ids_of(text[starts[i] : ends[i]]) for i in alone]
                counts[alone] = [len(x) for x in others]
                flat = np.zeros(counts.sum(), np.uint32)
                flat[np.repeat(joined, counts)] = ids
                flat[np.repeat(~joined, counts)] = np.concatenate([np.zeros(0, np.uint32), *others])
                return flat, counts
        each = [self.ids_of(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def ids_of(self, text: np.ndarray) -> np.ndarray:
        """Ids of one text, in this thread."""
        return np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, np.uint32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of each piece."""
        sizes, begin = ends - starts, starts - starts[0]
        short = sizes <= LONGEST
        # eights: which pieces have bytes from 8 * k on, the next eight of these, and what of them is the piece's
        own, eights, chosen = _eights(data[starts[0] : ends[-1]]), [], np.arange(len(sizes))
        hashes = sizes.astype(np.uint64) * self.power[-1]
        for k in range(0, LONGEST, 8):
            chosen = chosen[sizes[chosen] > k]
            mask = _FIRST[np.minimum(sizes[chosen] - k, 8)]
            value = own[begin[chosen] + k] & mask
            hashes[chosen] += (value ^ (value >> np.uint64(31))) * self.power[k // 8]
            eights.append((k, chosen, value, mask))
        at = self.find(hashes)
        new = np.flatnonzero((at < 0) & short)
        keys, first = np.unique(hashes[new], return_index=True)
        if self.n + len(keys) > PIECES:
            self.forget()
            at = self.find(hashes)
            new = np.flatnonzero((at < 0) & short)
            keys, first = (x[: PIECES - self.n] for x in np.unique(hashes[new], return_index=True))
        if len(keys):
            self.add(keys, data, starts[new[first]], ends[new[first]])
            at[new] = self.find(hashes[new])
        self.uses[at[at >= 0]] += 1
        held, from_ = _eights(self.text), self.text_at[at]
        ok = (at >= 0) & short & (self.text_at[at + 1] - from_ == sizes)
        for k, chosen, value, mask in eights:
            ok[chosen] &= held[from_[chosen] + k] & mask == value
        counts = np.where(ok, self.ids_at[at + 1] - self.ids_at[at], 0)
        rest = np.flatnonzero(~ok)
        others, many = self.encode(*_rows(data, starts[rest], ends[rest]))
        counts[rest] = many
        begin = np.cumsum(counts) - counts
        source = np.repeat(np.where(ok, self.ids_at[at], 0) - begin, counts) + np.arange(counts.sum())
        ids = self.ids[np.minimum(source, len(self.ids) - 1)]
        ids[np.repeat(~ok, counts)] = others
        return ids, counts


#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, zeros beyond the end, as numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _rows(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of values one after another, and their sizes."""
    sizes = ends - starts
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that surely isn't white space ends at these places: printable ASCII, or of two bytes whose first isn't C2."""
    before = data[np.maximum(at - 1, 0)]
    return ((data[at] > 32) & (data[at] < 127)) | ((at > 0) & (data[at] >= 128) & (before >= 0xC3) & (before <= 0xDF))


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, and at a space or line feed after a character that surely isn't white space.

    That is printable ASCII, or a two-byte character whose first byte isn't C2; all white space beyond ASCII
    has C2 or three bytes.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    blank = (data == 32) | (data == 10)
    solid = (data > 32) & (data < 127)
    solid[1:] |= (data[1:] >= 128) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    start = np.zeros(len(data), bool)
    start[1:] = blank[1:] & solid[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


_OPEN: dict[str, Pieces] = {}


def encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of each text."""
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    data, offsets = text_bytes(texts)
    starts = cuts(data, offsets)
    ends = np.append(starts[1:], len(data))
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for a, b in spans_of(ends - starts, STEP):
        x, n = _OPEN[path](data, starts[a:b], ends[a:b])
        ids.append(x)
        counts.append(n)
    upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return np.concatenate(ids), np.diff(upto[np.searchsorted(starts, offsets)])


# -- files

_SEGMENTS = "shard int, segment int, first long, doc_ids array<long>, ends array<long>, codes binary"
#: Bytes of a table for each task that encodes it, by Spark's estimate of its size.
TASK_BYTES = 1 << 26


def file_order(docs: DataFrame) -> list[Column] | None:
    """The order in which the rows stand in the files that docs was read from, as Spark's writers number them; None if docs isn't just read."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() not in ("LogicalRelation", "DataSourceV2Relation"):
        return None
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return None
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, order: list[Column] | None = None) -> DataFrame:
    """Encodes every text, appends end_id and writes the ids to the folder path, by ascending doc_id or in another order. Returns its segments."""
    spark = docs.sparkSession
    modest_batches(spark)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(c.alias(f"o{k}") for k, c in enumerate(order or [])))
    # a digest stands for the text: the bounds of ranges come from a sample of the keys, which the driver gets
    by = [F.col(f"o{k}").asc_nulls_first() for k in range(len(order))] if order else [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, estimated_bytes(docs) // TASK_BYTES))
    own = own.repartitionByRange(tasks, *by).sortWithinPartitions(*by).select("doc_id", "text")

    def segments(batches):
        from pyspark import TaskContext

        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        held, counts, doc_ids = [], [], []

        def flush():
            nonlocal segment, first, held, counts, doc_ids
            ids, n = np.concatenate(held), np.concatenate(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([[y for x in doc_ids for y in x]], pa.list_(pa.int64())), pa.array([np.cumsum(n)], pa.list_(pa.int64())), pa.array([dac_encode(ids)], pa.binary())],
                names=["shard", "segment", "first", "doc_ids", "ends", "codes"],
            )
            segment, first, held, counts, doc_ids = segment + 1, first + len(ids), [], [], []
            return out

        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in spans_of(sizes, STEP):
                ids, n = encoded(texts[a:b], vocabulary)
                upto = np.cumsum(n)
                held.append(np.insert(ids, upto, end_id).astype(np.uint32))
                counts.append(n + 1)
                doc_ids.append(names[a:b].to_pylist())
                if sum(map(len, held)) >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    # codes lie in the files as they are, one page for each segment
    own.mapInArrow(segments, _SEGMENTS).write.options(**RAW).parquet(path)
    return read_segments(spark, path)


def read_segments(spark, path: str) -> DataFrame:
    return spark.read.schema(_SEGMENTS).parquet(path)


def bases(segments: DataFrame) -> DataFrame:
    """of, base: the number of ids before each shard."""
    totals = segments.groupBy("shard").agg(F.max(F.col("first") + F.element_at("ends", -1)).alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def tokens_at(segments: DataFrame, positions: DataFrame) -> DataFrame:
    """positions: position (long, counted over all shards). position, doc_id, token of those that exist: each is found in its segment's codes without decoding them."""

    def picked(batches):
        for batch in batches:
            out = [[], [], []]
            for row, codes in zip(batch.select(["doc_ids", "ends", "at", "start"]).to_pylist(), batch.column("codes"), strict=True):
                code, ends = Dac(codes.as_buffer()), np.array(row["ends"], np.int64)
                for at in row["at"]:
                    out[0].append(row["start"] + at), out[1].append(row["doc_ids"][int(np.searchsorted(ends, at, "right"))]), out[2].append(code[at])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["position", "doc_id", "token"])

    start = (F.col("base") + F.col("first")).alias("start")
    held = segments.join(F.broadcast(bases(segments)), F.col("shard") == F.col("of"))  # a row for each shard
    directory = held.select("shard", "segment", start, (F.col("base") + F.col("first") + F.element_at("ends", -1)).alias("end"))
    # positions and segments meet by ranges of SEGMENT_IDS, of which a segment touches a few
    directory = directory.withColumn("range", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_IDS), F.floor((F.col("end") - 1) / SEGMENT_IDS))))
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct()
    found = wanted.join(directory, (F.floor(F.col("position") / SEGMENT_IDS) == F.col("range")) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("end")))
    found = found.groupBy("shard", "segment", "start").agg(F.collect_list(F.col("position") - F.col("start")).alias("at"))  # places of one segment
    found = found.withColumnsRenamed({"shard": "s", "segment": "g"})
    rows = segments.join(found, (F.col("shard") == F.col("s")) & (F.col("segment") == F.col("g"))).select("doc_ids", "ends", "at", "start", "codes")
    return rows.mapInArrow(picked, "position long, doc_id long, token long")


def read_tokens(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from the files."""
    fields = "shard int, doc_id long, begin long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Dac(row["codes"]).all().astype("<u4")
                ends = np.array(row["ends"], np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                view = memoryview(ids).cast("B")
                columns = [pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(begin + row["first"]), pa.array(ends - begin), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin, ends, strict=True)], pa.int64())]
                names = ["shard", "doc_id", "begin", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(begin, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    totals = bases(segments)
    out = segments.mapInArrow(documents, fields).join(F.broadcast(totals), F.col("shard") == F.col("of"))  # a row for each shard
    return out.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_table(docs: DataFrame, vocabulary: str, end_id: int = 2, order: list[Column] | None = None) -> DataFrame:
    """Writes the files into shared storage and reads every document back from them."""
    return read_tokens(write_tokens(docs, shared_dir(docs.sparkSession, "tokens"), vocabulary, end_id, order))
