"""Vector bin packing of training examples into sequences under three limits at once: ids, segments and loss-bearing ids.

Every task packs the examples of its own partition, so nothing is shuffled. Whole runs of a long example that fill a sequence
become one at once; what is left of the examples waits in a pool of at most `POOL` items. A sequence is filled from the pool by the
dot-product heuristic: of the items that fit, the one whose vector (ids, segments, loss-bearing ids, each as a share of its limit)
has the largest product with the vector of what the sequence has left. Products are weighted by how much the pool asks of each limit. If none fits
and room is left, an item is cut. A sequence of documents that can't be filled, at the end of a partition or where the pool has only items
that other limits refuse, is cut back to a power of two, which needs no padding; what it loses returns to the pool.

Sequences are written by Spark (sequence_id, ids, segments), and read_pieces() reads them back.

Cases: a null text is an empty one and gets the end id alone; null doc_ids stay null; repeated rows are examples of their own; equal
products go to the item that came first; an empty table gives no rows; other columns are ignored. An example without ids takes no place.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from permlab.llm.common import pick, pieces, shared_dir
from permlab.llm.tokens import encoded

#: Items that wait in a task, at most.
POOL = 1024
_HOLE = 1 << 60
SEGMENTS = "array<struct<doc_id: long, start: long, length: long, doc_tokens: long>>"
_WRITTEN = f"sequence_id long, ids array<int>, segments {SEGMENTS}"


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    ids: int = 1024
    segments: int = 64
    loss: int = 1024

    def __post_init__(self):
        if min(self.ids, self.segments, self.loss) < 1:
            raise ValueError("a limit below 1 lets nothing in")


@dataclass
class Item:
    """A run of the ids of one example. loss: what of them bears a loss, as 0 and 1; bears: how many do."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    doc_tokens: int

    def __post_init__(self):
        self.bears = int(np.count_nonzero(self.loss))

    def cut(self, n: int) -> tuple[Item, Item]:
        return Item(self.doc_id, self.start, self.ids[:n], self.loss[:n], self.doc_tokens), Item(self.doc_id, self.start + n, self.ids[n:], self.loss[n:], self.doc_tokens)


def fitting(loss: np.ndarray, room: int, loss_room: int) -> int:
    """How many ids from the start fit into so much room."""
    if loss_room >= room:
        return min(room, len(loss))
    return min(room, len(loss), int(np.searchsorted(np.cumsum(loss[:room]), loss_room, "right")))


class Packer:
    """Takes examples one after another and gives sequences: lists of items within the limits."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL, trim: bool = True):
        self.limits, self.most, self.trim = limits, pool, trim
        self.caps = (limits.ids, limits.segments, limits.loss)
        self.items: list[Item | None] = []  # those taken out leave a hole, which is too long for any sequence
        self.size, self.loss, self.n, self.all_ids, self.all_loss = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0, 0

    def add(self, item: Item):
        """Yields what is full already."""
        while len(item.ids):
            n = fitting(item.loss, self.limits.ids, self.limits.loss)
            if len(item.ids) < self.limits.ids and n == len(item.ids):
                self._wait(item)
                break
            if n < self.limits.ids:  # more loss than a sequence takes: a part that others can join
                part, item = item.cut(max(1, n))
                self._wait(part)
                continue
            part, item = item.cut(n)
            yield [part]
        while self.n > self.most:
            yield self._filled()

    def rest(self):
        while self.n:
            yield self._filled()

    def _wait(self, item: Item) -> None:
        if len(self.items) == len(self.size):  # room for as many again, holes closed
            self.items = [x for x in self.items if x is not None]
            grown = max(64, 2 * len(self.items))
            self.size, self.loss = np.full(grown, _HOLE), np.zeros(grown, np.int64)
            self.size[: len(self.items)] = [len(x.ids) for x in self.items]
            self.loss[: len(self.items)] = [x.bears for x in self.items]
        k = len(self.items)
        item.ids, item.loss = item.ids.copy(), item.loss.copy()  # a long example's other ids needn't be held
        self.items.append(None)
        self._put(k, item)

    def _put(self, k: int, item: Item) -> None:
        self.items[k], self.size[k], self.loss[k] = item, len(item.ids), item.bears
        self.n, self.all_ids, self.all_loss = self.n + 1, self.all_ids + len(item.ids), self.all_loss + item.bears

    def _take(self, k: int) -> Item:
        item, self.items[k], self.size[k] = self.items[k], None, _HOLE
        self.n, self.all_ids, self.all_loss = self.n - 1, self.all_ids - len(item.ids), self.all_loss - item.bears
        return item

    def _filled(self) -> list[Item]:
        """One sequence of the pool's items."""
        caps, size, loss = self.caps, self.size, self.loss
        asked = (self.all_ids / caps[0], self.n / caps[1], self.all_loss / caps[2])
        left, out = list(caps), []
        while self.n and left[0] and left[1]:
            fits = np.flatnonzero((size <= left[0]) & (loss <= left[2]))
            if len(fits):
                # every item asks for one segment, so that part of the products is the same for all
                by_ids, by_loss = (asked[i] * left[i] / caps[i] / caps[i] for i in (0, 2))
                item = self._take(int(fits[(size[fits] * by_ids + loss[fits] * by_loss).argmax()]))
            else:
                n, k = max((fitting(self.items[i].loss, left[0], left[2]), -i) for i in self._longest())
                if not n:
                    break
                item, more = self._take(-k).cut(n)
                self._put(-k, more)
            out.append(item)
            left = [left[0] - len(item.ids), left[1] - 1, left[2] - item.bears]
        used = sum(len(x.ids) for x in out)
        return self._power_of_two(out, used) if self.trim and used < self.limits.ids else out

    def _longest(self) -> set[int]:
        """Items to cut: the longest, and that with the least loss for its length."""
        held = np.flatnonzero(self.size < _HOLE)
        return {int(held[self.size[held].argmax()]), int(held[(self.loss[held] / self.size[held]).argmin()])}

    def _power_of_two(self, out: list[Item], used: int) -> list[Item]:
        over = used - (1 << (used.bit_length() - 1))
        while over:
            item = out.pop()
            if len(item.ids) > over:
                item, more = item.cut(len(item.ids) - over)
                out.append(item)
                item = more
            over -= len(item.ids)
            self._wait(item)
        return out


def packed(batches, examples, limits: Limits, trim: bool):
    """For mapInArrow: examples(batch) gives the Items of a record batch; the sequences of a partition."""
    from pyspark import TaskContext

    packer, number = Packer(limits, trim=trim), TaskContext.get().partitionId() << 33
    held: list[list[Item]] = []

    def batch():
        nonlocal number
        items = [x for sequence in held for x in sequence]
        ends = np.cumsum([0] + [sum(len(x.ids) for x in s) for s in held])
        many = np.cumsum([0] + [len(s) for s in held])
        struct = pa.StructArray.from_arrays(
            [pa.array([x.doc_id for x in items], pa.int64()), pa.array([x.start for x in items], pa.int64()), pa.array([len(x.ids) for x in items], pa.int64()), pa.array([x.doc_tokens for x in items], pa.int64())],
            names=["doc_id", "start", "length", "doc_tokens"],
        )
        ids = pa.array(np.concatenate([x.ids for x in items]).astype(np.int32))
        out = [pa.array(np.arange(number, number + len(held))), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids), pa.ListArray.from_arrays(pa.array(many.astype(np.int32)), struct)]
        number += len(held)
        held.clear()
        return pa.RecordBatch.from_arrays(out, names=["sequence_id", "ids", "segments"])

    for b in batches:
        for item in examples(b):
            for sequence in packer.add(item):
                held.append(sequence)
                if len(held) == 1024:
                    yield batch()
    for sequence in packer.rest():
        held.append(sequence)
        if len(held) == 1024:
            yield batch()
    if held:
        yield batch()


def pack_documents(docs: DataFrame, path: str, vocabulary: str, limits: Limits = Limits(), end_id: int = 0) -> DataFrame:
    """Encodes every text, appends end_id, packs the ids and writes the sequences to the folder path. All ids bear a loss but the end id."""
    own = pick(docs, doc_id="long", text="string")

    def examples(batch):
        for part in pieces([batch], 1 << 20):
            ids, counts = encoded(part.column("text"), vocabulary)
            at = 0
            for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id).astype(np.uint32)
                yield Item(doc_id, 0, own, np.append(np.ones(n, np.int8), 0).astype(np.int8), n + 1)
                at += n

    own.mapInArrow(lambda batches: packed(batches, examples, limits, True), _WRITTEN).write.parquet(path)
    return read_sequences(docs.sparkSession, path)


def pack_examples(rows: DataFrame, path: str, limits: Limits = Limits()) -> DataFrame:
    """rows: doc_id, ids (array<int>), loss (array<int> of 0 and 1, as long; null: all bear a loss). Packs instruction data and writes it; sequences that a limit keeps short are left so."""
    own = pick(rows, doc_id="long", ids="array<int>", loss="array<int>")

    def examples(batch):
        for doc_id, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "loss")), strict=True):
            ids = np.array(ids or [], np.uint32)
            bears = np.ones(len(ids), np.int8) if loss is None else np.array(loss, np.int8)
            if len(bears) != len(ids):
                raise ValueError(f"example {doc_id} has {len(ids)} ids and {len(bears)} marks of loss")
            yield Item(doc_id, 0, ids, bears, len(ids))

    own.mapInArrow(lambda batches: packed(batches, examples, limits, False), _WRITTEN).write.parquet(path)
    return read_sequences(rows.sparkSession, path)


def read_sequences(spark, path: str) -> DataFrame:
    return spark.read.schema(_WRITTEN).parquet(path)


def read_pieces(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, from the sequences as written."""

    def rows(batches):
        for batch in batches:
            ids, segments = batch.column("ids"), batch.column("segments")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            parts = segments.flatten()
            length = parts.field("length").to_numpy(zero_copy_only=False)
            ends = np.cumsum(length)
            many = np.diff(segments.offsets.to_numpy())
            first = np.cumsum(many) - many
            begin = ends - length
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
            offset = begin - np.repeat(begin[first], many) if len(begin) else begin
            sequence = np.repeat(batch.column("sequence_id").to_numpy(zero_copy_only=False), many)
            yield pa.RecordBatch.from_arrays(
                [parts.field("doc_id"), parts.field("start"), parts.field("length"), pa.array(crc, pa.int64()), parts.field("doc_tokens"), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return sequences.mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, vocabulary: str, limits: Limits = Limits()) -> DataFrame:
    """Packs docs into shared storage and reads every piece back."""
    return read_pieces(pack_documents(docs, shared_dir(docs.sparkSession, "sequences"), vocabulary, limits))
