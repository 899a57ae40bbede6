"""Best-fit packing with a bounded number of open bins.

Pieces arrive online. A fixed number of bins is open; a bitset has one bit per free space, so the fullest
open bin that still fits a piece is one shift and one lowest-bit away. If none fits and all places are taken,
the fullest open bin closes. Each task packs its own rows this way. The bins that a task leaves open are
then packed as items, largest first, by the same rule, GROUP tasks' leavings together, so that the space
lost does not depend on how many tasks there are.

Defined cases: null text counts as empty (one end token); only pieces longer than a sequence are cut; an
empty table gives no rows; repeated rows are packed each for itself; of bins with equal space the last one used
is taken; a very long text gives as many pieces as it needs; columns other than doc_id and text, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, texts

OPEN_BINS = 256
GROUP = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = "sequence_id long, offset long"


class BestFit:
    """Open bins of one capacity; place() gives the bins that closed."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins, self.count = capacity, open_bins, 0
        self.bits = 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.count -= 1
        return bin_

    def place(self, size: int, item) -> list[list]:
        """Adds (offset, item) to the fullest open bin that has room."""
        closed, fitting = [], self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count == self.open_bins:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.capacity, []
        bin_.append((self.capacity - free, item))
        free -= size
        if free:
            self.by_free.setdefault(free, []).append(bin_)
            self.bits |= 1 << free
            self.count += 1
        else:
            closed.append(bin_)
        return closed

    def rest(self):
        """(used, bin) of the bins still open."""
        for free, bins in sorted(self.by_free.items()):
            for bin_ in bins:
                yield self.capacity - free, bin_


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, open_bins: int) -> DataFrame:
    """Every piece with its place after the first pass: closed sequences, and open ones with how much they hold (used > 0)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.tokens import word_encoder

        encode = word_encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        pack, made, out = BestFit(capacity, open_bins), 0, []

        def close(bin_, used=0):
            nonlocal made
            out.extend((*item, (part << 32) + made, offset, used, part // GROUP) for offset, item in bin_)
            made += 1

        def flush():
            columns = list(zip(*out)) or [[]] * 9
            out.clear()
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 7)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used", "part"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for bin_ in pack.place(len(own) // 4, (doc_id, n, at // 4, len(own) // 4, zlib.crc32(own))):
                        close(bin_)
            yield flush()
        for used, bin_ in pack.rest():
            close(bin_, used)
        yield flush()

    return texts(docs).mapInArrow(run, f"{PIECE}, {PLACE}, used long, part long")


def repack(left: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Packs whole open bins, largest first within each group of tasks."""

    def run(batches):
        import pyarrow as pa

        pack, made, out, bin_rows, key, group = BestFit(capacity, open_bins), 0, [], [], None, 0

        def close(bin_):
            nonlocal made
            for offset, rows in bin_:
                out.extend((*row[:5], (1 << 62) + (group << 32) + made, offset + row[6]) for row in rows)
            made += 1

        def place():
            for bin_ in pack.place(bin_rows[0][7], list(bin_rows)) if bin_rows else ():
                close(bin_)
            bin_rows.clear()

        def finish():
            place()
            for _, bin_ in pack.rest():
                close(bin_)

        def flush():
            columns = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and row[8] != group:
                    finish()
                    pack, made = BestFit(capacity, open_bins), 0
                elif row[5] != key:
                    place()
                key, group = row[5], row[8]
                bin_rows.append(row)
            yield flush()
        if key is not None:
            finish()
        yield flush()

    dealt = left.repartition("part").sortWithinPartitions("part", F.desc("used"), "sequence_id", "offset")
    return dealt.mapInArrow(run, f"{PIECE}, {PLACE}")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    tokenizer: path of a vocabulary of the tokenizers library that drops white space (word_encoder says which).
    """
    first = materialize(pieces(docs, tokenizer, end_id, capacity, open_bins), "packing")
    closed = first.where("used = 0").drop("used", "part")
    return closed.unionByName(repack(first.where("used > 0"), capacity, open_bins))
