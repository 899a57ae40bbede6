"""Token ids in directly addressable codes.

A segment holds the ids of some documents. Each id is split into chunks of CHUNKS bits, lowest first; level
k holds the k-th chunk of every id that has so many, packed in order, and a bitmap that says which of these
ids go on to level k + 1. A rank directory per bitmap (set bits before every RANK_BITS bits) turns a place
on one level into the place on the next, so any token is read by one look at each level, without decoding
its neighbours.

A data set is a Parquet table of segments in ascending doc_id order: shard and segment numbers, the ids and
token counts of the documents, the ids before them in the shard, the ids on each level, and the codes of all
levels as one value. Executors can write to a shared store through Spark only, hence Parquet; but codes are
written without compression and in a file for each segment, so their bytes lie in the file as they
are. Reader finds a segment's place from the file's footer and then reads the few bytes that a token needs.

Defined cases: null text counts as empty (one end token); a very long text is one document of one segment; repeated
rows are written each for itself, in the order of their text; rows without doc_id come first; an empty table makes
a data set without segments; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import io
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import place_for, size_in_bytes, texts

CHUNKS = (8, 8, 8, 8)
RANK_BITS = 512
#: Tokens after which a segment ends, with the document at hand; bytes of input per shard; shards from which on they grow instead (the driver holds 16 bytes of each).
SEGMENT, SHARD_BYTES, MOST_SHARDS = 1 << 20, 16 << 20, 1 << 20
SCHEMA = StructType([
    StructField("shard", IntegerType()), StructField("segment", IntegerType()), StructField("before", LongType()), StructField("n_tokens", LongType()),
    StructField("doc_ids", ArrayType(LongType())), StructField("lengths", ArrayType(LongType())), StructField("sizes", ArrayType(LongType())), StructField("codes", BinaryType()),
])
#: A file per segment, values as they are.
WRITE = {"compression": "none", "parquet.enable.dictionary": "false", "maxRecordsPerFile": "1"}


def encode(ids) -> tuple[list[int], bytes]:
    """How many of an array of unsigned 32-bit ids are on each level, and the codes: chunks, bitmap and ranks of each level."""
    import numpy as np

    sizes, codes, rest = [], [], np.asarray(ids, np.uint32)
    for bits in CHUNKS:
        more = rest >> np.uint32(bits)
        on = more > 0
        per = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS), dtype=np.int64) if len(on) else np.empty(0, np.int64)
        sizes.append(len(rest))
        codes += [(rest & np.uint32((1 << bits) - 1)).astype(np.uint8).tobytes(), np.packbits(on, bitorder="little").tobytes(), (np.cumsum(per) - per).astype("<u4").tobytes()]
        rest = more[on]
        if not len(rest):
            break
    return sizes, b"".join(codes)


def places(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Where chunks, bitmap and ranks of each level begin in the codes; the last one is their end."""
    out, at = [], 0
    for n in sizes:
        out.append((at, at + n, at + n + -(-n // 8)))
        at = out[-1][2] + 4 * -(-n // RANK_BITS)
    return [*out, (at, at, at)]


def decode(sizes: list[int], codes: bytes):
    """All ids of a segment."""
    import numpy as np

    rest = np.empty(0, np.uint32)
    for n, bits, (chunks, bitmap, ranks) in reversed(list(zip(sizes, CHUNKS, places(sizes)))):
        ids = np.frombuffer(codes, np.uint8, n, chunks).astype(np.uint32)
        on = np.unpackbits(np.frombuffer(codes, np.uint8, ranks - bitmap, bitmap), count=n, bitorder="little").astype(bool)
        ids[on] |= rest << np.uint32(bits)
        rest = ids
    return rest


def token_at(sizes: list[int], read, place: int) -> int:
    """The id at a place of a segment, by one look at each level; read(at, n) gives bytes of the codes."""
    value, shift = 0, 0
    for bits, (chunks, bitmap, ranks) in zip(CHUNKS, places(sizes)):
        value |= read(chunks + place, 1)[0] << shift
        block = place // RANK_BITS
        marks = int.from_bytes(read(bitmap + block * RANK_BITS // 8, place // 8 + 1 - block * RANK_BITS // 8), "little")
        within = place - block * RANK_BITS
        if not marks >> within & 1:
            break
        place = int.from_bytes(read(ranks + 4 * block, 4), "little") + (marks & ((1 << within) - 1)).bit_count()
        shift += bits
    return value


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of every whole text, each followed by end_id, in ascending doc_id order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        from tessera.llm.tokens import byte_encoder

        encode_texts, end = byte_encoder(tokenizer), end_id.to_bytes(4, "little")
        arrow, shard, segment, before = to_arrow_schema(SCHEMA), TaskContext.get().partitionId(), 0, 0
        names, parts, lengths, held = [], [], [], 0

        def flush():
            nonlocal segment, before, held
            sizes, codes = encode(np.frombuffer(b"".join(parts), "<u4"))
            row = {"shard": shard, "segment": segment, "before": before, "n_tokens": held, "doc_ids": list(names), "lengths": list(lengths), "sizes": sizes, "codes": codes}
            segment, before, held = segment + 1, before + held, 0
            for x in (names, parts, lengths):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1))):
                ids += end
                names.append(doc_id)
                parts.append(ids)
                lengths.append(len(ids) // 4)
                held += len(ids) // 4
                if held >= SEGMENT:
                    yield flush()
        if names:
            yield flush()

    rows = texts(docs)
    shards = min(MOST_SHARDS, max(1, size_in_bytes(docs) // SHARD_BYTES))
    rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.options(**WRITE).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a data set."""
    return spark.read.schema(SCHEMA).parquet(path)


def bases(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Each shard and the ids of all shards before it; only one total per shard, of at most MOST_SHARDS, is gathered."""
    out, before = [], 0
    for total in read(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        out.append((total["shard"], before))
        before += total["n"]
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["sizes"], row["codes"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"]), pa.array(row["lengths"], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(bases(spark, path), "shard int, shard_base long")
    based = read(spark, path).join(F.broadcast(shards), "shard")
    return based.select("doc_ids", "lengths", "sizes", "codes", (F.col("shard_base") + F.col("before")).alias("base")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Ranges(io.RawIOBase):
    """A file of any store that Spark reaches, read by ranges; `taken` counts the bytes."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.stream, self.length, self.at, self.taken = system.open(place), system.getFileStatus(place).getLen(), 0, 0

    def get(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        self.taken += n
        return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.stream, n))

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = (0, self.at, self.length)[whence] + offset
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(n if n >= 0 else self.length, self.length - self.at))
        out = self.get(self.at, n) if n else b""
        self.at += n
        return out


class Reader:
    """Single tokens of a data set by their place in it, from the files alone.

    Which file holds a shard's segments is looked up once per shard by a query on narrow columns; of a file,
    the footer is read once; then a token takes a few small ranges.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.bases = spark, path, bases(spark, path)
        self.shards: dict[int, list] = {}
        self.files: dict[str, tuple] = {}

    def _segments(self, shard: int) -> list:
        if shard not in self.shards:
            rows = read(self.spark, self.path).where(F.col("shard") == shard).select("segment", "before", "n_tokens", "sizes", F.col("_metadata.file_path").alias("file"))
            self.shards[shard] = sorted(rows.collect())
        return self.shards[shard]

    def _file(self, name: str) -> tuple:
        import pyarrow.parquet as pq

        if name not in self.files:
            opened = Ranges(self.spark, name)
            self.files[name] = (opened, pq.ParquetFile(opened).metadata)
        return self.files[name]

    def token(self, place: int) -> int:
        """The id at a place (from 0) of the whole data set."""
        from bisect import bisect_right

        k = bisect_right([b for _, b in self.bases], place) - 1
        if place < 0 or k < 0:
            raise IndexError(place)
        shard, base = self.bases[k]
        segments = self._segments(shard)
        row = segments[bisect_right([s["before"] for s in segments], place - base) - 1]
        if place - base >= row["before"] + row["n_tokens"]:
            raise IndexError(place)
        opened, footer = self._file(row["file"])
        group = footer.row_group(0)
        column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == "codes")
        size = places(row["sizes"])[-1][0]
        begin = column.data_page_offset + column.total_compressed_size - size  # a file has one value of codes, at the end of its one page
        if footer.num_rows != 1 or int.from_bytes(opened.get(begin - 4, 4), "little") != size:
            raise ValueError(f"{row['file']} is not laid out as write() does")
        return token_at(row["sizes"], lambda at, n: opened.get(begin + at, n), place - base - row["before"])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """documents() of a data set of docs written to the shared folder."""
    path = place_for(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return documents(docs.sparkSession, path)
