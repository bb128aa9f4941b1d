"""Shared pieces: table loading, reliable checkpoints, byte kernels, distributed components."""

from __future__ import annotations

import codecs
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import share_code, shared_folder

#: Bytes of text that a numpy kernel takes at once (one longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where that is unset and the session is local (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or shared_folder(spark, "checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of df, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows and bytes of an Arrow batch, at most: texts of some kilobytes then make batches of some megabytes on both sides; a longer text is one alone.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS and BATCH_BYTES where they are larger; it holds for Python stages of this session from then on."""
    share_code(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Gives memory that Python no longer uses back to the system: workers wait for later tasks with what they once took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, ends the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- bytes


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEED = np.arange(1, 4097, dtype=np.uint64)
BYTE_CODE = mix64(_SEED[:256] * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) in rows offsets[0]..offsets[-1]; first word of each row; words per row."""
    base = int(offsets[0])
    data, rel = LOWER[raw[base : int(offsets[-1])]], (offsets - base)
    rows = len(rel) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = rel[:-1][(rel[:-1] < rel[1:])]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    before = np.searchsorted(starts, rel[:-1], "left")
    counts = np.searchsorted(starts, rel[1:], "left") - before
    at = np.arange(len(data), dtype=np.int64)
    place = at - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place[: starts[0]] = 0
    np.minimum(place, len(data), out=place)
    power = powers(0x9FB21C651E98DF25, int(place.max()) + 1)
    code = BYTE_CODE[data] * power[place]
    code[~inside] = 0
    return mix64(np.add.reduceat(code, starts)), before, counts


#: Code points of one word, at most: a longer run without white space is several words of this length.
WORD_POINTS = 1 << 16
_BREAKS = np.array([c for c in range(0x3001) if chr(c).isspace()])


def is_space(points: np.ndarray) -> np.ndarray:
    """White space by Unicode."""
    out = (points <= 32) & (((points >= 9) & (points <= 13)) | (points >= 28))
    high = np.flatnonzero(points >= 0x85)
    if len(high):
        out[high] = np.isin(points[high], _BREAKS)
    return out


class WordBlock:
    """Words of some rows, or of a part of one long row.

    points: code points, each row ended by a blank; start, stop: places of the words; row: the row of each; key: a hash of each; follows: the first word comes
    right after the last word of the block before; first: place of each row's first code point.
    """

    def __init__(self, points: np.ndarray, rows: np.ndarray, first: np.ndarray, follows: bool):
        self.points, self.first, self.follows = points, first, follows
        gap = is_space(points)
        begin = ~gap
        begin[1:] &= gap[:-1]
        start = np.flatnonzero(begin)
        ends = np.flatnonzero(gap)
        stop = ends[np.searchsorted(ends, start)] if len(start) else start
        if len(start) and int((stop - start).max()) > WORD_POINTS:
            parts = -(-(stop - start) // WORD_POINTS)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            last = np.repeat(stop, parts)
            start = np.repeat(start, parts) + nth * WORD_POINTS
            stop = np.minimum(last, start + WORD_POINTS)
        self.start, self.stop = start, stop
        self.row = rows[np.searchsorted(first, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
        width = stop - start
        if len(start):
            heads = np.zeros(len(points), np.int32)
            heads[start] = 1
            place = np.arange(len(points)) - start[np.maximum(np.cumsum(heads) - 1, 0)]
            code = mix64(points.astype(np.uint64) + np.uint64(7)) * powers(0x9FB21C651E98DF25, int(width.max()) + 1)[np.clip(place, 0, int(width.max()))]
            code[gap] = 0
            self.key = mix64(np.add.reduceat(code, start) + width.astype(np.uint64))
        else:
            self.key = np.zeros(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words as one array of code points with a mark (0x20) before and after each; where each begins in it (its first mark) and its length
        without marks; and the distinct word of each word."""
        _, one, which = np.unique(self.key, return_index=True, return_inverse=True)
        size = self.stop[one] - self.start[one]
        at = np.concatenate([[0], np.cumsum(size + 2)])
        inner = np.arange(int(at[-1])) - np.repeat(at[:-1], size + 2) - 1
        flat = np.full(int(at[-1]), 32, np.uint32)
        real = (inner >= 0) & (inner < np.repeat(size, size + 2))
        flat[real] = self.points[(inner + np.repeat(self.start[one], size + 2))[real]]
        return flat, at[:-1], size, which


def word_blocks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[WordBlock]:
    """Blocks of about limit bytes of the texts of a column; null counts as empty. A longer text comes in several blocks, cut between words."""
    raw, off = text_bytes(column)
    for a, b in chunks(off, limit):
        if off[b] - off[a] <= limit:
            texts = [raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(a, b)]
            size = np.array([len(t) + 1 for t in texts], np.int64)
            points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
            yield WordBlock(points, np.arange(a, b), np.cumsum(size) - size, False)
            continue
        decoder, carry, follows = codecs.getincrementaldecoder("utf-8")("replace"), "", False
        for s in range(int(off[a]), int(off[b]), limit):
            last = s + limit >= off[b]
            piece = carry + decoder.decode(raw[s : min(s + limit, int(off[b]))].tobytes(), last)
            points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
            cut = len(points)
            if not last:
                gaps = np.flatnonzero(is_space(points))
                begun = int(gaps[-1]) + 1 if len(gaps) else 0
                cut = begun + (cut - begun) // WORD_POINTS * WORD_POINTS  # whole words, and whole parts of one that goes on
            carry = piece[cut:]
            if cut:
                yield WordBlock(np.append(points[:cut], np.uint32(32)), np.array([a]), np.zeros(1, np.int64), follows)
                follows = True


#: Odd multipliers of the places of a shingle.
_PLACE = mix64(_SEED[1024:1088]) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its width-word shingles; a shorter row's whole sequence counts as one; no words: empty."""
    words, before, counts = words_of(raw, offsets)
    out: list[np.ndarray] = []
    if len(words) >= width:
        full = words[: len(words) - width + 1] * _PLACE[0]
        for j in range(1, width):
            full = full + words[j : len(words) - width + 1 + j] * _PLACE[j]
        full = mix64(full + np.uint64(width))
    for b, n in zip(before.tolist(), counts.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(full[b : b + n - width + 1]))
        elif n:
            out.append(mix64(np.array([np.sum(words[b : b + n] * _PLACE[:n], dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> int:
    """64-bit digest of a set of hashes as a signed long; 0 for the empty set."""
    if not len(s):
        return 0
    d = int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)))) + 3 * int(np.sum(s, dtype=np.uint64)) + len(s)
    return int(mix64(np.array([d & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0]) or 1


# ---------------------------------------------------------------- components


class Forest:
    """Union-find over local indices; the root of a tree is its smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n, dtype=np.int64)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up, nxt := up[up]):
            up = nxt
        self.up = up
        return up


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the same components as the edges (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)].copy(), at[len(a) :].copy()
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_a, kept_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in batches:
        kept_a, kept_b = spanning(np.concatenate([kept_a, x.column(0).to_numpy()]), np.concatenate([kept_b, x.column(1).to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(kept_a), pa.array(kept_b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) -> (id, component_id = smallest id reachable); only ids with an edge.

    Each partition first shrinks its edges to spanning stars. Then labels go to neighbours (a map-side-combined minimum, so a
    hub is no hot group) and pointers are halved, round after round, until none changes. Each round ends in a checkpoint.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = cut(e.mapInArrow(_span_batches, "a long, b long"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        hooked = label.join(near, "id").select("id", "c", F.least("c", "m").alias("m"))
        jump = label.select(F.col("id").alias("m"), F.col("c").alias("mc"))
        new = cut(hooked.join(jump, "m").select("id", F.least("m", "mc").alias("c"), (F.least("m", "mc") != F.col("c")).alias("moved")))
        label = new.select("id", "c")
        if not new.where("moved").take(1):
            return label.select("id", F.col("c").alias("component_id"))


def stored(df: DataFrame) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: a checkpoint of which later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _packer(at: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for x in batches:
            packed = pa.array([None if t is None else pack.compress(t.encode()) for t in x.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*x.columns[:at], packed, *x.columns[at + 1 :]], names)

    return rows


def _unpacker(at: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for x in batches:
            texts = pa.array([None if z is None else unpack.decompress(z).decode() for z in x.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*x.columns[:at], texts, *x.columns[at + 1 :]], names)

    return rows


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """df with a text column compressed to binary, for a shuffle that carries whole rows."""
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if i == at else f.dataType) for i, f in enumerate(df.schema)])
    return df.mapInArrow(_packer(at, df.columns), schema)


def unpacked(df: DataFrame, column: str = "text") -> DataFrame:
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.StringType() if i == at else f.dataType) for i, f in enumerate(df.schema)])
    return df.mapInArrow(_unpacker(at, df.columns), schema)
