"""Operator 13, phrase collocations: word sequences that come more often together than their parts apart let expect, by language.

1. Tasks hash every word and phrase of their texts into count-min sketches, one for each phrase length, and hand on cells in compressed blocks of 2^16; a block's rows are
   added up as they stream by, sorted. What is left is a bit a cell: can a phrase of this cell reach min_count? These bit maps are broadcast; their size is fixed by
   the number of cells, at most 2^MAX_BITS a map.
2. In a second pass a task names the words and phrases of its texts whose cells all allow it and whose shorter parts are named too. A sketch only errs upwards, so none is
   missed. When those of some texts come to about SHARD_BYTES, each language's are compiled into an automaton, a shard, which counts all overlapping matches in the same
   texts: a text meets the patterns that occur in it and no others, once. Patterns and texts have a blank before and after each word, so matches are whole words; ends of
   pieces stand between blanks as well.
3. Counts of shards are handed on in compressed blocks by a hash of the phrase, and a block's rows are added up as they stream by, sorted. Phrases that reach min_count stay.
4. Thresholds, scores in exact decimals, the rule for parts of longer phrases and ranks are joins, groupings and windows.

Texts are taken as UTF-8 bytes. Long texts come in blocks that repeat the last words of the block before, whose phrases are then counted once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, mix64, small_batches, stored, table, text_bytes, trim, words_of

MIN_COUNT, MAX_WORDS, TOP, PERCENT = 10, 3, 2000, 50
#: Bytes of patterns of one shard: an automaton takes some 13 times as much.
SHARD_BYTES = 16 << 20
#: Sketch rows a phrase length; the least and the largest number of cells a row, as a power of two. A bit map has that many bits.
ROWS, MIN_BITS, MAX_BITS = 2, 16, 27
BLOCK_BITS = 16
#: Cells that a task holds before it counts and hands them on.
HELD = 3 << 20
#: Distinct phrases that a shard remembers as its patterns.
REMEMBERED = 1 << 20
#: Blocks that a language's phrases are handed on in, a power of two.
BUCKETS = 512

_CLASS = bytearray(range(256))
for _c in range(65, 91):
    _CLASS[_c] += 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _CLASS[_c] = 10
_CLASS[9] = 32
_CLASS = bytes(_CLASS)
_PLACE = mix64(np.arange(2048, 2048 + 16, dtype=np.uint64)) | np.uint64(1)


def normal(raw: bytes) -> bytes:
    """Texts with one blank before and after each word and each end of a piece, which is a line feed."""
    out = b" " + raw.translate(_CLASS).replace(b"\n", b" \n ") + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def passages(data: bytes, words: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(block, seen): parts of a normal text of about limit bytes, cut at ends of pieces, or else between words; then the first seen bytes repeat the last words of the
    block before."""
    at, seen = 0, 0
    while len(data) - at > 2 * limit:
        end = data.rfind(b"\n", at + seen, at + limit)
        if end > at + seen:
            yield data[at:end], seen
            at, seen = end + 1, 0
            continue
        end = data.rfind(b" ", at + seen, at + limit)
        if end <= at + seen:
            end = data.find(b" ", at + max(seen, limit))
            if end < 0:
                break
        yield data[at : end + 1], seen
        back = end
        for _ in range(words):
            back = max(at, data.rfind(b" ", at, back)) if back > at else at
        back = max(back, data.rfind(b"\n", at, end) + 1)
        at, seen = back, end + 1 - back
    yield data[at:], seen


def by_language(batches: Iterator[pa.RecordBatch], words: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[str, bytes, int]]:
    """(lang, block, seen) of batches (lang, text); texts of a language are joined up to the limit, as pieces of their own."""
    for x in batches:
        raw, off = text_bytes(x.column(1))
        langs: dict[str, list[int]] = {}
        for k, lang in enumerate(x.column(0).to_pylist()):
            langs.setdefault(lang, []).append(k)
        for lang, rows in langs.items():
            held, size = [], 0
            for k in rows:
                held.append(raw[off[k] : off[k + 1]].tobytes())
                size += len(held[-1])
                if size >= limit:
                    for part in passages(normal(b"\n".join(held)), words, limit):
                        yield (lang, *part)
                    held, size = [], 0
            if size:
                for part in passages(normal(b"\n".join(held)), words, limit):
                    yield (lang, *part)
    trim()


class Grams:
    """Words of a block and the hashes of its phrases. start: place of each word; left: words to the end of its piece, itself included; first: number of repeated words."""

    def __init__(self, lang: str, data: bytes, seen: int):
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10)
        self.hash, _, counts = words_of(raw, np.concatenate([[0], ends, [len(raw)]]).astype(np.int64))
        self.raw, blank = data, (raw == 32) | (raw == 10)
        self.start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1 if len(raw) > 1 else np.zeros(0, np.int64)
        self.stop = np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, [len(raw)] * (len(raw) > 0 and not blank[-1])).astype(np.int64)
        last = np.cumsum(counts)
        self.left = np.repeat(last, counts) - np.arange(len(self.hash))
        self.first = int(np.searchsorted(self.start, seen)) if seen else 0
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))

    def new_words(self) -> int:
        return len(self.hash) - self.first

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that begin a phrase of k words which does not lie in what is repeated, and the phrases' hashes."""
        at = np.flatnonzero(self.left[max(0, self.first - k + 1) :] >= k) + max(0, self.first - k + 1)
        h = np.full(len(at), self.seed + np.uint64(k), np.uint64)
        for j in range(k):
            h += self.hash[at + j] * _PLACE[j]
        return at, mix64(h)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The bytes of the phrases of k words that begin at some words."""
        begin, size = self.start[at], self.stop[at + k - 1] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(self.raw, np.uint8)[np.repeat(begin - offsets[:-1], size) + np.arange(int(offsets[-1]))]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class Seen:
    """Hashes that have been seen: a large sorted array and a small one, which is merged into it as it grows. Over REMEMBERED it starts anew."""

    def __init__(self):
        self.large, self.small = np.zeros(1, np.uint64), np.zeros(1, np.uint64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Which of the distinct hashes are new; they are seen from now on."""
        out = np.ones(len(h), bool)
        for known in (self.large, self.small):
            out &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
        self.small = np.sort(np.concatenate([self.small, h[out]]))
        if len(self.small) > max(1 << 15, len(self.large) // 4):
            self.large, self.small = np.sort(np.concatenate([self.large, self.small])) if len(self.large) < REMEMBERED else self.small, np.zeros(1, np.uint64)
        return out


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each sketch row."""
    return [((h >> np.uint64(32 * r)) & np.uint64((1 << bits) - 1)).astype(np.uint32) for r in range(ROWS)]


_SKETCH = "level int, row int, block int, cells binary, counts binary"


def _sketch_rows(bits: int, most: int, words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        held: dict[tuple[int, int], list[np.ndarray]] = {(k, r): [] for k in range(1, words + 1) for r in range(ROWS)}

        def flush() -> Iterator[pa.RecordBatch]:
            for (k, r), parts in held.items():
                if not parts:
                    continue
                cell, n = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                n = np.minimum(n, most).astype(np.uint8)
                block, begin = np.unique(cell >> BLOCK_BITS, return_index=True)
                stop = np.append(begin[1:], len(cell))
                low = (cell & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(block), k, np.int32)), pa.array(np.full(len(block), r, np.int32)), pa.array(block.astype(np.int32)),
                     pa.array([pack.compress(low[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary()),
                     pa.array([pack.compress(n[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())],
                    ["level", "row", "block", "cells", "counts"])

        size = 0
        for lang, data, seen in by_language(batches, words - 1):
            grams = Grams(lang, data, seen)
            for k in range(1, words + 1):
                _, h = grams.of(k)
                if len(h):
                    for r, c in enumerate(cells(h, bits)):
                        held[k, r].append(c)
                    size += len(h)
            if size >= HELD:
                yield from flush()
                size = 0
        yield from flush()
        trim()

    return rows


def _merge_rows(most: int):
    """Adds up the rows of a block, which come one after the other, and yields which of its cells reach most, as bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in key] + [pa.array([np.packbits(total >= most).tobytes()], pa.binary())], ["level", "row", "block", "bits"])

        for x in batches:
            for level, row, block, cell, n in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if (level, row, block) != key:
                    if key is not None:
                        yield done()
                    key, total[:] = (level, row, block), 0
                total[np.frombuffer(unpack.decompress(cell), np.uint16)] += np.frombuffer(unpack.decompress(n), np.uint8)
        if key is not None:
            yield done()

    return rows


class Sketch:
    """Bit maps of the cells that reach the count, by phrase length and sketch row."""

    def __init__(self, bits: int, words: int):
        self.bits = bits
        self.maps = {(k, r): np.zeros(1 << (bits - 3), np.uint8) for k in range(1, words + 1) for r in range(ROWS)}

    def put(self, level: int, row: int, block: int, bits: bytes) -> None:
        size = 1 << (BLOCK_BITS - 3)
        self.maps[level, row][block * size : (block + 1) * size] = np.frombuffer(bits, np.uint8)

    def allows(self, h: np.ndarray, k: int) -> np.ndarray:
        out = np.ones(len(h), bool)
        for r, c in enumerate(cells(h, self.bits)):
            out &= (self.maps[k, r][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out


def sketch_of(texts: DataFrame, words: int, least: int) -> Sketch:
    """texts: (lang, text)."""
    size = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(max(1, size / 16)))))
    most = min(least, 255)
    rows = texts.mapInArrow(_sketch_rows(bits, most, words), _SKETCH)
    merged = rows.repartition("level", "row", "block").sortWithinPartitions("level", "row", "block").mapInArrow(_merge_rows(most), "level int, row int, block int, bits binary")
    sketch = Sketch(bits, words)
    for r in merged.toLocalIterator():  # at most words * ROWS * 2^(bits - 16) rows of 8 KB
        sketch.put(r["level"], r["row"], r["block"], r["bits"])
    return sketch


class Shard:
    """Texts of one language and the patterns of their automaton: each phrase that the sketch names in them, whole words with a blank before and after."""

    def __init__(self):
        self.blocks: list[tuple[str, int]] = []
        self.patterns: list[str] = []
        self.buckets: list[np.ndarray] = []
        self.met, self.words = Seen(), 0

    def add(self, lang: str, data: bytes, seen: int, sketch: Sketch, words: int) -> int:
        """Takes a block and names its phrases of 1 to words words; the bytes of the patterns that are new."""
        grams, text, size = Grams(lang, data, seen), data.decode("latin-1"), 0
        self.blocks.append((text, seen))
        self.words += grams.new_words()
        named = np.ones(len(grams.hash) + 1, bool)  # does the phrase of k - 1 words that begins here stand a chance?
        for k in range(1, words + 1):
            at, h = grams.of(k)
            ok = sketch.allows(h, k)
            if grams.first == 0:  # at the seam of blocks the shorter parts may lie in what is repeated
                if k > 1:
                    ok &= named[at] & named[at + 1]
                named[:] = False
                named[at[ok]] = True
            h, one = np.unique(h[ok], return_index=True)
            fresh = self.met.new(h)
            at = at[ok][one][fresh]
            begin, stop = grams.start[at] - 1, grams.stop[at + k - 1] + 1
            self.patterns += [text[i:j] for i, j in zip(begin.tolist(), stop.tolist(), strict=True)]
            self.buckets.append((h[fresh] & np.uint64(BUCKETS - 1)).astype(np.int32))
            size += int((stop - begin).sum())
        return size

    def counted(self, lang: str) -> pa.RecordBatch:
        """All overlapping matches in the texts, added up by pattern: a row for each bucket of phrases, and a row of bucket -1 with the number of words."""
        counts = np.zeros(len(self.patterns), np.int64)
        if self.patterns:
            made = ahocorasick.Automaton()
            for k in np.argsort(np.array(self.patterns, object), kind="stable").tolist():  # neighbours in the trie then lie together in memory
                made.add_word(self.patterns[k], k)
            made.make_automaton()
            for text, seen in self.blocks:
                hits = made.iter(text)
                # a match that ends in what is repeated was counted there
                which = np.fromiter(map(itemgetter(1), hits) if not seen else (k for end, k in hits if end >= seen), np.int64)
                counts += np.bincount(which, minlength=len(counts))
        bucket = np.concatenate([*self.buckets, np.zeros(0, np.int32)])
        hit = np.flatnonzero(counts)
        hit = hit[np.argsort(bucket[hit], kind="stable")]
        phrases = [self.patterns[k][1:-1] for k in hit.tolist()]
        size = np.fromiter(map(len, phrases), np.int32, len(phrases))
        data, ends = "".join(phrases).encode("latin-1"), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        names, begin = np.unique(bucket[hit], return_index=True)
        begin, pack = np.append(begin, len(hit)).tolist(), zstandard.ZstdCompressor(level=1)
        parts = list(zip(begin[:-1], begin[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(names) + 1), pa.string()), pa.array([*names.tolist(), -1], pa.int32()), pa.array([0] * len(names) + [self.words], pa.int64()),
             pa.array([pack.compress(data[ends[i] : ends[j]]) for i, j in parts] + [None], pa.binary()),
             pa.array([pack.compress(size[i:j].tobytes()) for i, j in parts] + [None], pa.binary()),
             pa.array([pack.compress(counts[hit[i:j]].tobytes()) for i, j in parts] + [None], pa.binary())],
            ["lang", "bucket", "words", "phrases", "sizes", "counts"])


_COUNTED = "lang string, bucket int, words long, phrases binary, sizes binary, counts binary"


def _count_rows(shared, words: int, shard_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Sketch = shared.value
        shards: dict[str, Shard] = {}
        patterns = texts = 0
        for lang, data, seen in by_language(batches, words - 1):
            patterns += shards.setdefault(lang, Shard()).add(lang, data, seen, sketch, words)
            texts += len(data)
            if patterns >= shard_bytes or texts >= 4 * shard_bytes:
                while shards:
                    name, shard = shards.popitem()
                    yield shard.counted(name)
                patterns = texts = 0
        while shards:
            name, shard = shards.popitem()
            yield shard.counted(name)
        trim()

    return rows


def _sum_rows(least: int):
    """Adds up the rows of a bucket of a language, which come one after the other, and yields its phrases that reach least, and the number of words as of a null phrase."""

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("phrase").aggregate([("f", "sum")]).select(["phrase", "f_sum"]).rename_columns(["phrase", "f"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, held, n, most, total = None, [], 0, HELD, 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = added(held)
                t = t.filter(pc.greater_equal(t.column("f"), least)).combine_chunks()
                for x in t.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(x), pa.string()), x.column(0), x.column(1)], ["lang", "phrase", "f"])
            if key[1] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.nulls(1, pa.binary()), pa.array([total], pa.int64())], ["lang", "phrase", "f"])

        for x in batches:
            for lang, bucket, some, phrases, sizes, counts in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if (lang, bucket) != key:
                    if key is not None:
                        yield from done()
                    key, held, n, most, total = (lang, bucket), [], 0, HELD, 0
                if bucket < 0:
                    total += some
                    continue
                f = np.frombuffer(unpack.decompress(counts), np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.frombuffer(unpack.decompress(sizes), np.int32), dtype=np.int64)])
                names = pa.Array.from_buffers(pa.large_binary(), len(f), [None, pa.py_buffer(offsets), pa.py_buffer(unpack.decompress(phrases))])
                held.append(pa.table({"phrase": names.cast(pa.binary()), "f": f}))
                n += len(f)
                if n >= most:  # what is equal becomes one
                    held = [added(held)]
                    n = len(held[0])
                    most = max(HELD, 2 * n)
        if key is not None:
            yield from done()
        trim()

    return rows


def phrase_counts(texts: DataFrame, words: int, least: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, phrase, f): exact numbers of occurrences of all phrases of 1 to words words that come least times; and for each language a row of a null phrase with the
    number of its words."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch_of(texts, words, least))
    rows = texts.mapInArrow(_count_rows(shared, words, shard_bytes), _COUNTED)
    sums = rows.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_sum_rows(least), "lang string, phrase binary, f long")
    out = stored(sums.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"))
    shared.destroy()
    return out


def ranked(counts: DataFrame, totals: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """Thresholds, scores, parts of longer phrases and ranks. counts: (lang, phrase, f) with all parts of each phrase; totals: (lang, n)."""
    split = counts.where(F.col("f") >= min_count).withColumn("w", F.split("phrase", " ")).where("size(w) > 1")
    cut = F.sequence(F.lit(1), F.size("w") - 1)
    cuts = split.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(cut).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("c").alias("c"))
    begins = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    inner = split.where("size(w) > 2").select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "f", F.explode(F.array_distinct(F.transform(begins, lambda b: F.array_join(F.slice("w", b, F.col("m")), " ")))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = worst.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * a")
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, percent: int = PERCENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's best phrases: (lang, rank from 1, phrase, a, l, r, n, score).

    A null language counts as `und`, a null text as empty; an empty table, or one without a phrase that comes min_count times, gives no rows. Equal scores are ordered
    by a, then by the phrase's bytes, so there are no ties. A row that comes again counts again. Words have any length; counts up to 10^15 are exact. Other columns are
    not looked at.
    """
    if not 2 <= max_words <= len(_PLACE) or min_count < 1:
        raise ValueError("phrases have 2 to 16 words, counts begin at 1")
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.octet_length("text") > 0)
    counts = phrase_counts(texts, max_words, min_count, shard_bytes)
    totals = counts.where("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked(counts.where("phrase is not null"), totals, min_count, top, percent)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : CAST(i + k - 1 AS BIGINT)], ' '))) AS phrase FROM words, range(1, 4) t(k) WHERE len(w) >= k
  ) GROUP BY lang, k, phrase
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT u.lang, u.phrase, u.a, min(struct_pack(score := CAST((1000000 * CAST(u.a AS HUGEINT) * u.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT), cut := u.cut, l := l.f, r := r.f)) AS s
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : u.cut], ' ')
  JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[CAST(u.cut + 1 AS BIGINT) : u.k], ' ')
  GROUP BY u.lang, u.phrase, u.a
), inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, a AS f, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3
  ) GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
), ranks AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank, phrase, a, s.l AS l, s.r AS r, s.score AS score FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranks r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000
"""
