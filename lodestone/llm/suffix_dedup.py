"""Operator 10, removal of repeated byte strings by column-wise multi-document suffix sorting.

Every 400-byte string is keyed by an anchor, its 96-byte substring of the smallest hash (the leftmost of equals): equal strings have equal
anchors at equal places. The starts of one document with one anchor make a segment, so a document is a few overlapping segments.

1. Segments of one anchor that are equal as a whole repeat in all their strings; aggregates tell, no bytes move.
2. Of the rest, one segment of each kind goes to the group of its anchor. There all segments, aligned at the anchor, are taken column by column
   from the right: each round inserts one symbol per segment in front of the suffixes so far, stably re-sorts by it (the sorted symbols are the
   column's Burrows-Wheeler text) and updates the common prefixes of neighbours. A start whose suffix shares 400 bytes with a neighbour repeats.
3. Starts found are gathered by text and cut out.

Equal strings share the anchor and its place, so comparing the suffixes of one column is enough, and each round costs the number of segments
instead of all symbols so far. A group is held in bounded batches (anchors with very many kinds are cut into tiles, all pairs of tiles
being sorted), so columns stay in memory; no external files are needed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, CHUNK_BYTES, chunks, mix64, small_batches, stored, table, text_bytes, trim

LENGTH, ANCHOR = 400, 96
#: Kinds of segments of one anchor that one tile holds, and kinds that a group of anchors holds, about.
TILE, GROUP = 8192, 24_000
_MULT = mix64(np.arange(2000, 2016, dtype=np.uint64)) | np.uint64(1)


def _doubled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 32, 64 and 256 bytes and of ANCHOR bytes."""
    h, width, out = BYTE_CODE[data], 1, {}
    for i in range(8):
        if len(h) <= width:
            break
        h = h[:-width] * _MULT[i] + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
        if width in (32, 64, 256):
            out[width] = h
    if 64 in out and len(out[64]) > 64 and ANCHOR == 96:
        out[ANCHOR] = mix64(out[64][: len(out[32]) - 64] * _MULT[9] + out[32][64:])
    return out


def _segments(data: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor place, anchor hash, hash of the whole segment) of the rows of data."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < LENGTH:
        return none
    h = _doubled(data)
    key, span = h[ANCHOR], LENGTH - ANCHOR + 1
    packed = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    rows = -(-len(packed) // span) + 1
    grid = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    place = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = rel[1:] - rel[:-1]
    row = np.repeat(np.arange(len(size)), size)[:n]
    valid = np.flatnonzero(np.arange(n) + LENGTH <= rel[1:][row])
    if not len(valid):
        return none
    place, row = place[valid], row[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(valid))[1:] - 1
    lo, hi, place, row = valid[first], valid[last], place[first], row[first]
    size = hi - lo + LENGTH
    whole = h[256]
    g = mix64(whole[lo] * _MULT[10] + whole[hi + LENGTH - 256] * _MULT[11] + whole[lo + (size - 256) // 2] * _MULT[12] + size.astype(np.uint64))
    return row, lo, hi, place, mix64(key[place]), g


def _text_key(raw: np.ndarray, a: int, b: int) -> tuple[int, int]:
    d = hashlib.md5(raw[a:b].tobytes()).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


_SEGMENT = "t1 long, t2 long, lo int, hi int, p int, h long, g long, known boolean"


class Sightings:
    """How often a task has met each kind of segment, up to two: a table of fixed size, in which a later kind may take the place of an earlier one.

    What is forgotten only sends more rows to a group; what is remembered twice is known to repeat.
    """

    def __init__(self, bits: int = 20):
        self.kind, self.times = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int8)
        self.shift = np.uint64(64 - bits)

    def known(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Which of these segments come after two equal ones."""
        kind = mix64(h ^ mix64(g))
        uniq, inv, times = np.unique(kind, return_inverse=True, return_counts=True)
        slot = (uniq >> self.shift).astype(np.int64)
        before = np.where(self.kind[slot] == uniq, self.times[slot], 0)
        order = np.argsort(inv, kind="stable")
        nth = np.empty(len(kind), np.int64)
        nth[order] = np.arange(len(kind)) - np.repeat(np.cumsum(times) - times, times)
        self.kind[slot], self.times[slot] = uniq, np.minimum(before + times, 2)
        return nth + before[inv] >= 2


def _windows(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte) of chunks of rows; a row of over CHUNK_BYTES comes in windows that share LENGTH - 1 bytes, so that
    each of its strings is in one of them."""
    for a, b in chunks(off):
        first, last = int(off[a]), int(off[b])
        if last - first <= CHUNK_BYTES:
            yield a, b, first, last
            continue
        for s in range(first, max(last - LENGTH + 1, first + 1), CHUNK_BYTES):
            yield a, b, s, min(last, s + CHUNK_BYTES + LENGTH - 1)


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each text; a text that a task meets more than twice is passed over from then on, as two copies tell that it repeats.

    Of equal segments of one task the first two go to their group; the others are known to repeat and are dealt at random, so that a common
    passage does not make one large group.
    """
    met: dict[tuple[int, int], int] = {}
    sightings = Sightings()
    for x in batches:
        raw, off = text_bytes(x.column(0))
        of_long: tuple[int, tuple[int, int], bool] = (-1, (0, 0), True)
        for a, b, s, e in _windows(off):
            rel = np.clip(off[a : b + 1], s, e) - s
            row, lo, hi, place, h, g = _segments(raw[s:e], rel)
            if not len(row):
                continue
            keys = np.zeros((b - a, 2), np.int64)
            more = np.ones(b - a, bool)
            for i in np.unique(row).tolist():
                if of_long[0] == a:  # a later window of the same text
                    keys[i], more[i] = of_long[1:]
                    continue
                key = _text_key(raw, off[a + i], off[a + i + 1])
                keys[i] = key
                times = met.get(key, 0) + 1
                more[i] = times <= 2
                if times <= 2 and len(met) < 500_000:
                    met[key] = times
                if off[a + i + 1] - off[a + i] > CHUNK_BYTES:
                    of_long = (a, key, bool(more[i]))
            row, lo, hi, place, h, g = (v[more[row]] for v in (row, lo, hi, place, h, g))
            if not len(row):
                continue
            known = sightings.known(h, g)
            h = np.where(known, mix64(keys[row, 0].view(np.uint64) + lo.astype(np.uint64) + np.uint64(s)), h)
            start = off[a:b][row] - s
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row, 0]), pa.array(keys[row, 1])] + [pa.array((v - start).astype(np.int32)) for v in (lo, hi, place)] + [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(known)],
                ["t1", "t2", "lo", "hi", "p", "h", "g", "known"],
            )
    trim()


_KIND = "full boolean, first boolean, " + _SEGMENT


def _kind_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (h, g): marks segments that another equals as full, and one of each kind as first."""
    carry: pa.RecordBatch | None = None
    open_key: tuple[int, int] | None = None
    for x in batches:
        sure = x.filter(x.column(7))
        if len(sure):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(sure), bool)), pa.array(np.zeros(len(sure), bool)), *sure.columns], ["full", "first", *sure.schema.names])
            x = x.filter(pc.invert(x.column(7)))
        t = x if carry is None else pa.Table.from_batches([carry, x]).combine_chunks().to_batches()[0]
        carry = None
        h, g = t.column(5).to_numpy(), t.column(6).to_numpy()
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(h)))
        full, first = np.repeat(size > 1, size), new
        if open_key == (int(h[0]), int(g[0])):
            full[: size[0]], first[0] = True, False
        alone = size[-1] == 1 and not full[-1]
        open_key = None if alone else (int(h[-1]), int(g[-1]))
        if alone:  # the next batch tells
            carry, t, full, first = t.slice(len(h) - 1), t.slice(0, len(h) - 1), full[:-1], first[:-1]
        keep = full | first
        t = t.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([pa.array(full[keep]), pa.array(first[keep]), *t.columns], ["full", "first", *t.schema.names])
    if carry is not None:
        yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([True]), *carry.columns], ["full", "first", *carry.schema.names])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, key of the text, the text compressed): what shuffles of texts carry."""
    pack = zstandard.ZstdCompressor(level=3)
    for x in batches:
        raw, off = text_bytes(x.column(1))
        keys = np.array([_text_key(raw, off[k], off[k + 1]) for k in range(len(x))], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([pack.compress(raw[off[k] : off[k + 1]].tobytes()) for k in range(len(x))], pa.binary())], ["doc_id", "t1", "t2", "z"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor()
    for z in column.to_pylist():
        yield unpack.decompress(z)


def column_repeats(group: np.ndarray, segments: list[bytes], anchor: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each segment and each of its first starts[i] places: does the string of that length there also start elsewhere in its group?

    anchor: the place of the anchor in each segment. Returns a boolean matrix [segment, place].
    """
    n = len(segments)
    size = np.array([len(s) for s in segments])
    left, right = int(anchor.max()), int((size - anchor).max())
    columns = np.zeros((left + right, n), np.uint8)  # one column of the alignment after another
    for i, s in enumerate(segments):
        columns[left - anchor[i] : left - anchor[i] + size[i], i] = np.frombuffer(s, np.uint8)
    begin, end = left - anchor, left - anchor + size
    found = np.zeros((n, int(starts.max())), bool)
    order = np.argsort(group, kind="stable")
    of = group[order]
    apart = np.ones(n, bool)
    apart[1:] = of[1:] != of[:-1]  # the first of each group
    block = np.cumsum(apart) - 1
    head = np.flatnonzero(apart)
    common = np.zeros(n + 1, np.int64)  # common[i]: common prefix of the suffixes at i - 1 and i
    for x in range(left + right - 1, -1, -1):
        inside = (x < end[order]) & (x >= begin[order])
        symbol = np.where(inside, columns[x, order].astype(np.int64), 256)
        same = np.zeros(n, bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & ~apart[1:]
        mixed = ~same & ~apart
        if mixed.any():
            hot = np.zeros(len(head), bool)
            hot[block[mixed]] = True
            touched = np.flatnonzero(hot[block])
            moved = touched[np.argsort(block[touched] * 512 + symbol[touched], kind="stable")]
            # touched places keep their groups; within them suffixes with equal symbols keep their order
            new_symbol = symbol.copy()
            new_symbol[touched] = symbol[moved]
            from_place = np.arange(n)
            from_place[touched] = moved
            same = np.zeros(n, bool)
            same[1:] = (new_symbol[1:] == new_symbol[:-1]) & ~apart[1:]
            low = common[:n].copy()
            far = np.flatnonzero(same & (from_place != np.concatenate([[-1], from_place[:-1]]) + 1))
            if len(far):
                cuts = np.empty(2 * len(far), np.int64)
                cuts[::2], cuts[1::2] = from_place[far - 1] + 1, from_place[far] + 1
                reduced = np.minimum.reduceat(common, cuts)[::2]
            near = np.flatnonzero(same)
            low[near] = common[from_place[near]]
            if len(far):
                low[far] = reduced
            order, symbol = order[from_place], new_symbol
            common[:n] = low
        common[:n] = np.where(same & (symbol < 256), common[:n] + 1, 0)
        best = np.maximum(common[:n], common[1 : n + 1])
        hit = np.flatnonzero(best >= length)
        if len(hit):
            who = order[hit]
            at = x - begin[who]
            ok = (at >= 0) & (at < starts[who])
            found[who[ok], at[ok]] = True
    return found


def _group_repeats(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates(["h", "t1", "t2", "lo"])
    lo, hi, p = (rows[k].to_numpy().astype(np.int64) for k in ("lo", "hi", "p"))
    t1, t2 = rows["t1"].to_numpy(), rows["t2"].to_numpy()
    group = np.unique(rows["h"].to_numpy(), return_inverse=True)[1]
    data = rows["bytes"].tolist()
    out = []
    order = np.argsort(group, kind="stable")
    a = 0
    while a < len(order):  # batches of whole groups
        b = min(a + GROUP, len(order))
        while b < len(order) and group[order[b]] == group[order[b - 1]]:
            b += 1
        pick = order[a:b]
        found = column_repeats(group[pick], [data[i] for i in pick.tolist()], p[pick] - lo[pick], hi[pick] - lo[pick] + 1)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        who, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        k = pick[who]
        out.append(pd.DataFrame({"t1": t1[k], "t2": t2[k], "lo": (lo[k] + first).astype(np.int32), "hi": (lo[k] + last).astype(np.int32)}))
        a = b
    return pd.concat(out)


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, t1, t2, list of segments) -> a row per segment with its bytes; a text that comes again in the task is passed over."""
    seen: set[tuple[int, int]] = set()
    for x in batches:
        t1, t2, lists = x.column(1).to_numpy(), x.column(2).to_numpy(), x.column(3)
        parts, inner = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lo, hi, p, h, tile_u, tiles = (parts.field(k).to_numpy(zero_copy_only=False) for k in range(6))
        out = {k: [] for k in ("t1", "t2", "h", "lo", "hi", "p", "i", "j", "bytes")}
        for k, data in enumerate(_unpacked(x.column(0))):
            key = (int(t1[k]), int(t2[k]))
            if key in seen:
                continue
            if len(seen) < 500_000:
                seen.add(key)
            for m in range(inner[k], inner[k + 1]):
                text = data[lo[m] : hi[m] + LENGTH]
                mine, all_tiles = int(tile_u[m]), int(tiles[m])
                for other in range(all_tiles) if all_tiles > 1 else (mine,):
                    if all_tiles > 1 and other == mine:
                        continue
                    for name, v in zip(out, (*key, h[m], lo[m], hi[m], p[m], min(mine, other), max(mine, other), text), strict=True):
                        out[name].append(v)
                if len(out["h"]) > 5000:
                    yield _packed(out)
                    out = {k: [] for k in out}
        if out["h"]:
            yield _packed(out)


def _packed(out: dict) -> pa.RecordBatch:
    kinds = dict.fromkeys(("t1", "t2", "h"), pa.int64()) | dict.fromkeys(("lo", "hi", "p", "i", "j"), pa.int32()) | {"bytes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))


def removed_spans(lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by strings that start at lo..hi."""
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), (hi + length).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _finish(with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lists = x.column(2)
            got: list[list] = [[], [], [], [], [], []]
            for k, data in enumerate(_unpacked(x.column(1))):
                spans = []
                if lists[k].is_valid:
                    parts = lists[k].values
                    spans = removed_spans(parts.field(0).to_numpy().astype(np.int64), parts.field(1).to_numpy().astype(np.int64))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                for v, into in zip((len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_text else None, [{"start": a, "stop": b} for a, b in spans] if with_text else None), got, strict=True):
                    into.append(v)
            columns = [x.column(0), pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.int64()), pa.array(got[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns += [pa.array(got[4], pa.binary()), pa.array(got[5], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: (id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes and removed spans if with_text.

    Null text counts as empty: all zeros and the digest of no bytes. Texts under 400 bytes lose nothing. Copies, also under equal or null ids,
    are other places of the same strings. Texts of any length are taken in windows of CHUNK_BYTES. Other columns of docs are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = rows.where(F.octet_length("text") >= LENGTH)
    seg = long.select("text").mapInArrow(_segment_batches, _SEGMENT)
    kinds = stored(seg.repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(_kind_batches, _KIND))
    full = kinds.where("full").select("t1", "t2", "lo", "hi")
    firsts = kinds.where("first").select("h", "t1", "t2", "lo", "hi", "p")
    anchors = firsts.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    probes = firsts.join(anchors, "h").withColumn("tiles", F.ceil(F.col("kinds") / TILE).cast("int"))
    probes = probes.withColumn("tile", F.pmod(F.xxhash64("t1", "t2", "lo"), F.col("tiles")).cast("int"))
    wanted = probes.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi", "p", "h", "tile", "tiles")).alias("parts"))
    packed = "doc_id long, t1 long, t2 long, z binary"
    keyed = long.mapInArrow(_packed_texts, packed)
    cuts = keyed.join(wanted, ["t1", "t2"]).select("z", "t1", "t2", "parts").mapInArrow(_cut_segments, "t1 long, t2 long, h long, lo int, hi int, p int, i int, j int, bytes binary")
    groups = max(16, math.ceil((rows.count() or 1) / 4000))
    partial = cuts.groupBy(F.pmod(F.xxhash64("h"), F.lit(groups)).alias("k"), "i", "j").applyInPandas(_group_repeats, "t1 long, t2 long, lo int, hi int")
    found = full.unionByName(partial).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    last = rows.mapInArrow(_packed_texts, packed).join(found, ["t1", "t2"], "left").select("doc_id", "z", "found")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start: long, stop: long>>" if with_text else "")
    return last.mapInArrow(_finish(with_text), kind).withColumnRenamed("doc_id", id_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
