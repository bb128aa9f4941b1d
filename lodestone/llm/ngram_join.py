"""Operator 6, n-gram Jaccard self-join by prefix trees.

1. Each document becomes its set of five-word shingles (64-bit hashes); documents with equal sets form one class, so copies never meet as pairs.
2. Of three eighths of the hash space, shingles go, as packed arrays, to ranges of the hash, which tell how many of each document's occur elsewhere (df >= 2).
   A set that links misses at most a quarter of its shingles, so one that misses more in this share alone links with nothing; most documents end here.
3. The sets of the others are dealt whole in the same way, and come back with the df of each shingle. The global order of shingles is (df, hash). Classes that link share a shingle among the first n - ceil(0.75 n) + 1 of both (prefix bound); stars on
   those shingles give candidate components.
4. In a candidate component the sets, most common shingle first, go into a path-compressed trie. A set walks it once: overlaps of shared paths are
   computed once, subtrees are left when overlap + what can still come is under the need. Large components are cut into tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, chunks, components, cut, free_names, packed, set_digest, shingle_sets, small_batches, stored, table, text_bytes, trim, unpacked

PERCENT, WIDTH = 75, 5
#: Documents, and shingle entries, of one component that meet in one task, about (twice this for a pair of tiles; one set may be larger).
TILE, TILE_ENTRIES = 2048, 1_000_000
#: Shingle entries that one range of hashes holds, about.
RANGE_ENTRIES = 1_500_000
#: Entries of a block of documents, about.
BLOCK_ENTRIES = 500_000
#: A shingle in more sets of one block than this is known to be common: its df counts as this and its entries skip the count.
COMMON = 256
#: Eighths of the hash space that tell which documents can link at all.
PART = 3


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        raw, off = text_bytes(x.column(1))
        size, digest = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a, b in chunks(off):
            for i, s in enumerate(shingle_sets(raw, off[a : b + 1], WIDTH), a):
                size[i], digest[i] = len(s), set_digest(s)
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size), pa.array(digest), x.column(2)], ["doc_id", "n_shingles", "digest", "rid"])
    trim()


class Blocks:
    """Gathers sets to blocks and deals their entries to ranges of the hash, packed to eight bytes: six of the hash, two of the set's place in its block.

    part: of 8, the share of the hash space whose entries are dealt. A row of the block's own, its key beyond those of the ranges, holds what is
    known of its sets: id, size, entries in the share, and how many of these are so common in the block that they skip the count.
    """

    names = ("r", "block", "owner", "h", "hh", "hn", "id", "n", "s", "known")
    schema = "r int, block long, owner binary, h binary, hh binary, hn binary, id binary, n binary, s binary, known binary"

    def __init__(self, bits: int, part: int):
        self.bits, self.part, self.count = bits, part, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.sets, self.held = [], [], [], 0

    def add(self, ident: int, size: int, s: np.ndarray) -> bool:
        """True if the block is full."""
        s = s[(s >> np.uint64(61)) < self.part] if self.part < 8 else s
        self.ids.append(ident)
        self.sizes.append(size)
        self.sets.append(s)
        self.held += len(s)
        return self.held >= BLOCK_ENTRIES or len(self.ids) >= 60_000

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        ranges = 1 << self.bits
        block = ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32) + self.count
        self.count += 1
        s = np.array([len(x) for x in self.sets], np.int32)
        owner = np.repeat(np.arange(len(s), dtype=np.uint16), s)
        h = np.concatenate(self.sets)
        uniq, inv, times = np.unique(h, return_inverse=True, return_counts=True)
        heavy = times > COMMON
        common = heavy[inv]
        known = np.bincount(owner[common], minlength=len(s)).astype(np.int32)
        kept = h[common]
        rows: list[dict] = [{"r": ranges + block % ranges, "block": block, "id": np.array(self.ids, np.int64).tobytes(), "n": np.array(self.sizes, np.int32).tobytes(), "s": s.tobytes(), "known": known.tobytes(), "owner": owner[common].tobytes(), "h": kept.tobytes()}]
        owner, h = owner[~common], h[~common]
        r = ((h >> np.uint64(48)) & np.uint64(ranges - 1)).astype(np.uint16)
        order = np.argsort(r, kind="stable")
        owner, h, r = owner[order], h[order], r[order]
        low = h.view(np.uint16).reshape(-1, 4)[:, :3]
        edge = np.searchsorted(r, np.arange(ranges + 1))
        hh, hn = uniq[heavy], times[heavy].astype(np.int64)
        hr = ((hh >> np.uint64(48)) & np.uint64(ranges - 1)).astype(np.int64)
        for k in range(ranges):
            mine = hr == k
            if edge[k] < edge[k + 1] or mine.any():
                rows.append({"r": k, "block": block, "owner": owner[edge[k] : edge[k + 1]].tobytes(), "h": low[edge[k] : edge[k + 1]].tobytes(), "hh": hh[mine].tobytes(), "hn": hn[mine].tobytes()})
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in rows], pa.int32() if k == "r" else pa.int64() if k == "block" else pa.binary()) for k in self.names], list(self.names))


def _text_blocks(bits: int, part: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        blocks = Blocks(bits, part)
        for x in batches:
            raw, off = text_bytes(x.column(0))
            for a, b in chunks(off):
                for s in shingle_sets(raw, off[a : b + 1], WIDTH):
                    if len(s) and (d := set_digest(s)) not in seen:
                        if len(seen) < 200_000:
                            seen.add(d)
                        if blocks.add(d, len(s), s):
                            yield from blocks.flush()
                            trim()
        yield from blocks.flush()
        trim()

    return rows


def _set_blocks(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(bits, 8)
        for x in batches:
            for node, n, h in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                if blocks.add(node, n, np.frombuffer(h, np.uint64)):
                    yield from blocks.flush()
        yield from blocks.flush()
        trim()

    return rows


_COUNTED = "block long, owner binary, live binary, h binary, df binary, id binary, n binary, s binary, known binary"


def _counted(bits: int, whole: bool):
    """Of a range, what is live (df of two or more) in each block: how many entries of each set, or with `whole` the entries with their df."""
    ranges = 1 << bits

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = int(key[0])
        none = [None] * len(rows)
        if r >= ranges:
            h, df = none, none
            if whole:
                h = [_short(np.frombuffer(x, np.uint64), ranges).tobytes() for x in rows["h"]]
                df = [np.full(len(x) // 8, COMMON, np.int32).tobytes() for x in h]
            return pd.DataFrame({"block": rows["block"], "owner": rows["owner"], "live": none, "h": h, "df": df, "id": rows["id"], "n": rows["n"], "s": rows["s"], "known": rows["known"]})
        size = np.array([len(x) // 2 for x in rows["owner"]])
        owner = np.frombuffer(b"".join(rows["owner"]), np.uint16)
        low = np.frombuffer(b"".join(rows["h"]), np.uint16).reshape(-1, 3).astype(np.uint64)
        h = low[:, 0] | (low[:, 1] << np.uint64(16)) | (low[:, 2] << np.uint64(32)) | np.uint64(r << 48)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(h)))
        heavy = _short(np.frombuffer(b"".join(rows["hh"]), np.uint64), ranges)
        if len(heavy) and len(first):
            at = np.minimum(np.searchsorted(ordered[first], heavy), len(first) - 1)
            ok = ordered[first][at] == heavy
            np.add.at(times, at[ok], np.frombuffer(b"".join(rows["hn"]), np.int64)[ok])
        df = np.empty(len(h), np.int32)
        df[order] = np.repeat(np.minimum(times, COMMON), np.diff(np.append(first, len(h))))
        live = df >= 2
        out: dict[str, list] = {"block": [], "owner": [], "live": [], "h": [], "df": []}
        edge = np.searchsorted(row[live], np.arange(len(rows) + 1))
        o, hs, ds = owner[live], h[live], df[live]
        for k, block in enumerate(rows["block"].tolist()):
            a, b = edge[k], edge[k + 1]
            if a < b:
                out["block"].append(block)
                which, n = (o[a:b], None) if whole else np.unique(o[a:b], return_counts=True)
                out["owner"].append(which.tobytes())
                out["live"].append(None if whole else n.astype(np.int32).tobytes())
                out["h"].append(hs[a:b].tobytes() if whole else None)
                out["df"].append(ds[a:b].tobytes() if whole else None)
        done = pd.DataFrame({"block": np.array(out["block"], np.int64)} | {c: pd.Series(v, dtype=object) for c, v in out.items() if c != "block"})
        for c in ("id", "n", "s", "known"):
            done[c] = pd.Series([None] * len(done), dtype=object)
        del low, order, ordered, row
        trim()
        return done

    return count


def _short(h: np.ndarray, ranges: int) -> np.ndarray:
    """What an entry keeps of a hash: 48 bits and those of its range."""
    return h & np.uint64((ranges << 48) - 1)


def _survivors(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block, the sets of which so much is live that they may link: at most n - need(n) shingles of a set may be missing in the other."""
    own = rows[rows["id"].notna()].iloc[0]
    ids, n, s = np.frombuffer(own["id"], np.int64), np.frombuffer(own["n"], np.int32), np.frombuffer(own["s"], np.int32)
    live = np.frombuffer(own["known"], np.int32).astype(np.int64)
    for o, c in zip(rows["owner"], rows["live"], strict=True):
        if c is not None:
            live[np.frombuffer(o, np.uint16)] += np.frombuffer(c, np.int32)
    return pd.DataFrame({"digest": ids[live >= s - (n - (PERCENT * n.astype(np.int64) + 99) // 100)]})


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block, its sets' live shingles in the global order (df, hash), with those of the prefix."""
    own = rows[rows["id"].notna()].iloc[0]
    ids, size = np.frombuffer(own["id"], np.int64), np.frombuffer(own["n"], np.int32)
    owner = np.frombuffer(b"".join(rows["owner"]), np.uint16)
    h, df = np.frombuffer(b"".join(rows["h"]), np.uint64), np.frombuffer(b"".join(rows["df"]), np.int32)
    order = np.lexsort((h, df, owner))
    owner, h = owner[order], h[order]
    edge = np.searchsorted(owner, np.arange(len(ids) + 1))
    out: dict[str, list] = {"node": [], "n": [], "h": [], "prefix": []}
    for k, (node, n) in enumerate(zip(ids.tolist(), size.tolist(), strict=True)):
        part = h[edge[k] : edge[k + 1]]
        if len(part) >= need(n):
            out["node"].append(node)
            out["n"].append(n)
            out["h"].append(part.tobytes())
            out["prefix"].append(part[: max(0, n - need(n) + 1 - (n - len(part)))].view(np.int64))
    # no row at all must still have columns of the right kinds
    return pd.DataFrame({"node": np.array(out["node"], np.int64), "n": np.array(out["n"], np.int64), "h": pd.Series(out["h"], dtype=object), "prefix": pd.Series(out["prefix"], dtype=object)})


def _sets_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest, packed text) -> (node, n, h) where the text has the digest."""
    unpack = zstandard.ZstdDecompressor()
    for x in batches:
        texts = pa.array([unpack.decompress(z).decode() for z in x.column(2).to_pylist()], pa.string())
        raw, off = text_bytes(texts)
        node, digest = x.column(0).to_pylist(), x.column(1).to_pylist()
        out: list[tuple[int, int, bytes]] = []
        for a, b in chunks(off):
            out += [(node[i], len(s), s.tobytes()) for i, s in enumerate(shingle_sets(raw, off[a : b + 1], WIDTH), a) if set_digest(s) == digest[i]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["node", "n", "h"])
    trim()


def need(n: int) -> int:
    """Shingles of a set of n that a linked set must share, at least."""
    return (PERCENT * n + 99) // 100


class Trie:
    """Path-compressed prefix tree over integer sets in one order; nodes in depth-first order."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        begin, parent, stop, skip, longest, leaf = [0], [-1], [0], [0], [0], [[]]
        items: list[np.ndarray] = [np.zeros(0, np.int64)]
        stack = [(0, 0)]  # node, depth at its end
        last = np.zeros(0, np.int64)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            same = int(differ[0]) if len(differ) else m
            while stack[-1][1] > same:
                node, _ = stack.pop()
                above = stack[-1][1]
                if above < same:  # the shared part of the path becomes a node of its own above this one
                    new = len(items)
                    items.append(items[node][: same - above])
                    items[node] = items[node][same - above :]
                    parent.append(parent[node])
                    parent[node] = new
                    leaf.append([])
                    stack.append((new, same))
                    break
            if len(s) > same:
                items.append(s[same:])
                parent.append(stack[-1][0])
                leaf.append([i])
                stack.append((len(items) - 1, len(s)))
            else:
                leaf[stack[-1][0]].append(i)
            last = s
        self.items, self.parent, self.leaf = items, parent, leaf
        n = len(items)
        children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            children[parent[k]].append(k)
        # breadth-first levels let a walk take all its nodes of a depth at once
        self.levels, level = [], children[0]
        while level:
            self.levels.append(np.array(level))
            level = [c for k in level for c in children[k]]
        self.parent_of = np.array(parent)
        length = np.array([len(x) for x in items])
        self.low, self.high = np.full(n, 1 << 60), np.zeros(n, np.int64)  # sizes of the sets below a node, less its depth's end
        depth = np.zeros(n, np.int64)
        for lv in self.levels:
            depth[lv] = depth[self.parent_of[lv]] + length[lv]
        self.depth = depth
        self.length = length
        for k in [*np.concatenate(self.levels[::-1] or [np.zeros(0, int)]).tolist(), 0]:
            if leaf[k]:
                self.low[k], self.high[k] = min(self.low[k], depth[k]), max(self.high[k], depth[k])
            if k:
                p = parent[k]
                self.low[p], self.high[p] = min(self.low[p], self.low[k]), max(self.high[p], self.high[k])
        self.flat = np.concatenate(items)
        self.at = np.concatenate([[0], np.cumsum(length)])

    def walk(self, member: np.ndarray, n: int, size: np.ndarray) -> list[int]:
        """Sets that link with the one whose shingles member marks; n: its whole size, size: the whole sizes of the sets."""
        overlap = np.zeros(len(self.items), np.int64)
        alive = np.zeros(len(self.items), bool)
        alive[0] = True
        least = need(n)
        hits = [i for i in self.leaf[0] if 0 >= least]
        total = int(member.sum())
        for lv in self.levels:
            k = lv[alive[self.parent_of[lv]]]
            if not len(k):
                break
            counts = np.array([np.count_nonzero(member[self.flat[self.at[x] : self.at[x + 1]]]) for x in k.tolist()]) if len(k) < 8 else self._counts(member, k)
            got = overlap[self.parent_of[k]] + counts
            overlap[k] = got
            ok = got + np.minimum(self.high[k] - self.depth[k], total - got) >= least
            alive[k[ok]] = True
            for x, g in zip(k[ok].tolist(), got[ok].tolist(), strict=True):
                for i in self.leaf[x]:
                    if 100 * g >= PERCENT * (n + int(size[i]) - g):
                        hits.append(i)
        return hits

    def _counts(self, member: np.ndarray, k: np.ndarray) -> np.ndarray:
        length = self.length[k]
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.arange(int(length.sum())) - np.repeat(first, length) + np.repeat(self.at[k], length)
        return np.add.reduceat(member[self.flat[at]].astype(np.int64), first)


def link_sets(hashes: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect whatever links connect among the sets."""
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    ids, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids, -n))] = np.arange(len(ids))  # most common first, so that near copies share long paths
    parts = np.split(rank[inv], np.cumsum([len(h) for h in hashes])[:-1])
    sets = [np.sort(p) for p in parts]
    trie, forest = Trie(sets), Forest(len(sets))
    left, right = [], []
    member = np.zeros(len(ids), bool)
    for i, s in enumerate(sets):
        roots = forest.roots()
        if (roots == roots[0]).all():
            break
        member[s] = True
        for j in trie.walk(member, int(sizes[i]), sizes):
            if j != i and forest.find(i) != forest.find(j):
                forest.union(i, j)
                left.append(i)
                right.append(j)
        member[s] = False
    return np.array(left, np.int64), np.array(right, np.int64)


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    left, right = link_sets([np.frombuffer(h, np.uint64) for h in rows["h"]], rows["n"].to_numpy())
    node = rows["node"].to_numpy()
    return pd.DataFrame({"a": node[left] if len(left) else np.zeros(0, np.int64), "b": node[right] if len(right) else np.zeros(0, np.int64)})


def _bits(entries: float | None) -> int:
    """Bits that name a range, so that a range has about RANGE_ENTRIES."""
    return min(13, max(4, math.ceil(math.log2(max(1.0, (entries or 0) / RANGE_ENTRIES)))))


def link_members(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what links connect inside each candidate component; members: (node, of).

    A component of up to TILE members and TILE_ENTRIES shingles is one group. A larger one is dealt to tiles; each is joined with itself, then one member of each part of each tile
    stands for the part and these are linked in the same way. Most large groups are connected by now; of those that are not, all pairs of
    tiles are joined. So a group of near copies costs about its size, and no task holds more than two tiles.
    """
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.least(F.ceil(F.sum("n") / TILE_ENTRIES), F.count("*")))
    size = members.join(sets.select("node", "n"), "node").groupBy("of").agg(tiles.cast("int").alias("tiles"))
    placed = stored(members.join(size, "of").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    large = placed.where("tiles > 1")
    kind = "a long, b long"

    def joined(rows: DataFrame, *key: str) -> DataFrame:
        return rows.join(sets, "node").groupBy("of", *key).applyInPandas(_tile, kind)

    own = joined(placed.select("of", "t", "node"), "t")
    if not large.take(1):
        return own
    own = stored(own)
    part = components(own).withColumnRenamed("id", "node").withColumnRenamed("component_id", "c")
    standing = large.join(part, "node", "left").groupBy("of", "t", F.coalesce("c", "node").alias("c")).agg(F.min("node").alias("node")).select("node", "of")
    if standing.count() <= 0.5 * large.count():
        own = stored(own.unionByName(link_members(standing, sets)))
        part = components(own).withColumnRenamed("id", "node").withColumnRenamed("component_id", "c")
    labels = large.join(part, "node", "left").groupBy("of").agg(F.min(F.coalesce("c", "node")).alias("lo"), F.max(F.coalesce("c", "node")).alias("hi"))
    apart = large.join(labels.where("lo <> hi").select("of"), "of", "left_semi")
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: k != F.col("t"))
    pairs = apart.withColumn("u", F.explode(others)).select("of", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "node")
    return own.unionByName(joined(pairs, "i", "j"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Hash of a row's id and text: rows of one key are copies of each other."""
    return F.xxhash64(doc_id.cast("long"), text)


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, digest, rid) of each row, and (digest, c, component_id) of each class of rows with equal sets of shingles.

    A class is named by its digest, never by an id, so ids that are null or occur twice join nothing. c names the classes that links connect,
    component_id is the smallest id in them, null if all are null. Rows without words are in no class.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("rid"))
    kinds = cut(rows.mapInArrow(_class_batches, "doc_id long, n_shingles long, digest long, rid long"))
    classes = kinds.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n_shingles"))
    bits = _bits((kinds.agg(F.sum("n_shingles")).first()[0] or 0) * PART / 8)
    dealt = rows.select("text").mapInArrow(_text_blocks(bits, PART), Blocks.schema)
    counted = dealt.groupBy("r").applyInPandas(_counted(bits, False), _COUNTED)
    alive = counted.groupBy("block").applyInPandas(_survivors, "digest long").distinct()
    nodes = cut(alive.join(classes, "digest").select("rid", "digest", "n_shingles"))
    named = packed(rows.select("rid", "text")).join(nodes.select("rid", "digest"), "rid").where("text is not null").select(F.col("digest").alias("node"), "digest", "text")
    whole = stored(named.mapInArrow(_sets_of_nodes, "node long, n long, h binary"))
    if whole.groupBy("node").count().where("count > 1").take(1):  # rows with one id and text
        whole = whole.dropDuplicates(["node"])
    bits = _bits(nodes.agg(F.sum("n_shingles")).first()[0])
    dealt = whole.mapInArrow(_set_blocks(bits), Blocks.schema)
    counted = dealt.groupBy("r").applyInPandas(_counted(bits, True), _COUNTED)
    sets = stored(counted.groupBy("block").applyInPandas(_ordered, "node long, n long, h binary, prefix array<long>"))
    keys = sets.select("node", F.explode("prefix").alias("g"))
    star = keys.groupBy("g").agg(F.min("node").alias("b"), F.count("*").alias("k")).where("k > 1")
    near = components(keys.join(star, "g").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    edges = link_members(near.select(F.col("id").alias("node"), F.col("component_id").alias("of")), sets.select("node", "n", "h"))
    linked = components(edges).select(F.col("id").alias("digest"), F.col("component_id").alias("c"))
    lowest = linked.join(classes.select("digest", "least"), "digest").groupBy("c").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(lowest, "c").withColumn("linked", F.lit(True))
    final = classes.join(of_linked, "digest", "left")
    return kinds, final.select("digest", F.coalesce("c", "digest").alias("c"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, n_shingles, component_id = smallest id reachable by links).

    Null or wordless text: n_shingles 0, component_id its own id. Repeated ids or texts: a row each, texts linked; rows are not linked by
    their ids. Null id: component_id is the smallest id that is not null, null if there is none. Other columns of docs, whatever their names,
    are not looked at.
    """
    kinds, final = link_classes(docs, id_col, text_col)
    return kinds.join(final, "digest", "left").select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked rows one, and every row that links with nothing, those without words too.

    Of a group the row with the smallest doc_id stays, one with a null id only where all ids are null; then the smallest hash of id and text decides.
    Of rows with one id and one text any may stay. Other columns, whatever their names, pass through.
    """
    kinds, final = link_classes(docs)
    found = stored(kinds.join(final, "digest", "left").select("doc_id", "rid", "c", "component_id"))
    first = found.where("c is not null and doc_id <=> component_id").groupBy("c").agg(F.min("rid").alias("rid"), F.first("doc_id").alias("id"))
    rid, keep_rid, keep_id, one = free_names(docs, "rid", "keep_rid", "keep_id", "one")
    keep = first.select(F.col("rid").alias(keep_rid), F.col("id").alias(keep_id), F.lit(True).alias(one))
    keep = cut(keep.unionByName(found.where("c is null").select(F.col("rid").alias(keep_rid), F.col("doc_id").alias(keep_id), F.lit(False).alias(one)).distinct()))
    rows = packed(docs.withColumn(rid, row_key(F.col("doc_id"), F.col("text"))))
    kept = rows.join(keep, (F.col(rid) == F.col(keep_rid)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)))
    if found.where("c is not null").groupBy("doc_id", "rid").count().where("count > 1").take(1):
        kept = kept.where(F.col(one)).dropDuplicates([rid, "doc_id"]).unionByName(kept.where(~F.col(one)))
    return unpacked(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))
