"""Operator 11, best-fit packing of documents into sequences of a fixed number of tokens.

1. Tasks turn texts into ids, cut longer documents into pieces, and number the pieces of each length as they come. Pieces are stored.
2. How many pieces there are of each length (at most capacity rows, whatever the number of documents) is all that a packing depends on. `pack` solves that on the
   driver: best-fit decreasing gives the first incumbent; bin completion then takes the largest length left and fills the room beside it until nothing is left, while the
   waste so far allows a better packing than the incumbent. A few descents draw fillings in proportion to what is left, so that no kind of length is used up before the
   others; then the undominated fillings are enumerated, least waste first, each applied as often as the counts allow, with backtracking. A packing at the lower bound ends it.
3. The answer is a list of patterns, each with the number of sequences that follow it. A piece finds its sequence and offset from its length and its number among
   all pieces of that length: its number in its task plus the counts of earlier tasks.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import small_batches, stored, table, trim

CAPACITY = 2048
#: Steps of the search for a better packing than best fit's; fillings looked at in a step before the best of them is tried.
NODES, TRIES = 12_000, 64
#: Descents by drawn fillings; fillings drawn for a sequence until one is full; the number of times one is applied is such that this many use up all pieces, about.
DESCENTS, DRAWS, SHARES = 4, 16, 30_000
#: Characters of a text that are encoded at once, about.
SEGMENT = 1 << 16
#: Characters whose class is the same in all versions of Unicode of the last ten years, so that both libraries cut texts alike.
_SETTLED = re.compile("[^\x00-\u052f\u2000-\u2bff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")
#: Fixed value: where byte-level vocabularies cut texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by a `tokenizers` file, without special tokens; their strings in a text are ordinary text.

    Where the file is a byte-level BPE whose ids follow its merges, texts go through tiktoken with the ranks of that file, which gives the same ids some four times
    as fast. Texts with rarer characters and long runs without a blank go through `tokenizers` itself.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.quick = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict) -> tiktoken.Encoding | None:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model["type"] == "BPE" and not spec["normalizer"]
        if not plain or model.get("ignore_merges") or model.get("dropout"):
            return None
        # how such vocabularies write bytes: printable Latin-1 stands for itself, other bytes follow from U+0100
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(merged) + 256 != len(vocabulary):
            return None
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocabulary.items()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        parts = [np.array(self._segment(s), np.uint32) for s in segments(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)])

    def _segment(self, text: str) -> list[int]:
        if self.quick is None or len(text) > 4 * SEGMENT or _SETTLED.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """Parts of a text whose ids, one after the other, are those of the text: cut before a blank that follows a letter or digit, where every word ends."""
    at = 0
    while len(text) - at > limit:
        end = text.rfind(" ", at + 1, at + limit)
        while end > at and not text[end - 1].isalnum():
            end = text.rfind(" ", at + 1, end)
        if end <= at:
            end = text.find(" ", at + limit)
            while end >= 0 and not text[end - 1].isalnum():
                end = text.find(" ", end + 1)
            if end < 0:
                break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- the packing of counts

Patterns = list[tuple[dict[int, int], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing takes at least: by tokens, and by the lengths over half, which cannot share a sequence."""
    n = np.zeros(capacity + 1, np.int64)
    for k, v in counts.items():
        n[k] = v
    size = np.arange(capacity + 1)
    number, tokens = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        over = int(number[-1] - number[capacity - k])
        large, large_tokens = int(number[capacity - k] - number[half]), int(tokens[capacity - k] - tokens[half])
        small = int(tokens[half] - tokens[k - 1])
        best = max(best, over + large + max(0, -(-(small - (large * capacity - large_tokens)) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Best-fit decreasing: each length goes where the room left is least. Sequences with equal contents are one pattern."""
    open_: dict[int, Counter] = {}  # room -> pattern (sorted items) -> number of sequences
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=0)
            if room:
                pattern, n = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
            else:
                pattern, n, room = (), -(-left // (capacity // length)), capacity
            k = min(room // length, left)
            m = min(n, left // k)
            if room != capacity and n > m:
                open_.setdefault(room, Counter())[pattern] += n - m
            open_.setdefault(room - k * length, Counter())[(*pattern, (length, k))] += m
            left -= k * m
    return [(_merged(p), n) for patterns in open_.values() for p, n in patterns.items()]


def _merged(pattern: tuple) -> dict[int, int]:
    out: dict[int, int] = {}
    for length, k in pattern:
        out[length] = out.get(length, 0) + k
    return out


class _Search:
    """Bin completion over counts. free: lengths with pieces left, as the bits of one integer."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity = [0] * (capacity + 1), capacity
        self.free = 0
        for k, v in counts.items():
            self.n[k] = v
            self.free |= (v > 0) << k

    def below(self, most: int) -> int:
        """The largest length left up to most, 0 if none."""
        return (self.free & ((2 << most) - 1)).bit_length() - 1 if self.free & ((2 << most) - 1) else 0

    def take(self, filling: dict[int, int], times: int) -> None:
        for k, c in filling.items():
            self.n[k] -= c * times
            if not self.n[k]:
                self.free &= ~(1 << k)
            else:
                self.free |= 1 << k

    def fillings(self, room: int, most: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Fillings to which nothing that is left can be added, largest lengths first."""
        x = self.below(min(room, most)) if room > 0 and most > 0 else 0
        if not x:
            yield ()
            return
        while x:
            for k in range(min(self.n[x], room // x), 0, -1):
                for rest in self.fillings(room - k * x, x - 1):
                    yield ((x, k), *rest)
            x = self.below(x - 1) if x > 1 else 0

    def dominated(self, filling: tuple[tuple[int, int], ...], waste: int) -> bool:
        """Can something that is left fill more of the room in place of nothing, of one length or of two?"""
        spare = self.free  # lengths of which more are left than the filling has
        for x, k in filling:
            if self.n[x] == k:
                spare &= ~(1 << x)
        wider = (2 << waste) - 1
        if spare & (wider - 1) or (waste and any((spare >> x) & (wider - 1) for x, _ in filling)):
            return True
        items = [x for x, k in filling for _ in range(min(k, 2))][:8]
        return any((spare >> s) & wider for s in {a + b for i, a in enumerate(items) for b in items[i + 1 :]})

    def completions(self, first: int) -> Iterator[dict[int, int]]:
        """Undominated contents of a sequence with a piece of the largest length, in groups of TRIES by waste; a full one is given at once. {}: a group had none."""
        self.take({first: 1}, 1)
        room = self.capacity - first
        state = list(self.n), self.free
        self.take({first: 1}, -1)
        probe = _Search({}, self.capacity)
        probe.n, probe.free = state
        held: list[tuple[int, int, dict[int, int]]] = []
        for tried, f in enumerate(probe.fillings(room, first)):
            waste = room - sum(x * k for x, k in f)
            if not probe.dominated(f, waste):
                contents = dict(f)
                contents[first] = contents.get(first, 0) + 1
                if not waste:
                    yield contents
                else:
                    held.append((waste, tried, contents))
            if tried % TRIES == TRIES - 1:
                yield from [c for _, _, c in sorted(held, key=lambda h: h[:2])] or [{}]
                held = []
        yield from (c for _, _, c in sorted(held, key=lambda h: h[:2]))


class _Drawn:
    """Bin completion whose fillings are drawn from the pieces left. free, back: lengths with pieces left, as bits from either end; tree: sums of counts (Fenwick)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.free, self.back = capacity, 0, 0
        self.n, self.tree = [0] * (capacity + 1), [0] * (capacity + 1)
        for k, v in counts.items():
            self.add(k, v)

    def add(self, length: int, pieces: int) -> None:
        self.n[length] += pieces
        bit, mirrored = 1 << length, 1 << (self.capacity - length)
        if self.n[length]:
            self.free, self.back = self.free | bit, self.back | mirrored
        else:
            self.free, self.back = self.free & ~bit, self.back & ~mirrored
        while length <= self.capacity:
            self.tree[length] += pieces
            length += length & -length

    def upto(self, most: int) -> int:
        """Pieces of lengths up to most."""
        n = 0
        while most:
            n += self.tree[most]
            most &= most - 1
        return n

    def length_of(self, nth: int) -> int:
        """The length of the nth piece, from 0, in order of length."""
        at, step = 0, 1 << (self.capacity.bit_length() - 1)
        while step:
            if at + step <= self.capacity and self.tree[at + step] <= nth:
                at += step
                nth -= self.tree[at]
            step >>= 1
        return at + 1

    def filling(self, first: int, rng: random.Random) -> tuple[list[int], int]:
        """Lengths of a sequence with a piece of length first, drawn until one or two pieces fill it or none fits; the room that stays."""
        held, room = [first], self.capacity - first
        self.add(first, -1)
        while room:
            if self.n[room]:
                more = [room]
            elif 2 * room < self.capacity and (pairs := self._pairs(room)):
                low = rng.randrange(room)
                high = pairs >> low
                a = low + (high & -high).bit_length() - 1 if high else (pairs & -pairs).bit_length() - 1
                more = [a, room - a]
            elif fit := self.upto(room):
                more = [self.length_of(rng.randrange(fit))]
            else:
                break
            for x in more:
                self.add(x, -1)
            held += more
            room -= sum(more)
        for x in held:
            self.add(x, 1)
        return held, room

    def _pairs(self, room: int) -> int:
        """Lengths left that a length left makes up to room, as bits."""
        both = self.free & (self.back >> (self.capacity - room))
        return both & ~(1 << (room // 2)) if room % 2 == 0 and self.n[room // 2] == 1 else both

    def descend(self, budget: int, seed: int) -> Patterns | None:
        """Sequences for all pieces that waste at most budget, or None."""
        rng, waste, out = random.Random(seed), 0, []
        share = -(-sum(self.n) // SHARES)
        while self.free:
            first, least, best = self.free.bit_length() - 1, self.capacity, []
            for _ in range(DRAWS):
                held, room = self.filling(first, rng)
                if room < least:
                    least, best = room, held
                if not room:
                    break
            contents = Counter(best)
            times = min(share, *(self.n[k] // c for k, c in contents.items()))
            waste += least * times
            if waste > budget:
                return None
            for k, c in contents.items():
                self.add(k, -c * times)
            out.append((dict(contents), times))
        return out


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Patterns:
    """[(contents as length -> copies, number of sequences)] that hold all pieces: counts has the number of pieces of each length from 1 to capacity."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    best = best_fit(counts, capacity)
    used, total, bound = sum(m for _, m in best), sum(k * v for k, v in counts.items()), lower_bound(counts, capacity)
    for seed in range(DESCENTS):
        if used > bound and (found := _Drawn(counts, capacity).descend((used - 1) * capacity - total, seed)):
            best, used = found, sum(m for _, m in found)
    search, path, waste, left = _Search(counts, capacity), [], 0, nodes
    # path: (completions still to try, contents, times, waste)
    descend = True
    while used > bound and left > 0:
        budget = (used - 1) * capacity - total
        if descend:
            first = search.below(capacity)
            if not first:
                found = sum(t for _, _, t, _ in path)
                if found < used:
                    best, used = [(dict(c), t) for _, c, t, _ in path], found
                descend = False
                continue
            path.append([search.completions(first), None, 0, 0])
        step = path[-1]
        if step[1]:
            search.take(step[1], -step[2])
            waste -= step[3]
            step[1] = None
        left -= 1
        contents = next(step[0], None)
        if contents is None:
            path.pop()
            if not path:
                break
            descend = False
            continue
        if not contents:  # a group of fillings, all dominated
            descend = False
            continue
        times = min(search.n[k] // c for k, c in contents.items())
        lost = times * (capacity - sum(k * c for k, c in contents.items()))
        step[1:] = [contents, times, lost]
        search.take(contents, times)
        waste += lost
        descend = waste <= budget
    return best


# ---------------------------------------------------------------- documents

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def _piece_rows(path: str, capacity: int, ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path), TaskContext.get().partitionId()
        so_far = np.zeros(capacity + 1, np.int64)
        end = np.zeros(1, np.uint32)
        for x in batches:
            owner, number, start, length, crc, held = [], [], [], [], [], []
            for k, text in enumerate(x.column(1).to_pylist()):
                tokens = np.concatenate([encoder.ids(text), end]) if text else end
                first = (len(tokens) - 1) % capacity + 1
                bounds = [0, *range(first, len(tokens) + 1, capacity)]
                for j, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    owner.append(k)
                    number.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if ids:
                        held.append(tokens[a:b].astype(np.int32))
            size = np.array(length, np.int64)
            order = np.argsort(size, kind="stable")
            heads = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1]) if len(size) else np.zeros(0, np.int64)
            nth = np.zeros(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(heads, np.diff(np.append(heads, len(size)))) + so_far[size[order]]
            so_far += np.bincount(size, minlength=capacity + 1)
            columns = [x.column(0).take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(size), task, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.list_(pa.int32()))] if ids else columns, [*names, "ids"] if ids else names)
        trim()

    return rows


class Places:
    """Where the pieces of each length go. Rows by length and number: first number, sequences, first sequence, first offset."""

    def __init__(self, patterns: Patterns, capacity: int):
        rows, used, sequence = [], [0] * (capacity + 1), 0
        for contents, times in patterns:
            offset = 0
            for length in sorted(contents, reverse=True):
                copies = contents[length]
                rows.append((length, used[length], times, sequence, offset))
                used[length] += times * copies
                offset += length * copies
            sequence += times
        rows.sort()
        self.table = np.array(rows, np.int64).reshape(len(rows), 5)
        self.sequences = sequence
        self.first_row = np.searchsorted(self.table[:, 0], np.arange(capacity + 2))

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces, by length and number among all of that length."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            at = np.flatnonzero(length == k)
            some = self.table[self.first_row[k] : self.first_row[k + 1]]
            row = some[np.searchsorted(some[:, 1], number[at], "right") - 1]
            copy, which = np.divmod(number[at] - row[:, 1], row[:, 2])
            sequence[at], offset[at] = row[:, 3] + which, row[:, 4] + copy * k
        return sequence, offset


def _place_rows(shared, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sequence, offset = shared.value.of(x.column(x.num_columns - 2).to_numpy().astype(np.int64), x.column(x.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*x.columns[:-2], x.column(x.num_columns - 2).cast(pa.int64()), pa.array(sequence), pa.array(offset)], names)

    return rows


def packed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, nodes: int = NODES, ids: bool = False) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset), and ids array<int> on request.

    Each document ends with id 0, so a null or empty text is that id alone. A document over capacity is cut into pieces of capacity, the first of which takes what is
    over. Rows that come again are documents of their own; a null id stays null; an empty table gives no rows. Other columns are not looked at.
    """
    if not 0 < capacity <= 1 << 20:
        raise ValueError("capacity must be 1 to 2^20")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(_piece_rows(tokenizer or default_tokenizer(), capacity, ids), _PIECES + (", ids array<int>" if ids else "")))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    shared = spark.sparkContext.broadcast(Places(pack(hist, capacity, nodes), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kept = ["doc_id", "piece", "start", "ids_crc32", *(["ids"] if ids else [])]
    numbered = pieces.join(base, ["part", "length"]).select(*kept, "length", (F.col("before") + F.col("nth")).alias("number"))
    schema = "doc_id long, piece int, start long, ids_crc32 long, " + ("ids array<int>, " if ids else "") + "length long, sequence_id long, offset long"
    out = numbered.mapInArrow(_place_rows(shared, [*kept, "length", "sequence_id", "offset"]), schema)
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else []))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the sequences of pieces with ids; starts: the offsets at which a piece begins. A sequence is one group, of capacity ids at most."""
    group = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return group.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))
