"""Operator 4, SentencePiece encoding and decoding with a given model file.

Texts are cut where no piece can cross: before runs of blanks, and around line ends. Of each block of texts the distinct words form a lattice: all substrings of
at most the length of the longest piece are exploded, equi-joined by hash to the piece table, and the edges grouped by word. A fold over each word's edges gives
its pieces. `encode` runs all of this on the columns of a block at once, so no word leaves its partition. `encode_words` is the same lattice as Spark joins
and a Spark higher-order aggregate, for tables of distinct words; the README says what it costs to encode texts that way.

The model of the vocabulary files is of the BPE kind. A Viterbi fold over its scores gives other pieces than the model for 60 % of distinct words (35 % with
the fewest pieces), so both folds follow the model's own rule: merge, again and again, the neighbours whose edge has the best score, the leftmost of equals.
Characters without a piece become their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix64, small_batches, table, text_bytes, trim

BLANK = 0x2581
#: Words of more code points are folded with a heap, one by one.
LONG = 48
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_NONE = np.int32(1 << 30)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table: hash -> id, rank of the score and bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[bytes] = []
        names, scores, ids = [], [], []
        self.byte_id = np.full(256, sp.unk_id(), np.int32)
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                names.append(p)
                scores.append(sp.get_score(i))
                ids.append(i)
                self.text.append(p.replace(chr(BLANK), " ").encode())
        rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        self.rank = dict(zip(names, rank.tolist(), strict=True))
        self.id = dict(zip(names, ids, strict=True))
        self.longest = max(map(len, names))
        key = np.array([piece_hash(p) for p in names], np.uint64)
        self.bits = 18
        size = 1 << self.bits
        self.slot_key, self.slot_id = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.rank_of = np.full(sp.vocab_size() + 1, _NONE)  # the last is that of -1, no piece
        self.rank_of[ids] = rank
        for k, i in zip(key.tolist(), ids, strict=True):
            at = k >> (64 - self.bits)
            while self.slot_id[at] >= 0:
                at = (at + 1) % size
            self.slot_key[at], self.slot_id[at] = k, i

    def join(self, key: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 where there is none."""
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        ident = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            taken = self.slot_id[at] >= 0
            hit = taken & (self.slot_key[at] == key[left])
            ident[left[hit]] = self.slot_id[at[hit]]
            more = taken & ~hit
            left, at = left[more], (at[more] + 1) % len(self.slot_id)
        return ident


def piece_hash(p: str) -> int:
    h = 0
    for c in p:
        h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return int(mix64(np.array([h], np.uint64))[0])


def fold_long(word: str, pieces: Pieces) -> list[str]:
    """Pieces of one word by a heap of neighbours."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and end[b] - a <= pieces.longest and (r := pieces.rank.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (r, a, b, end[b]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if not alive[a] or end[a] != b or not alive[b] or end[b] != stop:
            continue
        alive[b], end[a] = False, stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [word[a : end[a]] for a in range(n) if alive[a]]


def fold_words(points: np.ndarray, start: np.ndarray, stop: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the words points[start:stop], joined, and how many each word has."""
    size = stop - start
    first = np.concatenate([[0], np.cumsum(size)])
    total = int(first[-1])
    at = np.arange(total) - np.repeat(first[:-1], size) + np.repeat(start, size)
    code = points[at].astype(np.uint64) + np.uint64(1)
    room = np.repeat(first[1:], size) - np.arange(total)  # characters from each place to the end of its word
    # the lattice: edges[i * longest + l] is the piece of l + 1 characters from place i
    longest = pieces.longest
    edges = np.full(total * longest, -1, np.int32)
    h = np.zeros(total, np.uint64)
    places = np.arange(total)
    for width in range(1, longest + 1):
        places = places[room[places] >= width]
        if not len(places):
            break
        h[places] = h[places] * np.uint64(_BASE) + code[places + width - 1]
        edges[places * longest + width - 1] = pieces.join(mix64(h[places]))
    # the fold: a symbol begins at each place; every word merges its best neighbours once a round
    begins = np.arange(total)
    word = np.repeat(np.arange(len(size)), size)
    done_begin, done_word = [], []
    while len(begins):
        end = np.append(begins[1:], 0)
        last = np.append(word[1:] != word[:-1], True)
        end[last] = first[word[last] + 1]
        after = np.append(end[1:], 0)
        width = after - begins
        ok = np.flatnonzero(~last & (width <= longest))
        rank = np.full(len(begins), _NONE, np.int32)
        rank[ok] = pieces.rank_of[edges[begins[ok] * longest + width[ok] - 1]]
        head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, head)
        per = np.diff(np.append(head, len(begins)))
        goes = best < _NONE
        is_best = (rank == np.repeat(best, per)) & np.repeat(goes, per)
        hit = np.flatnonzero(is_best)
        hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])] if len(hit) else hit  # the leftmost of a word
        still = np.repeat(goes, per)
        done_begin.append(begins[~still])
        done_word.append(word[~still])
        still[hit + 1] = False
        begins, word = begins[still], word[still]
    begins = np.sort(np.concatenate(done_begin)) if done_begin else np.zeros(0, np.int64)
    word = np.searchsorted(first, begins, "right") - 1
    end = np.append(begins[1:], total)
    ident = edges[begins * longest + np.minimum(end - begins, longest) - 1] if len(begins) else np.zeros(0, np.int32)
    counts = np.bincount(word, minlength=len(size))
    odd = np.flatnonzero(ident < 0)
    if not len(odd):
        return ident, counts
    # single characters without a piece: their bytes
    many = np.ones(len(ident), np.int64)
    spelled = [chr(int(c) - 1).encode("utf-8", "replace") for c in code[begins[odd]].tolist()]
    many[odd] = [len(s) for s in spelled]
    out = np.repeat(ident, many)
    out[np.repeat(ident < 0, many)] = pieces.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
    return out, np.bincount(np.repeat(word, many), minlength=len(size))


def encode_block(texts: list[str], pieces: Pieces) -> list[np.ndarray]:
    """Ids of each text. The empty text has none; any other begins with a blank that decoding takes off."""
    joined = "".join("▁" + t + "\n" if t else "\n" for t in texts)
    points = np.frombuffer(joined.replace(" ", "▁").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) + 2 if t else 1 for t in texts], np.int64)
    stop_of = np.cumsum(size)  # each text ends with a line end of ours
    line, blank = points == 10, points == BLANK
    cut = np.zeros(len(points), bool)
    cut[0] = True
    cut[1:] = (blank[1:] & ~blank[:-1]) | line[1:] | line[:-1]
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], len(points))
    # distinct words by hash
    width = stop - start
    place = np.arange(len(points)) - np.repeat(start, width)
    power = np.cumprod(np.full(int(width.max()) + 1, _BASE | 1, np.uint64), dtype=np.uint64)
    key = mix64(np.add.reduceat((mix64(points.astype(np.uint64) + np.uint64(7))) * power[place], start) + width.astype(np.uint64))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    short = width[one] <= LONG
    ids = np.zeros(0, np.int32)
    counts = np.zeros(len(one), np.int64)
    parts_ids, counts[short] = fold_words(points, start[one[short]], stop[one[short]], pieces)
    offset = np.zeros(len(one), np.int64)
    offset[short] = np.concatenate([[0], np.cumsum(counts[short])[:-1]]) if short.any() else 0
    extra = [parts_ids]
    at = len(parts_ids)
    for k in np.flatnonzero(~short).tolist():
        w = points[start[one[k]] : stop[one[k]]].tobytes().decode("utf-32-le", "surrogatepass")
        got: list[int] = []
        for p in fold_long(w, pieces):
            i = pieces.id.get(p)
            got += [i] if i is not None else pieces.byte_id[list(p.encode("utf-8", "replace"))].tolist()
        extra.append(np.array(got, np.int32))
        offset[k], counts[k] = at, len(got)
        at += len(got)
    ids = np.concatenate(extra)
    # every text's words, put back in order; the line end that ends it is left out
    is_end = np.zeros(len(start), bool)
    is_end[np.searchsorted(start, stop_of - 1)] = True
    n = np.where(is_end, 0, counts[which])
    head = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.arange(int(head[-1])) - np.repeat(head[:-1], n) + np.repeat(offset[which], n)]
    bounds = head[np.searchsorted(start, stop_of - 1)]
    return np.split(flat, bounds[:-1])


def decode(ids: np.ndarray | list[int], pieces: Pieces) -> str:
    """The text of some ids; bytes that are no UTF-8 become replacement characters; the first blank is taken off."""
    text = b"".join(map(pieces.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, ids array<int>, n_tokens, round_trip). Null text: null ids, n_tokens 0, round_trip true; empty text: no ids.

    round_trip: do the ids decode to the text again (all do but those that hold U+2581, which the model takes for a blank)? Repeated rows give one row
    each; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    pieces = Pieces(model or default_model())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            _, off = text_bytes(x.column(1))
            for a, b in chunks(off, BLOCK_BYTES):
                part = x.column(1).slice(a, b - a)
                texts = part.fill_null("").to_pylist()
                ids = encode_block(texts, pieces)
                same = [decode(i, pieces) == t for i, t in zip(ids, texts, strict=True)]
                size = np.array([len(i) for i in ids], np.int64)
                missing = part.is_null().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(missing, False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([x.column(0).slice(a, b - a), lists, pa.array(size), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, ids array<int>, n_tokens long, round_trip boolean").withColumnRenamed("doc_id", id_col)


def decode_frame(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give a null text."""
    pieces = Pieces(model or default_model())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([None if i is None else decode(i, pieces) for i in x.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>")).mapInArrow(batches, "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, rank): as many rows as the model has pieces."""
    return spark.createDataFrame([(p, pieces.id[p], r) for p, r in pieces.rank.items()], "piece string, id int, rank int")


def encode_words(words: DataFrame, model: str | None = None, col: str = "word") -> DataFrame:
    """(word, ids) of distinct words, each a text without line ends and blanks inside whose blanks before it are written as U+2581: the relational lattice.

    Substrings are exploded, equi-joined to the piece table (a broadcast of fixed size), the edges of a word are grouped, and an aggregate over as many steps
    as the word has signs folds them. A null word gives null ids, an empty one none; a word that comes again gives one row.
    """
    spark = words.sparkSession
    pieces = Pieces(model or default_model())
    longest, none = pieces.longest, 1 << 30
    table = F.broadcast(piece_table(spark, pieces))
    given = words.select(F.col(col).alias("word")).distinct().withColumn("n", F.length("word"))
    # edges by place and length: number i * longest + l - 1
    begins = lambda n: F.sequence(F.lit(0), n - 1)
    spans = F.flatten(F.transform(begins(F.col("n")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - i)), lambda w: F.struct((i * longest + w - 1).alias("at"), F.substring(F.col("word"), i + 1, w).alias("piece")))))
    edges = given.where("n > 0").select("word", "n", F.explode(spans).alias("e")).select("word", "n", "e.at", "e.piece").join(table, "piece")
    grouped = edges.groupBy("word", "n").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("rank", "id").alias("x")))).alias("edges"))
    whole = given.where("n > 0").join(grouped, ["word", "n"], "left").withColumn("edges", F.coalesce("edges", F.expr("cast(map() as map<int, struct<rank: int, id: int>>)")))

    def rank_of(s: Column, k: Column) -> Column:
        """Rank of the piece of the symbols k and k + 1, none if there is no such piece."""
        stop = F.coalesce(F.get(s, k + 2), F.col("n"))
        width = stop - F.get(s, k)
        return F.when((k + 1 < F.size(s)) & (width <= longest), F.coalesce(F.col("edges")[F.get(s, k) * longest + width - 1]["rank"], F.lit(none))).otherwise(F.lit(none))

    def merged(s: Column, _: Column) -> Column:
        best = F.array_min(F.transform(s, lambda _b, k: F.struct(rank_of(s, k).alias("rank"), k.alias("k"))))
        return F.when(best["rank"] < none, F.filter(s, lambda _b, k: k != best["k"] + 1)).otherwise(s)

    symbols = F.aggregate(F.sequence(F.lit(1), F.col("n")), begins(F.col("n")), merged)
    done = whole.select("word", "n", "edges", symbols.alias("s"))
    byte_ids = F.array(*[F.lit(int(x)) for x in pieces.byte_id])
    spelled = lambda c: F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda j: F.get(byte_ids, F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), j * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    def ids_of(b: Column, k: Column) -> Column:
        width = F.coalesce(F.get("s", k + 1), F.col("n")) - b
        i = F.col("edges")[b * longest + width - 1]["id"]
        return F.when(i.isNotNull(), F.array(i)).otherwise(spelled(F.substring(F.col("word"), b + 1, width)))

    out = done.select("word", F.flatten(F.transform("s", ids_of)).alias("ids"))
    rest = given.where("n is null or n = 0").select("word", F.when(F.col("n") == 0, F.array().cast("array<int>")).alias("ids"))
    return out.unionByName(rest)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: ids of the texts in place of the texts."""
    return encode(docs)
