"""Full-text search: documents -> postings -> BM25, with phrases, boolean operators, prefixes and typo-tolerant terms.

An index is a folder of Parquet tables: docs (path, content, file_type, size, modified, doc_id, length), postings (term, doc_id, tf, positions, length and
file_type of the document, bucket; partitioned by a hash of the term, so a query reads the folders of its terms), terms (term, df; in ranges of terms, so a prefix
reads its range), near (variant, term, bucket: shortened forms of terms, so a typo-tolerant term reads the folders of its own forms), stats. A query is an expression
tree on the driver; its terms become one filter on postings, the tree one boolean expression over the terms that a document has. Scores need postings and terms only,
positions are read for phrases, contents are fetched for the best k.

Which tables count is said by the last of the numbered files in `pointers`. Each is written whole under another name and then renamed to its number, which fails if
that number is taken; so a writer that dies leaves the last state, and of two writers one is told.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import IndexConflict, SearchSyntax
from lodestone.session import share_code, spread

from .positions import with_positions

#: First and last code points of the ideographs that are written without blanks.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
#: The same as the inside of a character class, of regular expressions here and of Spark.
CJK_HERE = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)
_RUNS = re.compile(rf"([{CJK_HERE}]+)|([^{CJK_HERE}]+)")
_LATIN = re.compile(r"[^\W]+", re.U)
K1, B = 1.2, 0.75
#: Folders of postings, at least and at most; words for which there is one more, and documents for which a folder is written by one more task.
BUCKETS, MOST_BUCKETS, WORDS_EACH, DOCS_EACH = 32, 8192, 20_000_000, 5_000_000
#: Columns of a document that its postings have too, and how the tables of an index are compressed.
KEPT, CODEC = ("length", "file_type"), "zstd"
#: Tasks that write postings, at most.
TASKS = 10_000
#: Leading characters of a term whose shortened forms stand for it, and the edits that a typo-tolerant term may have.
LEAD, EDITS = 6, 2
#: Terms of prefix and typo-tolerant leaves that are looked up by name; more are joined.
LISTED = 5000
#: Rows whose contents are fetched at once when pages are read on and on.
FETCHED = 1000


def bigrams(run: str) -> list[str]:
    """Pairs of neighbouring characters; one character is its own token."""
    letters = "".join(c for c in run if c.isalnum())
    return [letters] if len(letters) == 1 else [letters[i : i + 2] for i in range(len(letters) - 1)]


def tokenize(text: str, segment: Callable[[str], list[str]] = bigrams) -> list[str]:
    """The same as tokens(), on one string of the driver."""
    out: list[str] = []
    for cjk, other in _RUNS.findall(text.lower()):
        out += segment(cjk) if cjk else _LATIN.findall(other)
    return out


def tokens(text: Column) -> Column:
    """Tokens of a text in order: words of letters, digits and _ in lower case, bigrams of runs without blanks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit(rf"(?:(?![{CJK}])[\p{{L}}\p{{N}}_])+|(?:(?=[{CJK}])[\p{{L}}\p{{N}}])+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(rf"^[{CJK}]"), pairs(r)).otherwise(F.array(r))))
    # the script of Han has all letters of the ranges, and is the quicker test
    return F.when(low.rlike(r"\p{IsHan}"), mixed).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


# ---------------------------------------------------------------- queries


@dataclass
class Node:
    kind: str  # term, phrase, prefix, fuzzy, and, or, not
    words: tuple[str, ...] = ()
    parts: list[Node] = field(default_factory=list)


_LEX = re.compile(r'\s*(?:(?P<quote>"(?P<phrase>[^"]*)")|(?P<paren>[()])|(?P<sign>[+-])(?=\S)|(?P<word>[^\s()"]+))')


def analyze(query: str) -> tuple[str, str]:
    """(kind, text) of a query: prefix for word*, fuzzy for ~word, standard for the rest."""
    q = query.strip()
    if q.endswith("*") and len(q) > 1 and " " not in q:
        return "prefix", q[:-1]
    if q.startswith("~") and len(q) > 1 and " " not in q:
        return "fuzzy", q[1:]
    return "standard", q


def parse(query: str) -> Node | None:
    """The tree of a query; None if nothing in it can be searched. Words are joined by OR; + asks for one, - forbids it."""
    if query.count('"') % 2:
        raise SearchSyntax("a quote is not closed")
    items = [m for m in _LEX.finditer(query.strip()) if m[0].strip()]
    at = 0

    def leaf(text: str, phrase: bool) -> Node | None:
        kind, word = ("standard", text) if phrase else analyze(text)
        words = tuple(tokenize(word))
        if not words:
            return None
        if kind != "standard" and len(words) == 1:
            return Node(kind, words)
        return Node("term", words) if len(words) == 1 else Node("phrase", words)

    def group() -> Node | None:
        """Up to a closing parenthesis or the end."""
        nonlocal at
        must, should, never, join = [], [], [], None
        while at < len(items) and items[at]["paren"] != ")":
            m = items[at]
            sign, neg = "", False
            if m["word"] in ("AND", "OR"):
                if not must and not should:
                    raise SearchSyntax(f"{m['word']} begins a group")
                join = m["word"]
                at += 1
                continue
            if m["word"] == "NOT":
                neg = True
                at += 1
            elif m["sign"]:
                sign = m["sign"]
                at += 1
            if at >= len(items):
                raise SearchSyntax("the query ends too early")
            m = items[at]
            if m["paren"] == "(":
                at += 1
                node = group()
                if at >= len(items) or items[at]["paren"] != ")":
                    raise SearchSyntax("a parenthesis is not closed")
                at += 1
            elif m["paren"] == ")" or m["sign"]:
                raise SearchSyntax("an operator without a word")
            else:
                at += 1
                node = leaf(m["phrase"] if m["quote"] else m["word"], bool(m["quote"]))
            if node is None:
                join = None
                continue
            if neg or sign == "-":
                never.append(node)
            elif sign == "+":
                must.append(node)
            elif join == "AND" and should:
                should[-1] = Node("and", parts=[should[-1], node])
            else:
                should.append(node)
            join = None
        if not must and not should:
            return None
        any_of = should[0] if len(should) == 1 else Node("or", parts=should) if should else None
        out = Node("and", parts=[*must, *([Node("maybe", parts=[any_of])] if any_of and must else [any_of] if any_of else [])])
        out = out.parts[0] if len(out.parts) == 1 else out
        return Node("and", parts=[out, *[Node("not", parts=[n]) for n in never]]) if never else out

    tree = group()
    if at < len(items):
        raise SearchSyntax("a parenthesis too many")
    return tree


def leaves(node: Node) -> list[Node]:
    return [node] if not node.parts else [x for p in node.parts for x in leaves(p)]


def _distances(word: str, most: int):
    """Distances of terms from a word, in batches."""

    def of(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: damerau(t, word, most)).astype("int32")

    return F.pandas_udf(of, T.IntegerType())


def damerau(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance; most + 1 if over most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            cost = a[i - 1] != b[j - 1]
            if not cost:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


# ---------------------------------------------------------------- index


#: Rows of an Arrow batch of postings.
POSTED = 1 << 17
#: Rows and bytes of postings from which on they are packed for a shuffle.
PACKED, PACKED_BYTES = 1 << 20, 64 << 20


def postings_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, tf, positions, ...) of each document, positions from 0. A document is one row, so its terms are grouped where it lies: no shuffle."""
    each = taken_apart(docs, id_col, text_col, keep)
    kinds = {f.name: f.dataType for f in each.schema}
    out = T.StructType().add("term", T.StringType()).add("doc_id", kinds["doc_id"]).add("tf", T.LongType()).add("positions", T.ArrayType(T.IntegerType()))
    for c in keep:
        out = out.add(c, kinds[c])
    return each.mapInArrow(_posted, out)


def taken_apart(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ..., tokens): what _posted takes."""
    share_code(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), *keep, tokens(F.col(text_col)).alias("tokens"))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a batch sorted by document, term and place; a run of them is a posting."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        words = lists.flatten()
        if not len(words):
            continue
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = words.dictionary_encode()
        code, size = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
        key = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * size + code
        bits = len(key).bit_length()
        if (len(counts) * size).bit_length() + bits < 63:  # sorts faster than their places do
            key = np.sort(key << bits | np.arange(len(key)))
            place = key & ((1 << bits) - 1)
            key >>= bits
        else:
            place = np.argsort(key, kind="stable")
            key = key[place]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        row, term = np.divmod(key[first], size)
        stop = np.append(first[1:], len(key))
        place = (place - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)  # keys go by documents, so tokens stay in theirs
        for at in range(0, len(first), POSTED):
            to = min(at + POSTED, len(first))
            offsets = np.append(first[at:to], stop[to - 1])
            spots = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(place[offsets[0] : offsets[-1]]))
            rows = pa.array(row[at:to])
            found = [words.dictionary.take(pa.array(term[at:to])), b.column(0).take(rows), pa.array(stop[at:to] - first[at:to]), spots, *[b.column(k).take(rows) for k in range(1, b.num_columns - 1)]]
            yield pa.RecordBatch.from_arrays(found, ["term", "doc_id", "tf", "positions", *b.schema.names[1:-1]])


def _packer(buckets: int, tasks: int, of_tokens: bool):
    """Batches of postings, or of what _posted takes, -> (bucket, deal, size, rows): what goes to a task of a folder, as one compressed Arrow stream of that many bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in _posted(batches) if of_tokens else batches:
            held.append(b)
            size += b.nbytes
            if size >= PACKED_BYTES or sum(x.num_rows for x in held) >= PACKED:
                yield from _packed(held, buckets, tasks)
                held, size = [], 0
        yield from _packed(held, buckets, tasks)

    return pack


def _packed(held: list[pa.RecordBatch], buckets: int, tasks: int) -> Iterator[pa.RecordBatch]:
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held).combine_chunks()
    terms, docs = (table.column(c).chunk(0).dictionary_encode() for c in ("term", "doc_id"))
    of_term = np.array([bucket_of(t, buckets) for t in terms.dictionary.to_pylist()])
    of_doc = np.array([xxhash.xxh64_intdigest(str(d)) % tasks for d in docs.dictionary.to_pylist()])
    place = of_term[terms.indices.to_numpy()] * tasks + of_doc[docs.indices.to_numpy()]
    place = place.astype(np.uint16) if buckets * tasks <= 1 << 16 else place  # sorts faster
    order = np.argsort(place, kind="stable")  # documents stay together
    place = place[order].astype(np.int64)
    table = table.take(pa.array(order))
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    parts = [_bytes(table.slice(a, b - a)) for a, b in zip(first, np.append(first[1:], len(place)), strict=True)]
    of, deal = np.divmod(place[first], tasks)
    found = [pa.array(of.astype(np.int32)), pa.array(deal.astype(np.int32)), pa.array([n for n, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())]
    yield pa.RecordBatch.from_arrays(found, ["bucket", "deal", "size", "rows"])


def _bytes(table: pa.Table) -> tuple[int, bytes]:
    """Texts as numbers of a dictionary; the size is that before compression."""
    table = pa.table({c: x.combine_chunks().dictionary_encode() if c == "doc_id" or pa.types.is_string(x.type) else x for c, x in zip(table.column_names, table.columns, strict=True)})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    data = out.getvalue()
    return data.size, pa.compress(data, "zstd", asbytes=True)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for of, size, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "size", "rows")), strict=True):
            for part in pa.ipc.open_stream(pa.decompress(data, size, "zstd")):
                columns = [x.dictionary_decode() if pa.types.is_dictionary(x.type) else x for x in part.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(part.num_rows, of, np.int32))], [*part.schema.names, "bucket"])


def bm25(tf: Column, df: Column, length: Column, docs: Column, average: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """The folder of a term: what the column expression of bucket() gives."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def bucket(term: Column | str = "term", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def buckets_for(words: float) -> int:
    return int(min(MOST_BUCKETS, max(BUCKETS, words // WORDS_EACH)))


def shortened(term: Column) -> Column:
    """Forms of a term: its first LEAD characters with up to EDITS (two) of them deleted, cut to LEAD - EDITS.

    Two terms within EDITS edits share a form: deleting what the edits touch leaves a common sequence, whose beginning both can be cut to. Two places of LEAD are
    left out in all ways; a place behind the end of a short term deletes nothing.
    """
    part = lambda a, b: F.substring(term, F.lit(a + 1), F.lit(max(0, b - a)))
    return F.array_distinct(F.array(*[F.concat(part(0, i), part(i + 1, j), part(j + 1, LEAD)) for j in range(LEAD) for i in range(j)]))


def forms(term: str) -> list[str]:
    """The same of one term on the driver."""
    out, last = {term[:LEAD]}, {term[:LEAD]}
    for _ in range(EDITS):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out |= last
    return sorted({x[: LEAD - EDITS] for x in out})


def indexed(docs: DataFrame, path_col: str = "path", text_col: str = "content", type_col: str | None = None, max_bytes: int = 100 << 20) -> DataFrame:
    """(path, content, file_type, [size, modified,] doc_id, length) of the documents that are indexed: of rows with one path the last modified; no texts over
    max_bytes and none with NUL in the first 8000 characters."""
    kind = F.col(type_col) if type_col else F.lower(F.regexp_extract(F.col(path_col).cast("string"), r"\.([^./]+)$", 1))
    extra = [c for c in ("size", "modified") if c in docs.columns]
    rows = docs.select(F.col(path_col).alias("path"), F.col(text_col).alias("content"), kind.alias("file_type"), *extra)
    rows = rows.where(F.col("content").isNotNull() & (F.octet_length("content") <= max_bytes) & (F.instr(F.substring("content", 1, 8000), "\x00") == 0))
    if "modified" in extra:
        rows = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "modified").alias("x")).select("path", "x.*")
    return rows.withColumn("doc_id", F.col("path")).withColumn("length", F.size(tokens(F.col("content"))).cast("bigint"))


class TextIndex:
    """Search over postings; build() makes the tables in memory, save() and open() keep them in a folder."""

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, stats: tuple[int, float] | None = None, terms: DataFrame | None = None, near: DataFrame | None = None, fresh: DataFrame | None = None, buckets: int = BUCKETS):
        """postings, stats: those of docs unless given; near: the saved forms of terms; fresh: terms (term) that are not in it; buckets: of saved postings."""
        self.docs, self._stats, self._derived = docs, stats, postings is None
        self.postings = postings = _postings(docs) if postings is None else postings
        self.terms = postings.groupBy("term").agg(F.count("*").alias("df")) if terms is None else terms
        self.near, self.fresh, self.buckets = near, fresh, buckets

    @staticmethod
    def build(docs: DataFrame, path_col: str = "path", text_col: str = "content", type_col: str | None = None, max_bytes: int = 100 << 20) -> TextIndex:
        """docs: one row a document; what is left out: see indexed()."""
        return TextIndex(indexed(spread(docs), path_col, text_col, type_col, max_bytes))

    @property
    def stats(self) -> tuple[int, float]:
        """Number of documents and their average length; counted when first asked for."""
        if self._stats is None:
            self._stats = _counted(self.docs)
        return self._stats

    def delete(self, paths: DataFrame) -> TextIndex:
        """Without the documents of these paths (path); paths that are not there change nothing."""
        gone = paths.select(F.col("path").alias("gone")).distinct()
        rows = self.docs.join(gone, F.col("path") == F.col("gone"), "left_anti")
        return TextIndex(rows, self.postings.join(gone, F.col("doc_id") == F.col("gone"), "left_anti"))

    def save(self, folder: str, name: str | None = None, after: int | None = None) -> str:
        """A new generation beside earlier ones; a pointer names it once it is whole. after: the number of the pointer that this one replaces."""
        spark = self.docs.sparkSession
        name = name or f"gen-{uuid.uuid4().hex}"
        after = pointed(spark, folder)[0] if after is None else after
        self.docs.write.parquet(f"{folder}/{name}/docs", compression=CODEC)
        docs = spark.read.schema(self.docs.schema).parquet(f"{folder}/{name}/docs")
        if self._stats is None:  # from the lengths that are there now; texts are taken apart once more for postings only
            self._stats = _counted(docs)
        n, average = self.stats
        buckets = buckets_for(n * average)
        write_postings(self.postings, f"{folder}/{name}", buckets, n, taken_apart(docs, keep=KEPT) if self._derived else None)
        kept = spark.read.schema(placed_schema(self.postings)).parquet(f"{folder}/{name}/postings")
        kept.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/{name}/terms", compression=CODEC)
        near = spark.read.schema("term string, df bigint").parquet(f"{folder}/{name}/terms").select(F.explode(shortened(F.col("term"))).alias("variant"), "term")
        near.withColumn("bucket", bucket("variant", buckets)).repartition("bucket").sortWithinPartitions("bucket", "variant").write.partitionBy("bucket").parquet(f"{folder}/{name}/near", compression=CODEC)
        spark.createDataFrame([(*self.stats, buckets)], _STATS).write.parquet(f"{folder}/{name}/stats")
        point(spark, folder, name, after)
        return name

    @staticmethod
    def open(spark: SparkSession, folder: str) -> TextIndex:
        """The generation that the last pointer names, with the deltas that it lists: of a path the rows of its last delta count."""
        base, *deltas = pointed(spark, folder)[1]
        s = spark.read.parquet(f"{folder}/{deltas[-1] if deltas else base}/stats").first()
        tables = [live(spark, folder, [base, *deltas], name) for name in ("docs", "postings")]
        terms, near, fresh = None, None, None
        kept = [spark.read.schema("term string, df bigint").parquet(f"{folder}/{x}/terms") for x in (base, *deltas) if x != NO_BASE]
        terms = kept[0] if not deltas else functools.reduce(DataFrame.unionByName, kept).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        if base != NO_BASE:
            near = spark.read.schema("variant string, term string, bucket int").parquet(f"{folder}/{base}/near")
            fresh = functools.reduce(DataFrame.unionByName, kept[1:]).select("term").distinct() if deltas else None
        return TextIndex(tables[0], tables[1], (s.docs, s.average), terms, near, fresh, s.buckets)

    def doc_count(self) -> int:
        return self.stats[0]

    def vocabulary(self) -> DataFrame:
        return self.terms

    def expand(self, node: Node) -> DataFrame:
        """(term, distance) of all vocabulary terms of a prefix or fuzzy leaf."""
        word = node.words[0]
        if node.kind == "prefix":
            return self.terms.where(F.col("term").startswith(word)).select("term").withColumn("distance", F.lit(0))
        # a transposition costs at most two edits, so two of them at most four
        close = lambda terms: terms.where(F.levenshtein(F.col("term"), F.lit(word), 2 * EDITS) >= 0).select("term")
        if self.near is None:
            found = close(self.terms)
        else:
            own = forms(word)
            found = close(self.near.where(F.col("bucket").isin(sorted({bucket_of(x, self.buckets) for x in own})) & F.col("variant").isin(own)))
            found = (found if self.fresh is None else found.unionByName(close(self.fresh))).distinct()
        return found.withColumn("distance", _distances(word, EDITS)("term")).where(F.col("distance") <= EDITS)

    def scores(self, query: str | Node, file_type: str | None = None) -> DataFrame | None:
        """(doc_id, score) of all documents that match; None if nothing in the query can be searched."""
        node = parse(query) if isinstance(query, str) else query
        spark = self.docs.sparkSession
        if node is None:
            return None
        every = leaves(node)
        names = {id(x): k for k, x in enumerate(every)}
        open_ended = [x for x in every if x.kind in ("prefix", "fuzzy")]
        fixed = [x for x in every if x.kind not in ("prefix", "fuzzy")]
        words = sorted({w for x in fixed for w in x.words})
        hits = self.postings if file_type is None else self.postings.where(F.col("file_type") == file_type)
        n, average = self.stats
        if open_ended:
            # (term, leaves that it matches, distance to the nearest fuzzy leaf), over the vocabulary
            sought = [self.expand(x).select("term", F.lit(names[id(x)]).alias("leaf"), F.col("distance") if x.kind == "fuzzy" else F.lit(None).cast("int").alias("distance")) for x in open_ended]
            sought += [spark.createDataFrame([(w, names[id(x)], None) for x in fixed for w in x.words], "term string, leaf int, distance int")] if fixed else []
            terms = functools.reduce(DataFrame.unionByName, sought).groupBy("term").agg(F.collect_set("leaf").alias("leaves"), F.min("distance").alias("distance"))
            listed = terms.limit(LISTED + 1).collect()
            if len(listed) <= LISTED:  # by name, so that only their folders are read
                found = [r.term for r in listed]
                hits = self._hits(hits, found)
                counts = {r.term: r.df for r in self.terms.where(F.col("term").isin(found)).collect()}
                rows = [(r.term, counts[r.term], list(r.leaves), r.distance) for r in listed if r.term in counts]
                hits = hits.join(F.broadcast(spark.createDataFrame(rows, "term string, df bigint, leaves array<int>, distance int")), "term")
            else:
                hits = hits.join(terms.join(self.terms, "term"), "term")
        else:
            of_word = {w: sorted({names[id(x)] for x in fixed if w in x.words}) for w in words}
            hits = self._hits(hits, words)
            counts = {r.term: r.df for r in self.terms.where(F.col("term").isin(words)).collect()}  # one number for each word of the query
            case = F.create_map(*[x for w in words for x in (F.lit(w), F.struct(F.lit(counts.get(w, 0)).cast("bigint").alias("df"), F.array(*map(F.lit, of_word[w])).alias("leaves")))])
            hits = hits.withColumn("x", case[F.col("term")]).select("*", "x.df", "x.leaves", F.lit(None).cast("int").alias("distance"))
        of = lambda nodes: F.arrays_overlap("leaves", F.array(*[F.lit(names[id(x)]) for x in nodes]).cast("array<int>"))
        score = bm25(F.col("tf"), F.col("df"), F.col("length"), F.lit(float(n)), F.lit(float(average) or 1.0))
        score = F.when(of(_negated(node)) & ~of(_wanted(node)), 0.0).otherwise(score) if _negated(node) else score
        phrased = sorted({w for x in fixed if x.kind == "phrase" for w in x.words})
        nowhere = F.array().cast("array<int>")
        positions = F.when(F.col("term").isin(phrased), F.col("positions")).otherwise(nowhere) if phrased else nowhere  # not even read without phrases
        placed = F.when(F.col("term").isin(words), F.struct("term", positions.alias("positions")))  # collect_list leaves nulls out
        per = hits.groupBy("doc_id").agg(F.sum(score).alias("score"), F.map_from_entries(F.collect_list(placed)).alias("has"), F.array_distinct(F.flatten(F.collect_set("leaves"))).alias("leaves"), F.min(F.coalesce("distance", F.lit(0))).alias("distance"))
        if any(x.kind == "fuzzy" for x in every):
            per = per.withColumn("score", F.col("score") - F.col("distance") * 1000.0)
        return per.where(self._matches(node, names)).select("doc_id", "score")

    def _hits(self, postings: DataFrame, words: list[str]) -> DataFrame:
        """Postings of some terms, from the folders of these terms."""
        some = postings.where(F.col("term").isin(words))
        return some.where(F.col("bucket").isin(sorted({bucket_of(w, self.buckets) for w in words}))) if "bucket" in postings.columns else some

    def search(self, query: str | Node, k: int = 100, file_type: str | None = None, offset: int = 0) -> DataFrame:
        """(doc_id, score, path, file_type, content): the best k documents after the first `offset`. Fuzzy matches are ordered by their distance first."""
        found = self.scores(query, file_type)
        if found is None:
            return self.docs.select("doc_id", F.lit(0.0).alias("score"), "path", "file_type", "content").limit(0)
        best = found.orderBy(F.desc("score"), "doc_id")
        best = best.offset(offset).limit(k) if offset else best.limit(k)
        # contents of the best only
        best = F.broadcast(best) if k <= 10_000 else best
        return best.join(self.docs, "doc_id").select("doc_id", "score", "path", "file_type", "content").orderBy(F.desc("score"), "doc_id")

    def placed(self, query: str | Node, size: int = 50, file_type: str | None = None) -> DataFrame:
        """(doc_id, score, place, page) of all hits, both from 0, in the order of search(): scored and sorted once, whatever the number of pages."""
        found = self.scores(query, file_type)
        if found is None:
            found = self.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        return with_positions(found, [F.desc("score"), "doc_id"], "place").withColumn("page", F.floor(F.col("place") / size))

    def pages(self, query: str | Node, size: int = 50, file_type: str | None = None) -> Iterator[list]:
        """The hits in order, page after page; the order is total, so no hit is on two pages. Contents are fetched for 1, 2, 4, ... pages at a time, up to FETCHED rows."""
        hits, page, many = self.placed(query, size, file_type), 0, 1
        while True:
            some = F.broadcast(hits.where((F.col("page") >= page) & (F.col("page") < page + many)))
            rows = some.join(self.docs, "doc_id").orderBy("place").select("doc_id", "score", "path", "file_type", "content").collect()
            yield from (rows[k : k + size] for k in range(0, len(rows), size))
            if len(rows) < many * size:
                return
            page, many = page + many, max(1, min(2 * many, FETCHED // size))

    def _matches(self, node: Node, names: dict[int, int]) -> Column:
        has = F.col("has")
        if node.kind == "term":
            return F.map_contains_key(has, node.words[0])
        if node.kind in ("prefix", "fuzzy"):
            return F.array_contains("leaves", names[id(node)])
        if node.kind == "phrase":
            present = F.lit(True)
            for w in node.words:
                present = present & F.map_contains_key(has, w)
            at = has[node.words[0]]
            for k, w in enumerate(node.words[1:], 1):
                at = F.array_intersect(at, _shifted(has[w], k))
            return present & (F.size(at) > 0)
        parts = [self._matches(p, names) for p in node.parts]
        if node.kind == "not":
            return ~parts[0]
        if node.kind == "maybe":
            return F.lit(True)
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.kind == "and" else out | p
        return out


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _negated(node: Node) -> list[Node]:
    return [y for p in node.parts for y in (leaves(p) if p.kind == "not" else _negated(p))]


def _wanted(node: Node) -> list[Node]:
    return [node] if not node.parts else [y for p in node.parts if p.kind != "not" for y in _wanted(p)]


def _postings(docs: DataFrame) -> DataFrame:
    return postings_of(docs, keep=KEPT)


def _counted(docs: DataFrame) -> tuple[int, float]:
    n, average = docs.agg(F.count("*"), F.avg("length")).first()
    return n, average or 0.0


def write_postings(postings: DataFrame, folder: str, buckets: int = BUCKETS, n: int = 0, tokens: DataFrame | None = None) -> None:
    """buckets: folders of postings; n: documents, as a term may be in all of them, so its folder is dealt to as many tasks as that takes. tokens: what postings_of
    makes the postings of, which are packed where they are made then."""
    tasks = max(4, -(-n // DOCS_EACH))
    rows = postings.drop("bucket")
    packed = (rows if tokens is None else tokens).mapInArrow(_packer(buckets, tasks, tokens is not None), "bucket int, deal int, size int, rows binary")
    placed = packed.repartition(min(buckets * tasks, TASKS), "bucket", "deal").mapInArrow(_unpacked, placed_schema(rows))
    placed.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings", compression=CODEC)


def placed_schema(postings: DataFrame) -> T.StructType:
    """The kinds of saved postings: a folder without rows has no files to tell."""
    return T.StructType([f for f in postings.schema if f.name != "bucket"]).add("bucket", T.IntegerType())


#: Stands for the generation of an index that has deltas only.
NO_BASE = "none"


def live(spark: SparkSession, folder: str, names: list[str], table: str, newest: DataFrame | None = None) -> DataFrame:
    """The rows that count of docs or postings of a generation and its deltas: of a path those of its last delta. Nothing is later than the last delta, so its rows
    are joined with nothing. newest: these rows, where they are not saved."""
    key = {"docs": "path", "postings": "doc_id"}[table]
    base, *deltas = names
    saved = lambda name: spark.read.parquet(f"{folder}/{name}/{table}")
    if not deltas:
        return saved(base)
    parts = []
    if names[:-1] != [NO_BASE]:
        each = [spark.read.parquet(f"{folder}/{d}/ops").select("path", F.lit(n).alias("n")) for n, d in enumerate(deltas)]
        last = functools.reduce(DataFrame.unionByName, each).groupBy(F.col("path").alias("changed")).agg(F.max("n").alias("last"))
        for n, d in enumerate([base, *deltas[:-1]], -1):
            if d != NO_BASE:
                later = last.where(F.col("last") > n)
                parts.append(_left(saved(d), later) if table == "docs" else saved(d).join(later, F.col(key) == F.col("changed"), "left_anti"))
    parts.append(saved(deltas[-1]) if newest is None else newest)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _left(saved: DataFrame, later: DataFrame) -> DataFrame:
    """Saved documents without those of the paths (changed). Texts are not shuffled: paths tell the places of the rows to leave out, which go to all tasks as a bit a row."""
    at = F.col("_metadata.row_index")
    placed = saved.select("*", F.col("_metadata.file_path").alias("file"), F.shiftright(at, 15).alias("block"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("place"))
    gone = placed.select("path", "file", "block", "place").join(later, F.col("path") == F.col("changed"), "left_semi")
    bits = gone.groupBy("file", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright("place", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    stays = F.col("bits").isNull() | (F.getbit(byte, F.col("place").bitwiseAND(F.lit(7)).cast("int")) == 0)
    return placed.join(F.broadcast(bits), ["file", "block"], "left").where(stays).select(*saved.columns)


_STATS = "docs bigint, average double, buckets int"
#: Pointers that are kept; older ones are deleted.
POINTERS = 20


def pointed(spark: SparkSession, folder: str) -> tuple[int, list[str]]:
    """(number, names) of the last pointer: the generation and its deltas; (0, []) before the first."""
    fs, at = _pointers(spark, folder)
    if not fs.exists(at):
        return 0, []
    last = max((int(n) for f in fs.listStatus(at) if (n := f.getPath().getName()).isdigit()), default=0)
    if not last:
        return 0, []
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(at, _number(last)))
    try:
        return last, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def point(spark: SparkSession, folder: str, names: str, after: int) -> None:
    """Pointer number after + 1: written under another name, then renamed; IndexConflict if there is such a one."""
    jvm, (fs, at) = spark._jvm, _pointers(spark, folder)
    fs.mkdirs(at)
    new, target = jvm.org.apache.hadoop.fs.Path(at, f"new-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(at, _number(after + 1))
    out = fs.create(new, False)
    out.write(bytearray(names.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:  # this rename never replaces
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(new, target, spark.sparkContext._gateway.new_array(rename, 0))
    except Py4JJavaError as e:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise IndexConflict(f"the index {folder} has been changed by another writer", "open it again and repeat the change") from e
        raise
    for f in fs.listStatus(at):
        n = f.getPath().getName()
        if n.isdigit() and int(n) <= after + 1 - POINTERS:
            fs.delete(f.getPath(), False)


def _number(n: int) -> str:
    return f"{n:012d}"


def _pointers(spark: SparkSession, folder: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def index_location(given: str | None = None, project: str = ".", home: str = "~/.lodestone/index") -> str:
    """Where an index is: the folder given, else that of the project if there is one, else the one at home."""
    own = os.path.join(project, ".lodestone", "index")
    return given or (own if os.path.isdir(own) else os.path.expanduser(home))


def snippet(text: Column, words: list[str], width: int = 150, before: str = "<b>", after: str = "</b>") -> Column:
    """The surroundings of the first hit, hits marked."""
    pattern = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) or "(?!)"
    first = F.regexp_instr(F.lower(text), F.lit(rf"(?i)(?:{pattern})"))
    piece = F.substring(text, F.greatest(F.lit(1), first - width // 3), F.lit(width))
    return F.when(first > 0, F.regexp_replace(piece, rf"(?i)({pattern})", f"{before}$1{after}"))


def line_column(text: Column, words: list[str]) -> tuple[Column, Column]:
    """Line and column, from 1, of the first hit; null without one."""
    pattern = "|".join(re.escape(w) for w in words) or "(?!)"
    first = F.regexp_instr(F.lower(text), F.lit(rf"(?:{pattern})"))
    above = F.substring(text, F.lit(1), first - 1)
    line = F.size(F.split(above, "\n", -1))
    column = F.length(F.substring_index(above, "\n", -1)) + 1
    return F.when(first > 0, line), F.when(first > 0, column)
