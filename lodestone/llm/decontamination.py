"""Operator 1, benchmark decontamination, with DataFrame functions only.

1. Five-word shingles of all documents meet the shingles of the benchmark items (broadcast after a count). An item and a text stay together if they share
   enough shingles anywhere for a similarity of 75 %; the starts that the shared shingles align to, and those between two near ones, name the windows
   of the size of the item.
2. Every such window gets a 64-bit SimHash of its shingles. A text with fewer words than the item is one window as a whole.
   A window and its item meet on any of BLOCKS equal blocks of the fingerprints, an equi-join on item and block: two fingerprints that differ in at most
   RADIUS = BLOCKS - 1 bits agree in a block. Of several blocks in which they agree the first one gives the pair, so no pair comes twice and none is
   shuffled. Those beyond the radius end here.
3. The others are verified: similarity is the weighted Jaccard index of the shingles, a shingle weighing as often as it occurs.

At 75 % the fingerprints differ in about 11 bits, by the angle of the two shingle vectors, with a deviation of 3; a radius of 23 leaves out one such pair
in 20,000 (of random fingerprints 1.6 % are within it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WIDTH, PERCENT, RADIUS = 5, 75, 23
BLOCKS = RADIUS + 1
#: Item shingles that are broadcast, at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Items whose fingerprints are broadcast with their shingles, and keys of contaminated texts that are, at most.
BROADCAST_ITEMS, BROADCAST_KEYS = 2000, 400_000
#: First bit of each block and the bit behind its last.
_CUTS = [(64 * k // BLOCKS, 64 * (k + 1) // BLOCKS) for k in range(BLOCKS)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(w: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles at each word; none if there are fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(F.size(w) >= width, each).otherwise(F.array().cast("array<bigint>"))


def simhash(h: Column) -> Column:
    """Bit j is set if more of the hashes have it than not."""
    bit = lambda j: F.aggregate(h, F.lit(0), lambda acc, x: acc + F.when(F.expr("1L") == F.shiftright(x, j).bitwiseAND(F.lit(1)), 1).otherwise(-1))
    out = F.lit(0).cast("long")
    for j in range(64):
        out = out.bitwiseOR(F.when(bit(j) > 0, F.lit(-(1 << 63) if j == 63 else 1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def blocks(fingerprint: Column) -> Column:
    """The blocks of a fingerprint as numbers that also name the block."""
    return F.array(*[(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(k * 65536)).cast("long") for k, (a, b) in enumerate(_CUTS)])


def first_equal(f: Column, g: Column) -> Column:
    """The number of the first block in which two fingerprints agree, null if they agree in none."""
    differ = f.bitwiseXOR(g)
    out = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(_CUTS))):
        out = F.when(F.shiftrightunsigned(differ, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0, k).otherwise(out)
    return out


def occurrences(h: Column) -> Column:
    """Each hash with how often it stood before, so that sets of them are multisets of hashes."""
    return F.transform(h, lambda x, i: F.struct(x.alias("h"), F.size(F.filter(F.slice(h, F.lit(1), i), lambda y: y == x)).alias("n")))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, m words, width of its shingles, h). Items under five words have one shingle, all their words; items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    width = F.least(F.size("w"), F.lit(WIDTH))
    h = shingles(F.col("w"))
    for k in range(1, WIDTH):
        h = F.when(F.size("w") == k, shingles(F.col("w"), k)).otherwise(h)
    return rows.select("item_id", F.size("w").alias("m"), width.alias("width"), h.alias("h")).distinct()


def text_key(text: Column) -> tuple[Column, Column]:
    """What names a text: its hash and its length in bytes."""
    return F.xxhash64(text), F.octet_length(text)


def matched_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(k, len, item_id, similarity, start_word, distance): the best window of each text, named by text_key, and item that are at least 75 % alike."""
    items = items_of(benchmark)
    text = F.col(text_col)
    keyed = docs.select(text.alias("text"), text_key(text)[0].alias("k"), text_key(text)[1].alias("len")).where("text is not null")
    # which widths there are: five, and fewer only for items that are shorter
    facts = items.groupBy("width").agg(F.sum(F.size("h")).alias("n"), F.count("*").alias("items")).collect()
    total, n_items = sum(r.n for r in facts), sum(r["items"] for r in facts)
    sought = items.select("item_id", "m", "width", F.posexplode("h").alias("q", "h"))
    sought = F.broadcast(sought) if total <= BROADCAST_ROWS else sought
    cut = keyed.select("k", "len", words(F.col("text")).alias("w"))
    seen = None
    for width in sorted({r.width for r in facts} | {WIDTH}):
        part = cut.select("k", "len", F.lit(width).alias("width"), F.size("w").alias("words"), F.posexplode(shingles(F.col("w"), width)).alias("p", "h"))
        seen = part if seen is None else seen.unionByName(part)
    hits = seen.join(sought, ["width", "h"])
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("words") - F.col("m")))
    # overlap / (n + n' - overlap) >= 0.75 with n shingles of the item and n' of the window, which is the whole of a text with fewer words
    both = F.col("m") + F.least("m", "words") - 2 * F.col("width") + 2
    need = F.ceil(both * PERCENT / (100 + PERCENT))
    near = hits.groupBy("k", "len", "item_id", "m", "width", "words").agg(F.count("*").alias("shared"), F.sort_array(F.collect_set(start)).alias("starts")).where(F.col("shared") >= need)
    between = F.flatten(F.transform("starts", lambda s, i: F.sequence(s, F.greatest(s, F.least(F.coalesce(F.get(F.col("starts"), i + 1) - 1, s), s + F.floor(F.col("m") / 4).cast("int"))))))
    near = stored(near.select("k", "len", "item_id", "m", "width", F.array_distinct(between).alias("starts")))
    keys = near.select(F.col("k").alias("k2"), F.col("len").alias("len2")).distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    # only texts that have windows move, one of equal ones
    texts = keyed.join(keys, F.expr("k = k2 and len = len2"), "left_semi").dropDuplicates(["k", "len"])
    found = texts.join(near, ["k", "len"]).select("k", "len", "item_id", "m", "width", F.explode("starts").alias("start"), words(F.col("text")).alias("w"))
    h = found.select("k", "len", "item_id", "m", "width", "start", F.slice("w", F.col("start") + 1, F.col("m")).alias("w"))
    own = shingles(F.col("w"))
    for width in sorted({r.width for r in facts} - {WIDTH}):
        own = F.when(F.col("width") == width, shingles(F.col("w"), width)).otherwise(own)
    h = h.select("k", "len", "item_id", "m", "start", own.alias("own")).withColumn("f", simhash(F.col("own")))
    probes = h.withColumn("block", F.explode(blocks(F.col("f"))))
    targets = items.select(F.col("item_id").alias("item"), F.col("m").alias("size"), F.col("h").alias("its"), simhash(F.col("h")).alias("g")).withColumn("block", F.explode(blocks(F.col("g"))))
    targets = F.broadcast(targets) if n_items <= BROADCAST_ITEMS and total <= BROADCAST_ROWS else targets
    same = F.col("item_id").eqNullSafe(F.col("item")) & (F.col("m") == F.col("size")) & (probes["block"] == targets["block"])
    pairs = probes.join(targets, same).where(F.floor(probes["block"] / 65536) == first_equal(F.col("f"), F.col("g")))
    pairs = pairs.withColumn("distance", F.bit_count(F.col("f").bitwiseXOR(F.col("g")))).where(F.col("distance") <= RADIUS)
    common = F.size(F.array_intersect(occurrences(F.col("own")), occurrences(F.col("its"))))
    scored = pairs.withColumn("common", common).withColumn("all", F.size("own") + F.size("its") - F.col("common")).where(F.col("common") * 100 >= F.col("all") * PERCENT)
    best = scored.groupBy("k", "len", "item_id").agg(F.max(F.struct((F.col("common") / F.col("all")).alias("similarity"), (-F.col("start")).alias("back"), F.col("distance"))).alias("b"))
    return best.select("k", "len", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start_word"), F.col("b.distance").cast("long").alias("distance"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, similarity, start_word, distance): the best window of each document and item that are at least 75 % alike.

    Null and wordless texts and items have no windows. Repeated documents and items give one row each pair of ids. A null doc_id or item_id is kept.
    Other columns are not looked at.
    """
    k, size = text_key(F.col(text_col))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), k.alias("k"), size.alias("len")).where("len is not null")
    found = keyed.join(matched_texts(docs, benchmark, text_col), ["k", "len"]).groupBy(F.col("doc_id").alias(id_col), "item_id")
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("back"), "distance")).alias("b")
    return found.agg(best).select(id_col, "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("start_word"), F.col("b.distance").alias("distance"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs without a benchmark item in their text, whatever their ids: rows that share an id, or have none, are judged by their own texts.

    The keys of contaminated texts are stored and counted: up to BROADCAST_KEYS they are broadcast, and no row of docs moves; more are joined by a shuffle.
    """
    bad = stored(matched_texts(docs, table(spark, sf_dir, "benchmark")).select(F.col("k").alias("bad_k"), F.col("len").alias("bad_len")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    k, size = text_key(docs["text"])
    return docs.join(bad, (k == bad["bad_k"]) & (size == bad["bad_len"]), "left_anti")
