"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

All of it is DataFrame functions. Words are runs of letters and digits in lower case, shingles are five words (a
shorter text is one shingle of all its words), and similarity is the weighted Jaccard of shingle counts.

1. The shingles of every document meet the set of benchmark shingles; only positions that match go on. A window of an
   item's size that is similar enough holds a minimum of such positions, and the best such window can be taken to
   begin at one of them (a window that begins elsewhere loses nothing when moved right up to it), so the windows of
   that many matches that begin at a match are all that can pass.
2. Equal windows, of however many documents, are one from here on. Each gets a 64-bit SimHash weighted by shingle
   counts. Fingerprints within ``radius`` bits agree in at least one of ``radius + 1`` blocks, so an equi-join on size,
   block number and block value finds all of them among the items of that size. At a similarity of 0.8 the blocks have
   three bits and alone select little; the differing bits of a pair that met, counted next, pass one pair of unrelated
   texts in some thousand.
3. The exact weighted similarity of the window and the item decides.

The benchmark's tables are written, counted, weighed and broadcast only below the bounds of ``small_side``; beyond them
the joins shuffle. Texts are split whole once, and only those of candidates again. Only matching positions and windows
are shuffled, never texts: a passage that many documents share costs each of them a few windows. Null texts and texts
without words match nothing, on either side; repeated rows are found like any other and give their id once; rows with a
null id are searched like any other; texts of any length are read whole; an empty table on either side gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.plans.storage import saved, small_side

#: Differing bits of 64. Texts of similarity 0.8 differ in 9 on average with a standard deviation of 3.
RADIUS = 20


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_count(hashes: Column, words: int) -> Column:
    """How many shingles a text has: at least one if it has a word."""
    return F.when(F.size(hashes) == 0, 0).otherwise(F.greatest(F.size(hashes) - (words - 1), F.lit(1)))


def shingles(hashes: Column, words: int) -> Column:
    """The hashes of a text's shingles, in order, repeats included."""
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), shingle_count(hashes, words)), lambda i: F.xxhash64(F.slice(hashes, i, words))))


def simhash(hashes: Column) -> Column:
    """A 64-bit fingerprint: a bit is 1 if over half of the hashes have it."""
    ones = lambda bit: F.size(F.filter(hashes, lambda h: F.getbit(h, bit) == 1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, bit: acc.bitwiseOR(F.when(ones(bit) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The values of ``radius + 1`` blocks of bits; fingerprints within the radius agree in one of them."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])])


def weighted_overlap(a: Column, b: Column) -> Column:
    """The sum over distinct hashes of the smaller of their two counts."""
    times = lambda all_, h: F.size(F.filter(all_, lambda x: x == h))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))


def _key(id_: Column, text: Column) -> list[Column]:
    """A row's key: its id and two hashes of its text, so that ids may be null or stand on several texts."""
    return [id_.alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


KEY = ["id", "t1", "t2"]


def _same_key(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.t1") == F.col(f"{b}.t1")) & (F.col(f"{a}.t2") == F.col(f"{b}.t2"))


def _found(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, words: int, similarity: float, radius: int) -> DataFrame:
    """``(id, t1, t2, item, similarity, start)``: the windows of each row that an item is similar enough to."""
    items = benchmark.select(F.col(item_col).alias("item"), _once(word_hashes(F.col(item_text_col)), lambda wh: shingles(wh, words)).alias("of_item")).where(F.size("of_item") > 0)
    items = saved(items.select("item", "of_item", F.size("of_item").alias("m"), _once(F.col("of_item"), simhash).alias("item_fp")))
    items = saved(items.withColumn("no", F.monotonically_increasing_id()))  # item ids may be null or repeat
    sizes = small_side(items.select("m", F.explode("of_item").alias("h")).groupBy("h").agg(F.collect_set("m").alias("sizes")))

    texts = documents.select(*_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    docs = texts.select(*KEY, _once(word_hashes(F.col("text")), lambda wh: F.struct(shingle_count(wh, words).alias("total"), shingles(wh, words).alias("hashes"))).alias("s"))
    matches = docs.select(*KEY, F.col("s.total").alias("total"), F.posexplode("s.hashes").alias("at", "h")).join(sizes, "h")
    found = matches.select(*KEY, "total", (F.col("at") + 1).alias("pos"), F.explode("sizes").alias("m")).groupBy(*KEY, "m").agg(F.max("total").alias("total"), F.sort_array(F.collect_set("pos")).alias("at"))
    need = F.ceil(F.lit(similarity) * (F.least("total", "m") + F.col("m")) / F.lit(1 + similarity) - F.lit(1e-9)).cast("int")
    found = found.withColumn("need", need).where(F.size("at") >= F.col("need"))
    last = F.greatest(F.col("total") - F.col("m") + 1, F.lit(1))
    full = F.filter(F.col("at"), lambda p, i: F.get(F.col("at"), i + F.col("need") - 1) < p + F.col("m"))
    starts = F.array_distinct(F.transform(full, lambda p: F.least(p, last)))
    candidates = small_side(found.select(*KEY, "m", starts.alias("starts")).where(F.size("starts") > 0))

    # only the texts of candidates are split again
    chosen = texts.alias("d").join(candidates.alias("c"), _same_key("d", "c")).select(*[f"c.{k}" for k in KEY], "m", "starts", "text")
    cut = lambda wh: F.transform("starts", lambda p: F.struct(p.alias("start"), _once(F.slice(wh, p, F.col("m") + (words - 1)), lambda part: shingles(part, words)).alias("of_doc")))
    windows = chosen.select(*KEY, "m", F.inline(_once(word_hashes(F.col("text")), cut)))
    windows = saved(windows.withColumns({"w1": F.xxhash64("of_doc"), "w2": F.xxhash64("of_doc", F.lit(1))}))
    # a passage that many rows share is one window from here on
    content = ["m", "w1", "w2"]
    distinct = saved(windows.groupBy(*content).agg(F.first("of_doc").alias("of_doc")).withColumn("fp", _once(F.col("of_doc"), simhash)))
    left = distinct.select(*content, "fp", F.posexplode(blocks(F.col("fp"), radius)).alias("block", "value"))
    right = small_side(items.select("m", "no", "item_fp", F.posexplode(blocks(F.col("item_fp"), radius)).alias("block", "value")))
    first = F.array_position(F.zip_with(blocks(F.col("fp"), radius), blocks(F.col("item_fp"), radius), lambda a, b: a == b), True) - 1
    near = left.join(right, ["m", "block", "value"]).where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (F.col("block") == first))
    both = near.select(*content, "no").join(distinct.select(*content, "of_doc"), content).join(small_side(items.select("no", "item", "of_item")), "no")
    overlap = weighted_overlap(F.col("of_doc"), F.col("of_item"))
    scored = both.withColumn("overlap", overlap).select(*content, "item", (F.col("overlap") / (F.size("of_doc") + F.size("of_item") - F.col("overlap"))).alias("similarity"))
    passed = small_side(scored.where(F.col("similarity") >= similarity - 1e-12))
    return windows.select(*KEY, "start", *content).join(passed, content).select(*KEY, "item", "similarity", "start")


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``(id_col, item_col, similarity, first_shingle)``: each benchmark item that a document holds, with the best window.

    Rows of one id and different texts are searched apart and reported under their id; rows with a null id are
    reported together under null.
    """
    scored = _found(documents, benchmark, id_col, text_col, item_col, item_text_col, words, similarity, radius)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.similarity", (-F.col("best.s")).alias("first_shingle"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows whose text holds no benchmark item, whatever their ids; all their columns as they are."""
    leaks = _found(documents, benchmark, id_col, text_col, item_col, item_text_col, words, similarity, radius)
    leaks = small_side(leaks.select(*[F.col(k).alias(f"__{k}") for k in KEY]).distinct())
    of_row = dict(zip(KEY, (F.col(id_col), F.xxhash64(F.col(text_col)), F.xxhash64(F.col(text_col), F.lit(1)))))
    same = of_row["id"].eqNullSafe(F.col("__id")) & (of_row["t1"] == F.col("__t1")) & (of_row["t2"] == F.col("__t2"))
    return documents.join(leaks, same, "left_anti")
