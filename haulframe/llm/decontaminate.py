"""Benchmark passages in documents: a prefix-filtered set join.

A window is a run of item words as long as the contract asks (a shorter item is
one window). A window is seen as the set of its shingles. Exact containment needs
every shingle, so one necessary shingle per window is enough to find all
candidates: the one that is rarest in the corpus. Documents are joined with these
prefix shingles only. Length and place in the window bound what can match, and the
words of the document are then compared with those of the window one by one.

Texts that are equal count once: all work between the scan and the result is
per digest of a text, so a group of copies of any size costs as much as one text
per task. Only DataFrame functions are used.

The benchmark's shingles are broadcast below ``BROADCAST_WINDOWS`` windows (counted
before); a larger benchmark is joined by shuffle.

Defined results: a missing or wordless text has no words, no hits and is clean.
Rows that repeat get equal results, one per row. An item without words has no
window; an item without an id marks words but is not listed. Without benchmark
rows every document is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.storage import bounded, stored

# What a word is (ASCII letters and digits, anything beyond ASCII).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
#: Windows (of 13 words, a few hundred bytes each) that are still broadcast.
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _shingles(seq: str, n: int) -> Column:
    """Hashes of the runs of ``n`` words, in order; empty where there are fewer words."""
    starts = F.sequence(F.lit(1), F.size(seq) - (n - 1))
    hashes = F.transform(starts, lambda at: F.xxhash64(F.slice(F.col(seq), at, n)))
    return F.when(F.size(seq) >= n, hashes).otherwise(F.array().cast("array<bigint>"))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows: ``window`` (words), ``n`` (their number), ``items`` (ids that have it)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda at: F.slice("w", at, size))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("window"))


def _matches(docs: DataFrame, text: str, tokens: DataFrame, sizes: list[int], wide: bool) -> DataFrame:
    """Places of the given shingles in the documents: key, w (words), at (from 1), and the token's columns."""
    seen = docs.select(text_key(F.col(text)).alias("key"), words(F.col(text)).alias("w"))
    found = None
    for n in sizes:
        places = seen.select("key", "w", F.posexplode(_shingles("w", n)).alias("at0", "token"))
        of_size = tokens.where(F.col("k") == n).drop("k")
        joined = places.join(of_size if wide else F.broadcast(of_size), "token")
        found = joined if found is None else found.unionByName(joined)
    return found


def prefix_index(found: DataFrame, places: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Windows under their rarest shingle: token, k (its words), offset, window, n, items.

    Rarity is the number of places in all texts; ties go by hash. A window with a
    shingle that no text has is left out.
    """
    counts = places.groupBy("token").agg(F.sum("times").alias("places"))
    rarest = F.min_by(F.struct("token", "k", "offset", "items"), F.struct("places", "token", "offset")).alias("r")
    ranked = found.join(counts, "token", "left").fillna(0, "places")
    best = ranked.groupBy("window", "n").agg(rarest, F.min("places").alias("least")).where(F.col("least") > 0)
    return best.select("r.token", "r.k", "r.offset", "window", "n", "r.items")


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                size: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame | None:
    """Verified windows in documents: key (digest of the text), start (from 0), n, items."""
    found = stored(windows(benchmark, item_id, item_text, size), "windows")
    n_windows = found.count()
    if not n_windows:
        return None
    wide = n_windows > BROADCAST_WINDOWS
    k = F.least(F.lit(shingle), F.col("n"))
    sizes = sorted(r[0] for r in found.select(k.alias("k")).distinct().collect())  # 1 to `shingle`
    parts = None
    for n in sizes:
        part = found.where(k == n).select("window", "n", "items", F.lit(n).alias("k"), F.posexplode(_shingles("window", n)).alias("offset", "token"))
        parts = part if parts is None else parts.unionByName(part)
    parts = stored(parts, "window-shingles")

    # all benchmark shingles in all texts, counted per text
    tokens = parts.select("token", "k").distinct()
    places = _matches(docs, text, tokens, sizes, wide).groupBy("key", "token").agg(F.count(F.lit(1)).alias("times"))
    places = stored(places, "shingle-places")
    index = stored(prefix_index(parts, places, shingle), "prefixes")

    # only texts with the prefix of some window are cut into words again
    of_index = index.select("token").distinct()
    keys = places.join(of_index if wide else F.broadcast(of_index), "token").select(F.col("key").alias("_key")).distinct()
    few = docs.join(bounded(stored(keys, "candidate-texts")), text_key(F.col(text)) == F.col("_key"), "left_semi")
    start = F.col("at0") - F.col("offset")
    candidates = _matches(few, text, index, sizes, wide)
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    same = F.when(fits, F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window"))
    return candidates.where(same).select("key", start.alias("start"), "n", "items")


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS, share: int = 20,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the item list.

    A document is contaminated when at least one word in ``share`` is hit.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("_key"),
        F.size(words(F.col(text))).cast("long").alias("n_words"),
    )
    none = F.array().cast("array<string>")
    places = occurrences(docs, benchmark, text, item_id, item_text, size)
    if places is None:
        report = rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    else:
        places = stored(places.groupBy("key", "start").agg(F.max("n").alias("n"), F.flatten(F.collect_set("items")).alias("items")), "places")
        # words under a hit, once each: an interval adds what lies beyond all earlier ones
        earlier = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("n")
        fresh = end - F.greatest("start", F.least(F.coalesce(F.max(end).over(earlier), F.lit(0)), end))
        hits = places.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
        listed = (
            places.select("key", F.explode("items").alias("item")).distinct()
            .groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
        )
        per_text = stored(hits.join(listed, "key", "left"), "hits").withColumnRenamed("key", "_key")
        report = rows.join(per_text, "_key", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items")
        )
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    size: int = WINDOW_WORDS, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    key = "_contamination_key"
    keyed = docs.withColumn(key, text_key(F.col(text)))
    report = contamination(keyed, benchmark, key, text, item_id, item_text, size, share)
    dirty = report.where("contaminated").select(F.col("doc_id").alias("_dirty")).distinct()
    return keyed.join(dirty, F.col(key) == F.col("_dirty"), "left_anti").drop(key)
