"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, ASCII letters (lowered) and non-ASCII characters.  A
window is ``window`` consecutive words of an item, or the whole item if shorter.

* Fingerprints: of every ``w`` consecutive ``k``-gram hashes the smallest is
  kept, on both sides.  With ``k + w - 1 = window`` any shared span of at least
  ``window`` words shares a fingerprint, so no occurrence is missed.
* Fingerprints are joined as plain 64-bit values.  The benchmark's are a written
  table, so Spark broadcasts them only where their measured size allows.
* Hits are extended in the documents that share a fingerprint: their windows,
  as text, are joined with the item windows, which makes the result exact, and
  the union of the occurrences is taken by a running maximum per document.
* Items shorter than ``window`` are searched with ``w = 1`` (every gram of the
  shortest such length is a fingerprint), only where such items exist.

Edge cases: null and empty texts have no words, no hits.  Items without words
have no windows.  Rows with equal id and text get equal results; rows that share
an id but not the text are separate.  Equal items all count.  An empty
documents table gives an empty result, an empty benchmark no hits.  Other columns are
not read (report) or pass through (filter), whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .rows import table, written

WINDOW = 10
K = 8
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NO_WORD), "")


def _doubling(size: int) -> list[int]:
    """Shifts that join spans of 1 into a span of ``size``: each adds at most what is already covered."""
    out, have = [], 1
    while have < size:
        out.append(min(have, size - have))
        have += out[-1]
    return out


def _paired(values: Column, shift: int, f) -> Column:
    """Element ``i`` with element ``i + shift``, as long as both exist; ``values`` is computed once."""

    def pair(v: Column) -> Column:
        n = F.greatest(F.size(v) - shift, F.lit(0))
        return F.zip_with(F.slice(v, 1, n), F.slice(v, shift + 1, n), f)

    return F.get(F.transform(F.array(values), pair), 0)


def fingerprints(df: DataFrame, k: int, w: int, *keep: str) -> DataFrame:
    """``(keep…, fp)``: the distinct minimal ``k``-gram hashes of ``words`` over windows of ``w`` grams."""
    g = F.transform("words", lambda x: F.xxhash64(x))
    for shift in _doubling(k):
        g = _paired(g, shift, lambda a, b: F.xxhash64(a, b))
    for shift in _doubling(w):
        g = _paired(g, shift, lambda a, b: F.least(a, b))
    # the outer form keeps the optimiser from adding a filter that computes the array a second time
    return (
        df.where(F.size("words") >= k + w - 1).select(*keep, F.explode_outer(F.array_distinct(g)).alias("fp")).where("fp is not null")
    )


def grams(df: DataFrame, length: int, *keep: str) -> DataFrame:
    """``(keep…, pos, gram)``: every run of ``length`` words, joined by blanks."""
    runs = F.expr(f"transform(sequence(1, size(words) - {length - 1}), i -> array_join(slice(words, i, {length}), ' '))")
    return df.where(F.size("words") >= length).select(*keep, F.posexplode_outer(runs).alias("pos", "gram"))


def report(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id",
    item_text: str = "text", item_col: str = "item_id", window: int = WINDOW, k: int = K,
) -> DataFrame:
    """One row per document: ``doc_key``, word and hit counts, items whose windows occur, ``contaminated``."""
    k = min(k, window)
    items = written(benchmark.select(benchmark[item_col].alias("item_id"), words(benchmark[item_text]).alias("words")), "items")
    size = F.least(F.size("words"), F.lit(window)).alias("l")
    lengths = sorted(r["l"] for r in items.where(F.size("words") > 0).select(size).distinct().collect())  # at most ``window`` values
    short = [n for n in lengths if n < window]
    schemes = [(k, window - k + 1, items.where(F.size("words") >= window))] if window in lengths else []
    if short:
        own = items.where((F.size("words") > 0) & (F.size("words") < window))
        schemes.append((short[0], 1, own.withColumn("words", F.slice("words", 1, short[0]))))

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("_text")).withColumn("doc_key", F.xxhash64("_text"))
    counted = rows.select("doc_id", "doc_key", F.size(words(F.col("_text"))).cast("long").alias("n_words"))
    split = rows.withColumn("words", words(F.col("_text"))).drop("_text")
    empty = rows.select("doc_key").limit(0)
    found = empty
    for n, w, side in schemes:
        marks = written(fingerprints(side, n, w).distinct(), "marks")
        met = fingerprints(split, n, w, "doc_key").join(marks, "fp", "left_semi")
        found = found.unionByName(met.select("doc_key"))
    found = written(found.distinct(), "suspects")

    # one row per suspect text, however many documents carry it
    suspects = split.join(found, "doc_key", "left_semi").select("doc_key", "words")
    item_grams = None
    hits = None
    for n in lengths:
        side = items if n == window else items.where(F.size("words") == n)
        g = grams(side, n, "item_id").select("item_id", "gram").distinct()
        item_grams = g if item_grams is None else item_grams.unionByName(g)
    if item_grams is None:
        none = counted.withColumns({"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items": F.lit("")})
        return none.withColumns({"items_sha256": F.sha2("items", 256), "contaminated": F.lit(False)}).drop("items")
    item_grams = written(item_grams, "item-grams")
    wanted = item_grams.select("gram").distinct()
    for n in lengths:
        h = grams(suspects, n, "doc_key").join(wanted, "gram", "left_semi").select("doc_key", "gram", "pos", (F.col("pos") + n).alias("stop"))
        hits = h if hits is None else hits.unionByName(h)
    hits = written(hits.distinct(), "hits")

    order = Window.partitionBy("doc_key").orderBy("pos", "stop").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("stop").over(order), F.lit(0))
    n_hit = (
        hits.select("doc_key", "pos", "stop").distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("pos", done)))
        .groupBy("doc_key").agg(F.sum("new").alias("n_hit"))
    )
    pairs = hits.select("doc_key", "gram").distinct().join(item_grams, "gram").select("doc_key", "item_id").distinct()
    listed = pairs.groupBy("doc_key").agg(
        F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items")
    )
    found = written(n_hit.join(listed, "doc_key"), "hit-texts")
    return counted.join(found, "doc_key", "left").select(
        "doc_id", "doc_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs."""
    bad = written(report(docs, benchmark, text, id_col, **options).where("contaminated").select("doc_key").distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(docs[text]).alias("_key"))
    return rows.join(bad, rows["_key"] == bad["doc_key"], "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")
