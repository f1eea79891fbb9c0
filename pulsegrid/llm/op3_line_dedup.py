"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Two lines link when they are equal, or when both have at least ``min_chars``
characters and their edit distance is at most ``TAU`` = 1.

* A line is cut into ``TAU + 1`` = 2 segments.  One edit leaves one of them
  intact; the damaged one is cut the same way again, ``depth`` times in all.  A
  similar line therefore agrees with everything left and right of one of
  ``2 ** depth`` windows.
* The index holds, per line and window, a hash of (length, window, what lies
  before it, what lies behind it).  A line probes with its own length, where the
  windows are its own, and with one character less, where the substring behind
  the window begins one place later.  No line text is shuffled for the search.
* Keys met by two different lines are found by a minimum and maximum per key,
  combined on the map side, so a line that fills a third of all documents costs
  one row per task.  Only lines under such keys become candidate pairs.
* Pairs are verified by a banded bit-parallel edit distance: a band of
  ``2 TAU + 1`` diagonals in one machine word, one step per character.

Nodes are distinct lines (64-bit hash).

Edge cases: null and empty texts have no lines; lines without a word are neither
matched nor removed.  Rows that repeat a document count in ``n_copies``; removal
keeps the same lines in each of them.  A null id sorts last, so it is first of
its class only among other nulls.  Lines of any length are taken whole.  Empty tables
give empty results; other columns are not read (classes) or pass through
(removal), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .graph import components
from .rows import table, written

TAU = 1
DEPTH = 2
MIN_CHARS = 20
HAS_WORD = r"[^ \t\n\x0B\f\r]"


def lines_of(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, doc_key, line_no, line, node, len)`` for the ``\\n``-split lines that hold a word."""
    return (
        docs.select(
            docs[id_col].alias("doc_id"), F.xxhash64(docs[text]).alias("doc_key"),
            # the outer form keeps the optimiser from adding a filter that splits a second time
            F.posexplode_outer(F.split(docs[text], "\n", -1)).alias("line_no", "line"),
        )
        .where(F.col("line").rlike(HAS_WORD))
        .withColumns({"node": F.xxhash64("line"), "len": F.length("line")})
    )


def window_keys(depth: int = DEPTH) -> Column:
    """Index keys of a line (``line``, ``len``) and its probes among lines one character shorter."""
    windows = 1 << depth
    keys = [
        f"xxhash64(len - {less}, {j}, left(line, (len - {less}) * {j} div {windows}), "
        f"substring(line, (len - {less}) * {j + 1} div {windows} + {less} + 1))"
        for less in range(TAU + 1) for j in range(windows)
    ]
    return F.expr(f"array({', '.join(keys)})")


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings, ``a`` at least as long as ``b``, if at most ``tau``; else a larger number.

    Bit ``d`` of a word stands for row ``j - tau + d`` of column ``j``, so the
    band moves down the diagonal by itself; the vertical differences of a column
    live in two words and advance by one addition and a few shifts per character
    of ``b`` (Hyyrö, 2003).  The distance is followed along the lowest row of the
    band, then along the last row.  Needs ``tau < len(a)`` and ``tau <= 30``.
    """
    band = 2 * tau + 1
    full = (1 << band) - 1

    def long(v: int) -> Column:
        return F.lit(v).cast("long")

    def bind(value: Column, then) -> Column:
        """Names an intermediate value, so that it is computed once."""
        return F.get(F.transform(F.array(value), then), 0)

    def along(c: Column) -> Column:
        x, y, m = c["x"], c["y"], F.size(c["x"])

        def step(s: Column, j: Column) -> Column:
            here = F.get(y, j - 1)
            eq = long(0)
            for d in range(band):
                eq = eq + F.when(F.coalesce(F.get(x, j + (d - tau - 1)) == here, F.lit(False)), long(1 << d)).otherwise(long(0))
            # along the band the value never falls, along the last row at most tau times
            return F.when(s["dist"] > 2 * tau, s).otherwise(bind(F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"), eq.alias("eq")), lambda t: bind(with_h(t), lambda t: done(t, j))))

        def with_h(t: Column) -> Column:
            d0 = t["eq"].bitwiseAND(t["vp"]) + t["vp"]
            d0 = d0.bitwiseXOR(t["vp"]).bitwiseOR(t["eq"]).bitwiseOR(t["vn"]).bitwiseAND(long(full))
            hp = t["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(t["vp"]))).bitwiseAND(long(full))
            return F.struct(hp.alias("hp"), d0.bitwiseAND(t["vp"]).alias("hn"), d0.alias("d0"), t["dist"].alias("dist"))

        def done(t: Column, j: Column) -> Column:
            # past the last row of the band, the last row of the longer string sits one bit lower each step
            bit = F.call_function("shiftleft", long(1), F.greatest(F.lit(band - 1) - (j - (m - tau)), F.lit(0)).cast("int"))
            on_diagonal = F.when(t["d0"].bitwiseAND(long(1 << (band - 1))) == 0, 1).otherwise(0)
            flat = F.when(t["hp"].bitwiseAND(bit) != 0, 1).when(t["hn"].bitwiseAND(bit) != 0, -1).otherwise(0)
            d = F.shiftright(t["d0"], 1)
            vp = t["hn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(t["hp"]))).bitwiseAND(long(full))
            return F.struct(
                vp.alias("vp"), d.bitwiseAND(t["hp"]).alias("vn"),
                (t["dist"] + F.when(j <= m - tau, on_diagonal).otherwise(flat)).cast("int").alias("dist"),
            )

        start = F.struct(long((full << tau) & full).alias("vp"), long(0).alias("vn"), F.lit(tau).alias("dist"))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), start, step, lambda s: s["dist"])

    # the characters are split once per pair, not once per step
    return bind(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")), along)


def similar_lines(lines: DataFrame, min_chars: int = MIN_CHARS, depth: int = DEPTH) -> DataFrame:
    """``(x, y)``: nodes of different lines within ``TAU`` edits."""
    keyed = lines.where(F.col("len") >= min_chars).select("node", "line", F.explode(window_keys(depth)).alias("key"))
    met = written(
        keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "met"
    )
    held = written(keyed.join(met, "key", "left_semi").groupBy("key", "node").agg(F.first("line").alias("line")), "held")
    keys = held.select("key", "node")
    pairs = (
        keys.withColumnRenamed("node", "x").join(keys.withColumnRenamed("node", "y"), "key").where("x < y").select("x", "y").distinct()
    )
    texts = held.groupBy("node").agg(F.first("line").alias("line"))
    both = pairs.join(texts.select(F.col("node").alias("x"), F.col("line").alias("xl")), "x").join(
        texts.select(F.col("node").alias("y"), F.col("line").alias("yl")), "y"
    )
    longer = F.length("xl") >= F.length("yl")
    a, b = F.when(longer, F.col("xl")).otherwise(F.col("yl")), F.when(longer, F.col("yl")).otherwise(F.col("xl"))
    return (
        both.select("x", "y", a.alias("a"), b.alias("b")).where(F.length("a") - F.length("b") <= TAU)
        .where(banded_distance(F.col("a"), F.col("b"), TAU) <= TAU).select("x", "y")
    )


FIRST = ("is_null", "doc_id", "line_no")


def line_classes(lines: DataFrame, min_chars: int = MIN_CHARS, depth: int = DEPTH) -> DataFrame:
    """One row per distinct line: ``node``, its first place, ``n_copies`` and the first place of its class.

    Places are structs ``(is_null, doc_id, line_no)``, which order by document and line.
    """
    place = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "line_no")
    nodes = lines.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_copies"), F.max("len").alias("len"))
    labels = components(similar_lines(lines, min_chars, depth))
    labelled = written(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "line-nodes")
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"))
    return labelled.join(heads, "label").select("node", "first", "n_copies", "len", "head")


def remove_repeated_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, depth: int = DEPTH, short_lines: bool = False
) -> DataFrame:
    """The documents without the lines of at least ``min_chars`` characters whose class occurs earlier.

    The first place of a class, by id and line, stays.  A document that loses all
    such lines is a repeat itself and goes; one that had none stays as it is.
    With ``short_lines`` shorter lines count too: a document goes only if each of
    its lines with a word occurred earlier, and else loses its repeated lines.
    """
    lines = lines_of(docs, text, id_col)
    found = line_classes(lines, min_chars, depth)
    if not short_lines:
        lines, found = lines.where(F.col("len") >= min_chars), found.where(F.col("len") >= min_chars)
    place = F.struct(F.col("doc_id").isNull().alias("is_null"), "doc_id", "line_no")
    drops = (
        lines.withColumn("place", place).select("node", "len", "doc_id", "doc_key", "line_no", "place")
        .join(found.select("node", "head"), "node")
        .groupBy("doc_id", "doc_key")
        .agg(
            F.collect_set(F.when((F.col("place") != F.col("head")) & (F.col("len") >= min_chars), F.col("line_no"))).alias("_drop"),
            F.count_if(F.col("place") == F.col("head")).alias("_stay"),
        )
        .where(F.size("_drop") > 0)
        .select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), "_drop", "_stay")
    )
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs[id_col].alias("_rid"), F.xxhash64(docs[text]).alias("_rkey"), docs[text].alias("_text"))
    joined = rows.join(drops, rows["_rid"].eqNullSafe(drops["_id"]) & (rows["_rkey"] == drops["_key"]), "left")
    parts = F.split("_text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    cut = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    kept = joined.where(F.col("_drop").isNull() | (F.col("_stay") > 0)).withColumn("_cut", cut)
    return kept.select(*[F.col("_cut").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct line: where it first occurs, its copies, and the first place of its class."""
    found = line_classes(lines_of(table(spark, sf_dir, "documents")))
    return found.select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").cast("long").alias("line_no"), "n_copies",
        F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").cast("long").alias("class_line_no"),
    )
