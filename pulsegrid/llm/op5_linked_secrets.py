"""Secret scans with multipart credential linking, in DataFrame functions only.

*Base.*  Three kinds are found by fixed patterns.  A text is split at the matches
and the matches are extracted; running sums of both lengths, one row per match,
give the positions.  Only texts that a cheap test lets through get that far.

*Linking.*  Weak candidates (access identifiers of other forms, long random
tokens, endpoints) say nothing alone.  An interval join within each text finds
candidates and base spans of complementary parts whose gap is at most ``SCOPE``
characters: positions are cut into buckets of that size, each part meets those in
its own and the neighbouring buckets, so a text with very many parts is split.

* a weak identifier is reported beside a secret part (weak, ``assign`` or ``hex``);
* a weak secret is reported beside an identifier (weak or ``access``) or an endpoint;
* an endpoint is reported beside both an identifier and a secret.

Work is per distinct text (64-bit hash), so copies cost one row after the first shuffle.

Edge cases: null and empty texts have no spans.  Repeated rows get equal results.
Empty tables give empty results.  Texts of any length are scanned whole.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .rows import table, written

SCOPE = 256
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
#: Base patterns in the order of their kinds, group that decides, fewest characters of it.
BASE = {
    "assign": (rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: The method's weak parts.
WEAK = {
    "weak_id": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA|LTAI|GOOG)[A-Z0-9]{8,}", 0, 12),
    "weak_secret": (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]{0,64}[0-9])(?=[A-Za-z0-9+/_-]{0,64}[A-Za-z])[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    "endpoint": (r"(?i:https?://[a-z0-9.-]+(?::[0-9]+)?|(?:endpoint|host|server|bucket|region)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9._:/-]+)", 0, 4),
}
#: Cheap tests, one per kind: a text without a hit has no span of it.
TESTS = {
    "assign": rf"""{_KEYWORD}["']?\x20*[:=]""", "access": "AKIA", "hex": "[0-9a-f]{24}",
    "weak_id": "(?:AKIA|ASIA|AIDA|AROA|LTAI|GOOG)[A-Z0-9]{8}", "weak_secret": "[A-Za-z0-9+/_-]{32}",
    "endpoint": r"(?i:https?://|(?:endpoint|host|server|bucket|region)[\"']?\x20*[:=])",
}
KINDS = (*BASE, *WEAK)


def spans_of(texts: DataFrame, kind: str) -> DataFrame:
    """``(doc_key, kind, start, stop)`` of the matches that are long enough."""
    pattern, group, least = (BASE | WEAK)[kind]
    p = F.lit(pattern)
    hit = texts.where(F.col("text").contains("AKIA") if kind == "access" else F.col("text").rlike(TESTS[kind]))
    lengths = F.arrays_zip(
        F.transform(F.split("text", pattern, -1), lambda s: F.length(s)).alias("gap"),
        F.transform(F.regexp_extract_all("text", p, F.lit(0)), lambda s: F.length(s)).alias("size"),
        F.transform(F.regexp_extract_all("text", p, F.lit(group)), lambda s: F.length(s)).alias("tested"),
    )
    each = (
        hit.select("doc_key", F.posexplode_outer(lengths).alias("i", "m"))
        .groupBy("doc_key", "i").agg(*[F.first(f"m.{c}").alias(c) for c in ("gap", "size", "tested")])
    )
    order = Window.partitionBy("doc_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap").cast("long") + F.coalesce("size", F.lit(0))).over(order)
    return (
        each.withColumn("stop", stop).where(F.col("tested") >= least)
        .select("doc_key", F.lit(kind).alias("kind"), (F.col("stop") - F.col("size")).alias("start"), "stop")
    )


def _beside(one: DataFrame, other: DataFrame, scope: int) -> DataFrame:
    """The rows of ``one`` that have a row of ``other`` in the same text within ``scope``, apart from themselves."""
    near = one.withColumn("bucket", F.explode(F.expr(f"sequence(start div {scope} - 2, stop div {scope} + 1)")))
    part = other.select(
        F.col("doc_key").alias("k"), F.col("start").alias("s"), F.col("stop").alias("e"), F.expr(f"start div {scope}").alias("b")
    )
    # a part longer than a bucket is met at each bucket that it covers
    part = part.withColumn("b", F.explode(F.expr(f"sequence(b, (e - 1) div {scope})")))
    gap = F.greatest(F.col("s") - F.col("stop"), F.col("start") - F.col("e"))
    match = (F.col("doc_key") == F.col("k")) & (F.col("bucket") == F.col("b")) & (gap >= 0) & (gap <= scope)
    return near.join(part, match, "left_semi").select("doc_key", "kind", "start", "stop").distinct()


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts of ``(doc_key, kind, start, stop)`` that complementary parts support."""
    base = parts.where(F.col("kind").isin(*BASE))
    inside = base.select(F.col("doc_key").alias("k"), F.col("start").alias("s"), F.col("stop").alias("e"))
    weak = parts.where(F.col("kind").isin(*WEAK)).join(
        inside, (F.col("doc_key") == F.col("k")) & (F.col("s") < F.col("stop")) & (F.col("start") < F.col("e")), "left_anti"
    )
    weak = written(weak, "weak")
    ids = weak.where("kind = 'weak_id'").unionByName(base.where("kind = 'access'"))
    secrets = weak.where("kind = 'weak_secret'").unionByName(base.where("kind in ('assign', 'hex')"))
    ends = weak.where("kind = 'endpoint'")
    return (
        _beside(weak.where("kind = 'weak_id'"), secrets, scope)
        .unionByName(_beside(weak.where("kind = 'weak_secret'"), ids.unionByName(ends), scope))
        .unionByName(_beside(_beside(ends, ids, scope), secrets, scope))
    )


def secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row per document: base counts and digest, all ``spans`` as text, number of linked parts."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("doc_key"), docs[text].alias("text"))
    test = F.col("text").contains("AKIA")
    for kind in KINDS:
        if kind != "access":
            test = test | F.col("text").rlike(TESTS[kind])
    suspects = written(rows.where(test).select("doc_key", "text"), "suspects")
    parts = None
    for kind in KINDS:
        found = spans_of(suspects, kind)
        parts = found if parts is None else parts.unionByName(found)
    parts = written(parts, "parts")
    base = parts.where(F.col("kind").isin(*BASE))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    told = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "stop").alias("told"), "kind")

    def listed(name: str):
        return F.array_join(F.transform(F.array_sort(name), lambda s: s["told"]), ",")

    held = (
        base.withColumn("linked", F.lit(False)).unionByName(link(parts, scope).withColumn("linked", F.lit(True)))
        .groupBy("doc_key").agg(
            F.collect_list(F.when(~F.col("linked"), told)).alias("base"), F.collect_list(told).alias("all"), F.count_if("linked").alias("n_linked"),
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        )
        .select("doc_key", "n_linked", *[f"n_{k}" for k in BASE], F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
    )
    held = written(held, "secret-texts")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", "doc_key").join(held, "doc_key", "left").select(
        "doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
