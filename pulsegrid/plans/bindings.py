"""The supplied tables in the shapes the operators expect.

Each binding exists twice: as a DataFrame and as a named SQL fragment with the
same rows.  Scores are dyadic (``k / 2048``) so sums are exact in any order and
ties mean the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import hash_draw, run_label

GROUPS = ("100", "240", "250", "500")
#: Shift of the positive class per group, in 1/2048.
STRENGTH = {"100": 380, "240": 390, "250": 392, "500": 440}
SEEDS = 5
RUN_RATES = (100, 240, 250, 500)
CROPS = 4
FILES_SKIP, FILES_ALTER = 17, 13


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a table comes in fewer splits than there are cores.

    A large table has more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- predictions ------------------------------------------------------------------

L_KEY = ["l_orderkey", "l_linenumber"]
L_SCORES = ["l_discount", "l_tax", "l_quantity", "l_extendedprice"]
L_LABELS = ["flag_R", "flag_A", "status_O"]


def wide_l(spark, sf) -> DataFrame:
    """``lineitem`` as a column per label and one per run that scores it."""
    is_ = lambda c, v, name: (F.col(c) == v).cast("int").alias(name)
    return spread(table(spark, sf, "lineitem").select(
        *L_KEY, *L_SCORES, is_("l_returnflag", "R", "flag_R"), is_("l_returnflag", "A", "flag_A"), is_("l_linestatus", "O", "status_O")
    ))


def pred_l(spark, sf) -> DataFrame:
    """``lineitem`` as three labels scored by four runs; heavy ties, grows with the data."""
    return wide_l(spark, sf).unpivot([*L_KEY, *L_LABELS], L_SCORES, "run_id", "score").unpivot(
        [*L_KEY, "run_id", "score"], L_LABELS, "label", "y"
    )


PRED_L = """
pred_l AS (
  SELECT l_orderkey, l_linenumber, run_id, score,
         unnest(['flag_R','flag_A','status_O']) AS label,
         unnest([(l_returnflag='R')::INT, (l_returnflag='A')::INT, (l_linestatus='O')::INT]) AS y
  FROM (SELECT *, unnest(['l_discount','l_tax','l_quantity','l_extendedprice']) AS run_id,
               unnest([l_discount,l_tax,l_quantity,l_extendedprice]) AS score FROM lineitem))"""


def _small_rows(spark, sf) -> DataFrame:
    t = table(spark, sf, "labels")
    groups = F.array(*[
        F.struct(F.lit(g).alias("grp"), F.lit(STRENGTH[g]).alias("strength")) for g in GROUPS
    ])
    labels = F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").cast("int").alias("y")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").cast("int").alias("y")),
        F.struct(F.lit("never").alias("label"), F.lit(0).alias("y")),
    )
    return (
        spread(t).select(F.col("doc_id").alias("record_id"), labels.alias("ls"), groups.alias("gs"))
        .select("record_id", "ls", F.inline("gs"))
        .select("record_id", "grp", "strength", F.inline("ls"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
        .withColumn("run_id", F.format_string("b1-fs%s-A-n1-s%d", "grp", "seed"))
    )


def pred_s(spark, sf) -> DataFrame:
    """``labels`` scored by 4 groups × 5 seeds; one label is never positive."""
    noise = hash_draw(1024, "record_id", "label", "grp", "seed")
    score = (F.col("strength") * F.col("y") + noise) / F.lit(2048.0)
    return _small_rows(spark, sf).select(
        "run_id", "grp", "seed", "record_id", "label", "y", score.alias("score")
    )


_SMALL_ROWS = f"""
small_rows AS (
  SELECT *, 'b1-fs' || grp || '-A-n1-s' || seed AS run_id FROM (
    SELECT doc_id AS record_id, grp, strength, label, y, unnest(range({SEEDS}))::INT AS seed FROM (
      SELECT doc_id, grp, strength, unnest(['quality','toxic','never']) AS label,
             unnest([quality::INT, toxic::INT, 0]) AS y FROM (
        SELECT *, unnest([{','.join(f"'{g}'" for g in GROUPS)}]) AS grp,
                  unnest([{','.join(str(STRENGTH[g]) for g in GROUPS)}]) AS strength FROM labels))))"""

PRED_S = _SMALL_ROWS + """,
pred_s AS (
  SELECT run_id, grp, seed, record_id, label, y,
         (strength * y + ('0x' || substr(md5(record_id || ':' || label || ':' || grp || ':' || seed), 1, 15))::BIGINT % 1024)
           / 2048.0::DOUBLE AS score
  FROM small_rows)"""


#: The runs of a whole design: block, rate, arm, notch, source, seeds, shift of the positive class.
DESIGN = (
    (0, 100, "A", 0, "hr", 3, 384),
    *((1, fs, "A", 1, "hr", 5, STRENGTH[str(fs)]) for fs in RUN_RATES),
    *((2, fs, "B", 1, "hr", 5, STRENGTH[str(fs)] + 24) for fs in (240, 250, 500)),
    (3, 100, "A", 0, "hr", 5, 382),
    (4, 100, "A", 0, "lr", 5, 381),
)


def design_runs(spark, sf) -> DataFrame:
    """The run matrix of the design; every run is declared, whatever the predictions hold."""
    rows = spark.createDataFrame(list(DESIGN), "block int, fs int, arm string, notch int, source string, seeds int, strength int")
    seeded = rows.withColumn("seed", F.explode(F.sequence(F.lit(0), F.col("seeds") - 1))).withColumn("notch", F.col("notch") == 1)
    return seeded.withColumn("run_id", run_label("block", "fs", "arm", "notch", "seed"))


def pred_d(spark, sf) -> DataFrame:
    """``labels`` scored by every run of the design; one label is never positive."""
    labels = F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").cast("int").alias("y")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").cast("int").alias("y")),
        F.struct(F.lit("never").alias("label"), F.lit(0).alias("y")),
    )
    cells = spread(table(spark, sf, "labels")).select(F.col("doc_id").alias("record_id"), F.inline(labels))
    noise = hash_draw(1024, "record_id", "label", "run_id")
    return cells.crossJoin(F.broadcast(design_runs(spark, sf).select("run_id", "strength"))).select(  # one row per run of the design
        "run_id", "record_id", "label", "y", ((F.col("strength") * F.col("y") + noise) / F.lit(2048.0)).alias("score")
    )


DESIGN_RUNS = f"""
design AS (
  SELECT block, fs, arm, notch = 1 AS notch, source, strength, seed,
         'b' || block || '-fs' || fs || '-' || arm || '-n' || notch || '-s' || seed AS run_id
  FROM (SELECT *, unnest(range(seeds)) AS seed FROM (VALUES {', '.join(map(str, DESIGN))}) t(block, fs, arm, notch, source, seeds, strength)))"""

PRED_D = """
pred_d AS (
  SELECT run_id, block, record_id, label, y, (strength * y + ('0x' || substr(md5(record_id || ':' || label || ':' || run_id), 1, 15))::BIGINT % 1024)
           / 2048.0::DOUBLE AS score
  FROM (SELECT doc_id AS record_id, unnest(['quality','toxic','never']) AS label, unnest([quality::INT, toxic::INT, 0]) AS y FROM labels), design)"""


def crop_s(spark, sf) -> DataFrame:
    """Four crop-level logits per prediction on a grid of 1/256."""
    noise = hash_draw(1024, "record_id", "label", "grp", "seed", "crop")
    logit = (F.col("strength") * F.col("y") + noise - 900) / F.lit(256.0)
    return (
        _small_rows(spark, sf)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(CROPS - 1))).alias("crop"))
        .select("run_id", "grp", "seed", "record_id", "label", "y", "crop", logit.alias("logit"))
    )


CROP_S = _SMALL_ROWS + f""",
crop_s AS (
  SELECT run_id, grp, seed, record_id, label, y, crop,
         (strength * y + ('0x' || substr(md5(record_id || ':' || label || ':' || grp || ':' || seed || ':' || crop), 1, 15))::BIGINT % 1024
           - 900) / 256.0::DOUBLE AS logit
  FROM (SELECT *, unnest(range({CROPS}))::INT AS crop FROM small_rows))"""


def frozen_s(spark, sf, min_positives: int = 10) -> DataFrame:
    """Labels with enough positives among the records of the last fold."""
    t = table(spark, sf, "labels").where(F.col("doc_id") % 10 == 9)
    sums = t.agg(F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n_test")) for c in ("quality", "toxic")])
    return sums.select(F.inline(pairs)).where(F.col("n_test") >= min_positives)


FROZEN_S = """
frozen_s AS (
  SELECT label, n_test FROM (
    SELECT unnest(['quality','toxic']) AS label, unnest([sum(quality), sum(toxic)])::BIGINT AS n_test
    FROM labels WHERE doc_id % 10 = 9) WHERE n_test >= 10)"""


# --- records ------------------------------------------------------------------------

def day_records(spark, sf) -> DataFrame:
    """One record per user and day; its code map keeps the smallest ``k`` per event type."""
    e = table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("double")
    per_code = e.select(
        (F.col("user_id") * 1000 + day).alias("record_id"), "user_id",
        F.col("event_type").alias("code"), k.alias("likelihood"),
    ).groupBy("record_id", "user_id", "code").agg(F.min("likelihood").alias("likelihood"))
    item = F.concat(F.lit("'"), F.col("code"), F.lit("': "), F.col("likelihood").cast("string"))
    return per_code.groupBy("record_id", "user_id").agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(item)), ", "), F.lit("}")).alias("scp_codes")
    ).select(
        "record_id",
        F.col("user_id").alias("patient_id"),
        (F.col("user_id") % 10 + 1).cast("int").alias("fold"),
        "scp_codes",
    )


CODES = """
codes AS (
  SELECT user_id * 1000 + datediff('day', DATE '2024-01-01', ts::DATE) AS record_id,
         user_id AS patient_id, (user_id % 10 + 1)::INT AS fold, event_type AS code,
         min(regexp_extract(props, '"k": ([0-9]+)', 1)::DOUBLE) AS likelihood
  FROM events GROUP BY ALL),
day_records AS (SELECT DISTINCT record_id, patient_id, fold FROM codes)"""


def statements(spark, sf) -> DataFrame:
    """Label dictionary: the event types but one, plus a name no record carries."""
    e = table(spark, sf, "events")
    seen = e.where(F.col("event_type") != "signup").select(F.col("event_type").alias("label")).distinct()
    return seen.union(e.sparkSession.createDataFrame([("refund",)], "label string")).withColumn(
        "description", F.when(F.col("label") != "view", F.concat(F.lit("event: "), "label"))
    )


STATEMENTS = """
statements AS (
  SELECT label, CASE WHEN label <> 'view' THEN 'event: ' || label END AS description
  FROM (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> 'signup' UNION ALL SELECT 'refund'))"""


def order_records(spark, sf, leaking: bool = False) -> DataFrame:
    """Orders as records, customers as entities; fold by entity, or leaking by record."""
    o = table(spark, sf, "orders")
    key = "o_orderkey" if leaking else "o_custkey"
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        F.col("o_custkey").alias("patient_id"),
        (F.col(key) % 10 + 1).cast("int").alias("fold"),
        (F.col("o_orderstatus") == "F").cast("int").alias("sex"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("age"),
    )


ORDER_RECORDS = """
order_records AS (
  SELECT o_orderkey AS record_id, o_custkey AS patient_id, (o_custkey % 10 + 1)::INT AS fold,
         (o_orderkey % 10 + 1)::INT AS leaking_fold, (o_orderstatus = 'F')::INT AS sex,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS age FROM orders)"""

SPLIT_SQL = "CASE WHEN fold BETWEEN 1 AND 8 THEN 'train' WHEN fold = 9 THEN 'val' WHEN fold = 10 THEN 'test' END"


# --- signals ------------------------------------------------------------------------

def sig(spark, sf, fs: int = 40) -> DataFrame:
    """``embeddings`` as 64-sample signals: four leads per record, nominal rate ``fs``."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("record_id"),
        (F.col("vec_id") % 4).cast("int").alias("lead"),
        F.lit(fs).alias("fs"),
        F.lit(False).alias("notch"),
        F.lit("hr").alias("source"),
        (F.col("label") + 1).cast("int").alias("fold"),
        F.col("embedding").alias("samples"),
    )


SIG = """
sig AS (
  SELECT vec_id // 4 AS record_id, (vec_id % 4)::INT AS lead, (label + 1)::INT AS fold, embedding AS samples
  FROM embeddings)"""


def sig_t(spark, sf) -> DataFrame:
    """``events`` as hourly signals: record = user, lead = event type, gaps 0.

    The span is that of the table, whole days.  Each day becomes a 24-slot array on
    the map side, and a signal joins its days, so no step gathers the events of a key.
    """
    e = table(spark, sf, "events").where("ts is not null")
    span = e.agg(F.to_date(F.min("ts")).alias("first"), F.datediff(F.max("ts"), F.min("ts")).alias("days")).first()
    last = span["days"] or 0
    day = F.datediff(F.to_date("ts"), F.lit(span["first"]))
    slots = [F.avg(F.when(F.hour("ts") == h, F.col("value"))) for h in range(24)]
    daily = (
        e.withColumn("day", day)
        .groupBy("user_id", "event_type", "day")
        .agg(F.array(*[F.coalesce(s, F.lit(0.0)).cast("float") for s in slots]).alias("v"))
    )
    empty = F.array(*[F.lit(0.0).cast("float")] * 24)
    days = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda d: F.coalesce(F.col("m")[d], empty))
    return (
        daily.groupBy("user_id", "event_type")
        .agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
        .select(
            F.col("user_id").alias("record_id"),
            F.col("event_type").alias("lead"),
            F.lit(500).alias("fs"),
            F.flatten(days).alias("samples"),
        )
    )


SIG_T = """
span AS (SELECT min(ts)::DATE AS first, (datediff('day', min(ts)::DATE, max(ts)::DATE) + 1) * 24 AS hours FROM events),
hourly AS (
  SELECT user_id AS record_id, event_type AS lead, datediff('day', first, ts::DATE) * 24 + hour(ts) AS h, avg(value) AS v
  FROM events, span WHERE ts IS NOT NULL GROUP BY ALL),
sig_t AS (
  SELECT k.record_id, k.lead, list(coalesce(v, 0)::FLOAT::DOUBLE ORDER BY k.h) AS s
  FROM (SELECT record_id, lead, unnest(range(hours)) AS h FROM (SELECT DISTINCT record_id, lead FROM hourly), span) k
  LEFT JOIN hourly USING (record_id, lead, h) GROUP BY k.record_id, k.lead)"""


# --- files, histories, runs ----------------------------------------------------------

def disk_files(spark, sf) -> DataFrame:
    """What is on disk: name and digest of each document."""
    d = table(spark, sf, "documents")
    return d.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        "doc_id", F.sha2("text", 256).alias("digest"),
    )


def manifest_lines(spark, sf) -> DataFrame:
    """Text of a checksum manifest over the documents, with gaps, changed digests,
    absent files, both separators and malformed lines."""
    d = disk_files(spark, sf)
    i = F.col("doc_id")
    changed = F.when(i % FILES_ALTER == 0, F.reverse("digest")).otherwise(F.col("digest"))
    name = F.when(i % 3 == 0, F.translate("name", "/", "\\")).otherwise(F.col("name"))
    line = F.concat(F.upper(changed), F.when(i % 2 == 0, F.lit("  ")).otherwise(F.lit(" *")), name)
    listed = d.where(i % FILES_SKIP != 0).select(line.alias("value"))
    gone = d.where(i % 19 == 0).select(F.concat("digest", F.lit("  gone/"), i.cast("string")).alias("value"))
    bad = d.where(i % 23 == 0).select(F.col("digest").alias("value"))
    return listed.unionByName(gone).unionByName(bad)


FILES = """
disk AS (
  SELECT source || '/' || lang || '/' || doc_id || '.txt' AS name, doc_id, sha256(text) AS digest FROM documents),
listed AS (
  SELECT name, CASE WHEN doc_id % 13 = 0 THEN reverse(digest) ELSE digest END AS digest
  FROM disk WHERE doc_id % 17 <> 0
  UNION ALL SELECT 'gone/' || doc_id, digest FROM disk WHERE doc_id % 19 = 0)"""


def history(spark, sf) -> DataFrame:
    """Epoch histories: run = user mod 8, epoch = day; a metric may be undefined."""
    e = table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    # values have two decimals; whole cents make the mean independent of the summing order
    cents = F.round(F.col("value") * 100).cast("bigint")
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, cents)) / 100
    return (
        e.withColumn("run", F.col("user_id") % 8).withColumn("epoch", day)
        .groupBy("run", "epoch")
        .agg(
            mean("view").alias("train_loss"), mean("click").alias("macro_all"),
            mean("purchase").alias("macro_clean"), F.count(F.lit(1)).alias("n"),
        )
        .select(
            F.concat(F.lit("r"), F.col("run").cast("string")).alias("run_id"),
            F.floor(F.col("run") / 2).cast("int").alias("config"),
            (F.col("run") % 2).cast("int").alias("block"),
            "epoch", "train_loss", "macro_all",
            F.when(F.col("epoch") % 5 != 3, F.col("macro_clean")).alias("macro_clean"),
        )
    )


HIST = """
ev AS (
  SELECT user_id % 8 AS run, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS epoch, event_type, round(value * 100)::BIGINT AS cents FROM events),
hm AS (
  SELECT run, epoch, avg(cents) FILTER (event_type = 'view') / 100 AS train_loss,
         avg(cents) FILTER (event_type = 'click') / 100 AS macro_all,
         avg(cents) FILTER (event_type = 'purchase') / 100 AS mc
  FROM ev GROUP BY run, epoch),
hist AS (
  SELECT 'r' || run AS run_id, (run // 2)::INT AS config, (run % 2)::INT AS block, epoch, train_loss, macro_all,
         CASE WHEN epoch % 5 <> 3 THEN mc END AS macro_clean FROM hm)"""


def run_matrix(spark, sf) -> DataFrame:
    """``customer`` as a run matrix over blocks 0-4; one run per block and configuration."""
    c = table(spark, sf, "customer")
    block = (F.col("c_custkey") % 5).cast("int")
    rate = F.element_at(F.array(*[F.lit(r) for r in RUN_RATES]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return c.select(
        block.alias("block"),
        F.when(block.isin(0, 3, 4), F.lit(100)).otherwise(rate).alias("fs"),
        F.when((block == 2), F.lit("B")).otherwise(F.lit("A")).alias("arm"),
        block.isin(1, 2).alias("notch"),
        F.when(block == 4, F.lit("lr")).otherwise(F.lit("hr")).alias("source"),
        F.floor(F.col("c_custkey") / 5).cast("bigint").alias("seed"),
        F.when(block == 0, F.lit("macro_all")).otherwise(F.lit("macro_clean")).alias("selection"),
        F.col("c_custkey").alias("run_key"),
    ).withColumn("run_id", run_label("block", "fs", "arm", "notch", "seed"))


RUNS = """
runs AS (
  SELECT *, 'b' || block || '-fs' || fs || '-' || arm || '-n' || notch::INT || '-s' || seed AS run_id FROM (
    SELECT (c_custkey % 5)::INT AS block,
           CASE WHEN c_custkey % 5 IN (0,3,4) THEN 100 ELSE [100,240,250,500][c_nationkey % 4 + 1] END AS fs,
           CASE WHEN c_custkey % 5 = 2 THEN 'B' ELSE 'A' END AS arm,
           c_custkey % 5 IN (1,2) AS notch,
           CASE WHEN c_custkey % 5 = 4 THEN 'lr' ELSE 'hr' END AS source,
           c_custkey // 5 AS seed,
           CASE WHEN c_custkey % 5 = 0 THEN 'macro_all' ELSE 'macro_clean' END AS selection,
           c_custkey AS run_key FROM customer))"""
