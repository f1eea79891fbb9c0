"""Registry that pairs a query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Replicates in the registered bootstrap queries and their SQL.
N_BOOT = 2_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_(*ctes: str) -> str:
    """``WITH`` clause from named fragments, each kept once."""
    seen: list[str] = []
    for c in ctes:
        c = c.strip().rstrip(",")
        if c not in seen:
            seen.append(c)
    return "WITH " + ",\n".join(seen) + "\n"


def rnd(c: str | Column, digits: int = 8, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


def auroc_cte(src: str, keys: str, name: str = "sc") -> str:
    """Unweighted AUROC through midranks, an independent form of the operator."""
    return f"""
{name}_r AS (
  SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY score)
         + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS mr FROM {src}),
{name} AS (
  SELECT {keys}, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0
         THEN (rp - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos::DOUBLE * n_neg) END AS auroc FROM (
    SELECT {keys}, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, coalesce(sum(mr) FILTER (y = 1), 0) AS rp
    FROM {name}_r GROUP BY {keys}))"""


def weighted_auroc_cte(src: str, keys: str, name: str = "wsc") -> str:
    return f"""
{name}_c AS (
  SELECT {keys}, score, sum(CASE WHEN y > 0 THEN w ELSE 0 END)::BIGINT AS pos,
         sum(CASE WHEN y > 0 THEN 0 ELSE w END)::BIGINT AS neg FROM {src} GROUP BY {keys}, score),
{name}_s AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM {name}_c),
{name} AS (
  SELECT {keys}, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (2 * below + neg))::DOUBLE
           / (2.0::DOUBLE * sum(pos)::DOUBLE * sum(neg)::DOUBLE) END AS auroc
  FROM {name}_s GROUP BY {keys})"""


def ap_cte(src: str, keys: str, name: str = "ap") -> str:
    return f"""
{name}_c AS (SELECT {keys}, score, sum(y)::BIGINT AS pos, count(*) AS n FROM {src} GROUP BY {keys}, score),
{name}_s AS (
  SELECT *, sum(pos) OVER v AS tp, sum(n) OVER v AS seen FROM {name}_c
  WINDOW v AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT {keys}, CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0
         THEN sum(pos * tp::DOUBLE / seen) / sum(pos) END AS auprc FROM {name}_s GROUP BY {keys})"""


def weighted_ap_cte(src: str, keys: str, name: str = "wap") -> str:
    return f"""
{name}_c AS (
  SELECT {keys}, score, sum(CASE WHEN y > 0 THEN w ELSE 0 END)::BIGINT AS pos, sum(w)::BIGINT AS n FROM {src} GROUP BY {keys}, score),
{name}_s AS (
  SELECT *, sum(pos) OVER v AS tp, sum(n) OVER v AS seen FROM {name}_c
  WINDOW v AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{name} AS (
  SELECT {keys}, CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0
         THEN sum(pos * tp::DOUBLE / seen) / sum(pos) END AS auprc FROM {name}_s GROUP BY {keys})"""


def weights_cte(src: str, n_boot: int = N_BOOT, seed: int = 0) -> str:
    return f"""
ids AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS idx FROM (SELECT DISTINCT record_id FROM {src})),
size AS (SELECT count(*) AS n FROM ids),
draws AS (
  SELECT rep, ('0x' || substr(md5('{seed}:' || rep || ':' || h), 1 + 15 * k, 15))::BIGINT % n AS idx
  FROM (SELECT rep, n, unnest(range((n + 1) // 2)) AS h FROM range({n_boot}) t(rep), size), (VALUES (0), (1)) v(k)
  WHERE 2 * h + k < n),
weights AS (SELECT rep, record_id, count(*) AS w FROM draws JOIN ids USING (idx) GROUP BY ALL)"""


ENSEMBLE = """
ens AS (SELECT grp, record_id, label, max(y) AS y, avg(score) AS score FROM pred_s GROUP BY ALL)"""
