"""Queries of the language-model problems (p3, p6, p7, p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..session import cut, remove_folder, shared_folder, table
from . import bpe, leaks, seen, spans

SOURCES = ("blobs", "output_files")


def _digest_rows(spark: SparkSession, sf: str) -> list[DataFrame]:
    blobs = table(spark, sf, "blobs").select(F.col("blob_id").alias("id"), digests.digest_key("digest", "algorithm").alias("key"))
    files = table(spark, sf, "output_files").select(F.col("output_id").alias("id"), digests.digest_key("digest").alias("key"))
    return [x.where(digests.is_well_formed(F.col("key"))) for x in (blobs, files)]


def _row_count(spark: SparkSession, sf: str) -> int:
    return sum(table(spark, sf, t).count() for t in SOURCES)


def _source(part: str = "part"):
    return F.element_at(F.array(*map(F.lit, SOURCES)), F.col(part).cast("int") + 1)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = seen.seen_before(_digest_rows(spark, sf), rows=_row_count(spark, sf))
    return found.select(_source().alias("source_table"), F.col("id").alias("row_id"))


def p3_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The measured rate of wrong answers: the keys of each table are sealed, and the
    stored filters probed with certainly absent keys."""
    out = None
    for name, rows in zip(SOURCES, _digest_rows(spark, sf)):
        folder = shared_folder(spark, "keys")
        seen.seal(rows, folder)
        one = cut(seen.audit_store(spark, folder).where("keys > 0").withColumn("source_table", F.lit(name)))
        remove_folder(spark, folder)
        out = one if out is None else out.unionByName(one)
    return out.select("source_table", "keys", "filters", "bytes", "probes", "wrong", "rate", "bound")


def p3_sealed(spark: SparkSession, sf: str) -> DataFrame:
    """Output files whose digest was put as a blob, told from sealed filters of the blobs alone."""
    blobs, files = _digest_rows(spark, sf)
    folder = shared_folder(spark, "keys")
    seen.seal(blobs, folder)
    out = cut(seen.probe(files, folder))
    remove_folder(spark, folder)
    return out.select(F.col("id").alias("output_id"))


_WHITE = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)"

_P3_KEYS = f"""
with b as (
  select blob_id as id, lower(trim(digest, {_WHITE})) as d, lower(trim(algorithm, {_WHITE})) as a from blobs
),
k as (
  select 'blobs' as source_table, id, case when contains(d, ':') then d else coalesce(nullif(a, ''), 'blake3') || ':' || d end as key from b
  union all
  select 'output_files', output_id, case when contains(digest, ':') then lower(trim(digest, {_WHITE})) else 'blake3:' || lower(trim(digest, {_WHITE})) end from output_files
),
w as (select * from k where regexp_full_match(key, '(blake3|sha256):[0-9a-f]{{64}}'))
"""

P3_FOUND = (
    _P3_KEYS
    + """, f as (select source_table, key, min(id) as first from w group by 1, 2)
select distinct w.source_table, w.id as row_id from w join f on w.source_table = f.source_table and w.key = f.key where w.id > f.first
"""
)

P3_SEALED = _P3_KEYS + "select distinct id as output_id from w where source_table = 'output_files' and key in (select key from w where source_table = 'blobs')"

QUERIES = {"p3_found": p3_found, "p3_audit": p3_audit, "p3_sealed": p3_sealed}
SQL = {"p3_found": P3_FOUND, "p3_sealed": P3_SEALED}


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf, "documents"), "doc_id", "text")


QUERIES["p6_ids"] = p6_ids


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf, "documents"), "doc_id", "text")


def p8_share(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document that shares something is shared elsewhere."""
    return spans.shared_share(p8_found(spark, sf), table(spark, sf, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document is shared elsewhere, 0 for those that share nothing."""
    return spans.shared_share(p8_found(spark, sf), table(spark, sf, "documents"), "doc_id", "text", every=True)


QUERIES |= {"p8_found": p8_found, "p8_share": p8_share, "p8_shares": p8_shares}


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.removal_spans(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES |= {"p7_found": p7_found, "p7_spans": p7_spans, "p7_items": p7_items}
