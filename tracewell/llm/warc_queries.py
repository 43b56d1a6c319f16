"""op7: every page written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import tables, warc
from tracewell.llm.registry import query

SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


@query("op7_warc", SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder, archives = warc.write_archives(pages)
    back = warc.read_archives(spark, folder, archives).filter(F.col("reason").isNull())
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
