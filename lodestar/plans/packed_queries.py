"""Packed fields and snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.packed import MAX_ENTRIES, split_packed
from lodestar.operators.records import latest_per_key
from lodestar.operators.snapshots import snapshot_changes
from lodestar.storage import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    entries = [r[0] for r in table(spark, d, "source_sector_map").select("source_sector").where(F.col("source_sector").isNotNull()).limit(MAX_ENTRIES + 1).collect()]
    packed = table(spark, d, "technology").where(F.col("id").isNotNull()).select("id", "source_sector", "fetched_at")
    records = latest_per_key(packed, ["id"], ["fetched_at"], ["source_sector"]).select(F.lit("technology").alias("rec_table"), F.col("id").alias("rec_key"), F.col("source_sector").alias("field"))
    codes = latest_per_key(table(spark, d, "ntb_to_ics"), ["ntb_code"], ["ics_codes"], ["ics_codes"]).select(F.lit("ntb_to_ics").alias("rec_table"), F.col("ntb_code").alias("rec_key"), F.col("ics_codes").alias("field"))
    return split_packed(records, "field", entries).unionByName(split_packed(codes, "field", [], blank_separates=True)).select("rec_table", "rec_key", "pos", "value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    snapshots = table(spark, d, "snapshot_record")
    numbers = [r[0] for r in snapshots.select("snapshot_no").where(F.col("snapshot_no").isNotNull()).distinct().collect()]
    return snapshot_changes(snapshots, numbers, "snapshot_no", "source_id", "id", ["title", "summary"], "fetched_at")


QUERIES = {f.__name__: f for f in (p1_found, p5_found)}
#: Holds for the fields of these tables, whose values are listed categories or plain words, and codes.
_VALUES = r"""WITH e AS (SELECT string_agg(regexp_escape(source_sector), '|' ORDER BY length(source_sector) DESC, source_sector) AS listed FROM source_sector_map),
t AS (SELECT id, source_sector FROM technology QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC) = 1),
v AS (SELECT 'technology' AS rec_table, id AS rec_key, regexp_extract_all(regexp_replace(replace(source_sector, '\,', ','), '<[^>]*>', ';', 'g'), (SELECT listed FROM e) || '|[A-Za-z][A-Za-z &-]*[A-Za-z]') AS l FROM t
 UNION ALL SELECT 'ntb_to_ics', ntb_code, regexp_extract_all(ics_codes, '\d\d(?:\.\d+)?') FROM ntb_to_ics)
SELECT rec_table, rec_key, CAST(generate_subscripts(l, 1) AS INT) AS pos, trim(unnest(l)) AS value FROM v"""
SQL = {
    "p1_found": _VALUES,
    "p5_found": r"""
WITH cleaned AS (
  SELECT snapshot_no, coalesce(source_id, '') AS src, trim(regexp_replace(id, '[\s\x{A0}\x{3000}]+', ' ', 'g')) AS id, fetched_at,
         trim(regexp_replace(nfc_normalize(coalesce(title, '')), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS t,
         trim(regexp_replace(nfc_normalize(coalesce(summary, '')), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+', ' ', 'g')) AS s
  FROM snapshot_record WHERE id IS NOT NULL),
kept AS (SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY src, snapshot_no, id ORDER BY fetched_at DESC) = 1),
delivered AS (SELECT src, snapshot_no, lag(snapshot_no) OVER (PARTITION BY src ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT src, snapshot_no FROM kept)),
compared AS (
  SELECT d.snapshot_no, coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN n.t <> o.t OR n.s <> o.s THEN 'changed' END AS change_kind
  FROM (SELECT DISTINCT d.src, d.snapshot_no, d.before, k.id FROM delivered d JOIN kept k ON k.src = d.src AND k.snapshot_no IN (d.snapshot_no, d.before) WHERE d.before IS NOT NULL) d
  LEFT JOIN kept n ON n.src = d.src AND n.snapshot_no = d.snapshot_no AND n.id = d.id
  LEFT JOIN kept o ON o.src = d.src AND o.snapshot_no = d.before AND o.id = d.id)
SELECT DISTINCT snapshot_no, id, change_kind FROM compared WHERE change_kind IS NOT NULL""",
}
