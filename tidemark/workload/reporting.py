"""The report of a run over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import report
from ..session import written
from . import rules, tables as t
from .registry import query

_SQL = t.with_(t.FULL + " balances deposits delivered ruled judged", """
SELECT 'tables' AS section, name, '' AS detail, found FROM (
  SELECT 'dim_client' AS name, count(*) AS found FROM dim UNION ALL SELECT 'fact_deposit', count(*) FROM deposits UNION ALL
  SELECT 'fact_trade', count(*) FROM lineitem UNION ALL SELECT 'fact_client_balance_history', count(*) FROM balances UNION ALL
  SELECT 'quarantine', count(*) FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE') UNION ALL
  SELECT 'ingestion_file_manifest', count(DISTINCT file_name) FROM judged UNION ALL SELECT 'cdc_processing_ledger', count(*) FROM feed) n
UNION ALL
SELECT 'history', unnest(['overlapping versions', 'gaps between versions', 'backward versions']), '',
       unnest([count(*) FILTER (WHERE reach > valid_from), count(*) FILTER (WHERE place > 1 AND previous IS DISTINCT FROM valid_from), count(*) FILTER (WHERE valid_to < valid_from)])
FROM (SELECT *, max(coalesce(valid_to, TIMESTAMP '9999-12-31 00:00:00')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
             lag(valid_to) OVER w AS previous, row_number() OVER w AS place FROM dim WINDOW w AS (PARTITION BY client_id ORDER BY valid_from, client_sk)) h
UNION ALL SELECT 'keys', 'fact_deposit', '', count(*) FROM (SELECT 1 FROM deposits GROUP BY source_system, deposit_id HAVING count(*) > 1) k
UNION ALL SELECT 'keys', 'fact_trade', '', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) k
UNION ALL SELECT 'keys', 'cdc_processing_ledger', '', count(*) FROM (SELECT 1 FROM feed GROUP BY lsn HAVING count(*) > 1) k
UNION ALL SELECT 'keys', 'dim_client', '', count(*) FROM (SELECT 1 FROM dim GROUP BY client_sk HAVING count(*) > 1) k
UNION ALL SELECT 'quarantine', disposition, CASE WHEN disposition IN ('ORPHAN_CLIENT', 'DUPLICATE_CONFLICT') THEN 'ERROR' ELSE 'CRITICAL' END, count(*)
FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE') GROUP BY disposition
UNION ALL SELECT 'quarantine', 'resolved', '', 0
UNION ALL SELECT 'deposits', source_system, CASE source_system WHEN 'vendor' THEN 'CANONICAL_VENDOR' ELSE 'CANONICAL_WAREHOUSE' END, count(*) FROM deposits GROUP BY source_system
UNION ALL SELECT 'deposits', 'vendor deposits like a warehouse one', '', count(DISTINCT v.deposit_id) FROM deposits v JOIN deposits w
  ON v.source_system = 'vendor' AND w.source_system = 'warehouse' AND v.client_id = w.client_id AND v.deposit_date = w.deposit_date
     AND v.payment_method = w.payment_method AND abs(v.amount_usd - w.amount_usd) <= 0.01
UNION ALL SELECT 'deposits', 'without lineage', '', count(*) FROM deposits WHERE status = 'failed'
UNION ALL SELECT 'feed', 'missing positions', '', coalesce(max(lsn) - min(lsn) + 1 - count(DISTINCT lsn), 0) FROM feed
UNION ALL SELECT 'feed', 'contract', 'DELETE_WITHOUT_BEFORE', count(*) FROM feed WHERE op = 'delete' HAVING count(*) > 0
UNION ALL SELECT 'feed', 'inserts that contradict the dimension', '', count(*) FROM feed f JOIN dim d ON f.client_id = d.client_id
WHERE f.op = 'insert' AND d.is_current AND f.has_risk AND d.risk_category <> 'low'
UNION ALL SELECT 'files', 'names delivered with other content', '', 0
UNION ALL SELECT 'files', 'below 99 % valid rows', '', count(*) FROM (
  SELECT file_name FROM judged GROUP BY file_name HAVING count(*) FILTER (WHERE disposition NOT IN ('STAGED', 'DUPLICATE')) > 0.01 * count(*)) s
UNION ALL SELECT 'contract', source_system, 'UNKNOWN_METHOD', count(*) FROM deposits GROUP BY source_system""")


@query("run_report", _SQL)
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, invariants, breakdowns and signals in one list. Failed deposits have lost their lineage here."""
    dim, applied = t.full_dimension(spark, folder)
    judged = written(rules._judged(spark, folder, keep=()).drop("row_hash").withColumn("raw_payload", F.lit("{}")), "judged")
    deposits = rules._canonical(t.deposits(spark, folder)).withColumns(
        {"file_name": F.when(F.col("status") != "failed", "deposits"), "batch_id": F.lit("b1")})
    tables = {
        "dim_client": written(dim, "dim"), "fact_deposit": written(deposits, "deposits"), "raw_cdc_events": t.feed(spark, folder),
        "fact_trade": t.table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id")),
        "fact_client_balance_history": applied.balances, "cdc_processing_ledger": written(applied.outcomes.select("lsn"), "ledger"),
        "quarantine": rules._records(judged, F.col("row_num")), "ingestion_file_manifest": written(rules._manifest(judged), "manifest"),
    }
    return report.report(tables.__getitem__)
