"""Events as a log of calls: cached answers and providers with a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators.calls import CACHE_SECONDS, cache_outcomes, routed
from siltwork.plans.frames import table
from siltwork.plans.registry import query

CACHE_SQL = """
    WITH RECURSIVE e AS (SELECT event_id, event_type || '-' || (user_id % 10) AS prompt, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    t AS (SELECT DISTINCT prompt, sec FROM e), n AS (SELECT prompt, sec, min(sec) OVER (PARTITION BY prompt ORDER BY sec RANGE BETWEEN 43200 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM t),
    m AS (SELECT prompt, min(sec) AS sec FROM t GROUP BY prompt UNION ALL SELECT n.prompt, n.next FROM m JOIN n ON n.prompt = m.prompt AND n.sec = m.sec WHERE n.next IS NOT NULL),
    f AS (SELECT e.*, max(m.sec) OVER (PARTITION BY e.prompt ORDER BY e.sec) AS filled_at FROM e LEFT JOIN m ON e.prompt = m.prompt AND e.sec = m.sec)
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call per event, of fifty prompts."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("prompt"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


@query(f"{CACHE_SQL} SELECT event_id, filled_at, sec = filled_at AND event_id = min(event_id) OVER (PARTITION BY prompt, sec) AS missed FROM f")
def cached_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls answered from a cache whose entries live twelve hours from the call that filled them."""
    c = prompts(spark, sf_dir).select("event_id", "prompt", "at")
    return cache_outcomes(c, ["prompt"], "at", CACHE_SECONDS).select("event_id", "filled_at", (~F.col("hit")).alias("missed"))


@query("""
    WITH e AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, event_type = 'purchase' AS private, user_id % 5 AS kind FROM events),
    a AS (SELECT *, NOT private AND kind <> 0 AS able, row_number() OVER (PARTITION BY day, NOT private AND kind <> 0 ORDER BY ts, event_id) AS place FROM e),
    b AS (SELECT *, NOT private AS able_b, row_number() OVER (PARTITION BY day, NOT private ORDER BY ts, event_id) AS place_b FROM a WHERE NOT (able AND place <= 100)),
    c AS (SELECT *, NOT private AND kind < 3 AS able_c, row_number() OVER (PARTITION BY day, NOT private AND kind < 3 ORDER BY ts, event_id) AS place_c FROM b WHERE NOT (able_b AND place_b <= 40)),
    d AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS place_d FROM c WHERE NOT (able_c AND place_c <= 30))
    SELECT event_id, 'fast' AS provider FROM a WHERE able AND place <= 100 UNION ALL SELECT event_id, 'steady' FROM b WHERE able_b AND place_b <= 40
    UNION ALL SELECT event_id, 'free' FROM c WHERE able_c AND place_c <= 30 UNION ALL SELECT event_id, CASE WHEN place_d <= 60 THEN 'local' END FROM d
""")
def routed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that fill the daily budgets of three hosted providers and a local one; private ones only the last."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_type") == "purchase").alias("private"), (F.col("user_id") % 5).alias("kind"))
    public, kind = ~F.col("private"), F.col("kind")
    ladder = [("fast", 100, public & (kind != 0)), ("steady", 40, public), ("free", 30, public & (kind < 3)), ("local", 60, F.lit(True))]
    return routed(e, "day", [F.col("ts"), F.col("event_id")], ladder).select("event_id", "provider")
