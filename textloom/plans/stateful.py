"""Stateful queries: TTL replay protection by user."""

from __future__ import annotations

from textloom.plans import query
from textloom.plans.relational import table
from textloom.streaming import ttl


@query("t7_replay_protection", """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT event_id, user_id, r, ts AS last, true AS accepted FROM e WHERE r = 1
UNION ALL SELECT e.event_id, e.user_id, e.r, CASE WHEN e.ts - s.last >= INTERVAL 300 SECOND THEN e.ts ELSE s.last END, e.ts - s.last >= INTERVAL 300 SECOND FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT event_id, accepted FROM s""")
def t7(spark, d):
    return ttl.replay_batch(table(spark, d, "events"), "user_id", 300.0)
