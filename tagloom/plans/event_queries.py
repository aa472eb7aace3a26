"""Ordered and event operators over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import events as E
from tagloom.plans.shapes import read


def _ev(spark, d):
    return read(spark, d, "events").withColumn("t", E.seconds("ts"))


def first_up(spark, d):
    return E.first_up(_ev(spark, d).select("event_type", "t", "event_id", "user_id"), "event_type", ["t", "event_id"])


def arrival_clusters(spark, d):
    """Bursts of a user's events with gaps of over an hour between them: how many events in each."""
    c = E.arrival_clusters(_ev(spark, d).select("user_id", "t", "event_id"), "user_id", "t", 3600.0, "event_id")
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def session_clusters(spark, d):
    """The same by session windows: events of a user and the number of sessions."""
    g = read(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def chatter(spark, d):
    c = E.chatter(_ev(spark, d).filter("event_type = 'error'"), "user_id", "t", "event_id")
    return c.select("user_id", F.round("at", 3).alias("at"), F.round("span", 3).alias("span"))


def flood(spark, d):
    f = E.board_flood(_ev(spark, d), "event_type", "user_id", "t")
    return f.select("event_type", F.round("at", 3).alias("at"))


def sliding_flood(spark, d):
    return E.sliding_flood(read(spark, d, "events"), "event_type", "ts", "12 hours", "6 hours", 5)


def active_set(spark, d):
    """Users with an error in the first half of the time."""
    e = _ev(spark, d)
    now = e.agg((F.min("t") + F.max("t")) / 2).first()[0]
    return E.active_at(e.filter("event_type = 'error'"), "user_id", "t", F.lit(now)).select("user_id")


def drift_warning(spark, d):
    w = E.drift_warnings(_ev(spark, d), "user_id", "t", "value", "event_id")
    return w.select("user_id", F.col("i").cast("long").alias("sample"), F.round("v", 4).alias("v"), F.round("slope", 6).alias("slope"))


def first_breach(spark, d):
    return E.first_breach(_ev(spark, d), "user_id", ["t", "event_id"], F.col("value") > 90)


def drift_onset(spark, d):
    e = _ev(spark, d)
    o = E.drift_onset(e, e.filter("event_type = 'error'"), "user_id", "t", "value", calm=30.0)
    return o.select("user_id", F.round("lead", 3).alias("lead"), F.col("onset").isNotNull().alias("calm_seen"))


def isolated_onsets(spark, d):
    e = _ev(spark, d).groupBy("event_type", "user_id").agg(F.min("t").alias("t"))
    return E.isolated(e, "event_type", "t", 86400.0).select("event_type", "user_id")


def step_folding(spark, d):
    """Conversations as ordered lines; turns of the user count as numbered steps."""
    c = read(spark, d, "conversations")
    lines = c.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("role") == "user", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).alias("line"))
    f = E.fold_steps(lines, "conv_id", "turn", "line")
    return f.select("conv_id", "step", F.length("body").cast("long").alias("n_chars"))


def leader_changes(spark, d):
    """Each time another user takes the lead in a month's running count of errors."""
    e = _ev(spark, d).filter("event_type = 'error'").select(F.date_format("ts", "yyyy-MM").alias("month"), "user_id", "t", "event_id")
    c = E.leader_changes(e, "month", "user_id", "t", "event_id")
    return c.select("month", "event_id", "leader", "before", "n")


QUERIES = {f.__name__: f for f in (first_up, arrival_clusters, session_clusters, chatter, flood, sliding_flood, active_set, drift_warning, first_breach, drift_onset, isolated_onsets, step_folding, leader_changes)}
_T = "e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
ORACLES = {
    "first_up": f"WITH {_T} SELECT event_type, t, event_id, user_id FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) = 1",
    "arrival_clusters": f"""WITH {_T}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g) SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_event FROM c GROUP BY user_id, cluster""",
    "session_clusters": f"WITH {_T}, g AS (SELECT user_id, CASE WHEN lag(t) OVER (PARTITION BY user_id ORDER BY t) IS NULL OR t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 3600 THEN 1 ELSE 0 END AS new FROM e) SELECT user_id, CAST(sum(new) AS BIGINT) AS n_sessions, count(*) AS n_events FROM g GROUP BY user_id",
    "chatter": f"WITH {_T}, r AS (SELECT user_id, t, row_number() OVER w AS n, first_value(t) OVER w AS f FROM e WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, round(t, 3) AS at, round(t - f, 3) AS span FROM r WHERE n = 3",
    "flood": f"WITH {_T}, f AS (SELECT event_type, user_id, min(t) AS t FROM e GROUP BY ALL) SELECT event_type, round(t, 3) AS at FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY t, user_id) = 10",
    "sliding_flood": """WITH w AS (SELECT event_type, unnest([epoch_us(ts) // 1000000 // 21600 * 21600, epoch_us(ts) // 1000000 // 21600 * 21600 - 21600]) AS start FROM events)
        SELECT event_type, start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 5""",
    "active_set": f"WITH {_T} SELECT user_id FROM e WHERE event_type = 'error' GROUP BY user_id HAVING min(t) <= (SELECT (min(t) + max(t)) / 2 FROM e)",
    "drift_warning": f"""WITH {_T}, s AS (SELECT user_id, t, value AS v, lag(t, 3) OVER w AS t0, lag(value, 3) OVER w AS v0, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
        f AS (SELECT * FROM s WHERE i >= 4 AND abs(v - 50) >= 6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i) = 1) SELECT user_id, i AS sample, round(v, 4) AS v, round((v - v0) / greatest(0.5, t - t0), 6) AS slope FROM f""",
    "first_breach": f"WITH {_T}, s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e) SELECT user_id, min(i) AS index FROM s WHERE value > 90 GROUP BY user_id",
    "drift_onset": f"""WITH {_T}, a AS (SELECT user_id, min(t) AS alarm FROM e WHERE event_type = 'error' GROUP BY 1), o AS (SELECT user_id, max(t) AS onset FROM e JOIN a USING (user_id) WHERE t < alarm AND abs(value - 50) <= 30 GROUP BY 1)
        SELECT user_id, round(coalesce(least(15.0, greatest(4.0, alarm - onset)), 8.0), 3) AS lead, onset IS NOT NULL AS calm_seen FROM a LEFT JOIN o USING (user_id)""",
    "isolated_onsets": f"""WITH {_T}, o AS (SELECT event_type, user_id, min(t) AS t FROM e GROUP BY ALL), m AS (SELECT event_type, list_sort(list(t)) AS s FROM o GROUP BY 1)
        SELECT event_type, user_id FROM o JOIN m USING (event_type) WHERE abs(t - s[len(s) // 2 + 1]) > 86400""",
    "step_folding": """WITH l AS (SELECT conv_id, turn, trim(CASE WHEN role = 'user' THEN (turn + 1) || '. ' || coalesce(text, '') ELSE coalesce(text, '') END, ' ') AS line, CASE WHEN role = 'user' THEN turn + 1 END AS s FROM conversations),
        f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS step FROM l) SELECT conv_id, CAST(step AS INT) AS step, sum(length(line))::BIGINT + count(*) - 1 AS n_chars FROM f WHERE step IS NOT NULL GROUP BY ALL""",
    "leader_changes": f"""WITH {_T}, r AS (SELECT strftime(ts, '%Y-%m') AS month, user_id, t, event_id FROM e WHERE event_type = 'error'),
        g AS (SELECT r.*, row_number() OVER (PARTITION BY month, user_id ORDER BY t, event_id) AS n FROM r), b AS (SELECT *, coalesce(max(n) OVER (PARTITION BY month ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM g),
        l AS (SELECT month, event_id, user_id AS leader, lag(user_id) OVER (PARTITION BY month ORDER BY t, event_id) AS before, n FROM b WHERE n > best)
        SELECT month, event_id, leader, before, n FROM l WHERE before <> leader""",
}
