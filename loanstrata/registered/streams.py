"""Streaming queries over the event table, read as files that arrive, next to the batch SQL of the same windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanstrata.plans.tape import table
from loanstrata.registered import register
from loanstrata.registered.profiling import rounded
from loanstrata.streaming.drift import frozen_baseline, window_psi, window_rates


def arriving(spark, folder):
    # A stream reads a folder or a pattern; as a pattern the table may be one file or a folder of them.
    return spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]")


_EDGES = ", ".join(f"q[{i}]" for i in range(2, 11))


@register("stream_window_psi",
    "WITH e AS (SELECT quantile_cont(value, [" + ", ".join(str(i / 10) for i in range(11)) + "]) AS q FROM events WHERE ts < TIMESTAMP "
    "'2024-01-11'), v AS (SELECT ts, len(list_filter([" + _EDGES + "], lambda x: value >= x)) AS bin FROM events, e WHERE value IS NOT NULL "
    "AND ts IS NOT NULL), r AS (SELECT bin, count(*) / (SELECT count(*) FROM v WHERE ts < TIMESTAMP '2024-01-11') AS s FROM v "
    "WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1), b AS (SELECT unnest(range(10)) AS bin), d AS (SELECT date_trunc('day', ts) AS day, "
    "count(*) AS n FROM v GROUP BY 1), c AS (SELECT date_trunc('day', ts) AS day, bin, count(*) AS k FROM v GROUP BY 1, 2), "
    "f AS (SELECT day, n, coalesce(k / n, 0.0001) AS a, coalesce(s, 0.0001) AS e FROM d CROSS JOIN b LEFT JOIN c USING (day, bin) "
    "LEFT JOIN r USING (bin)), p AS (SELECT day, n, sum((a - e) * ln(a / e)) AS psi FROM f GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') "
    "AS day, n, round(psi, 6) AS psi, CASE WHEN psi < 0.1 THEN 'PASS' WHEN psi < 0.25 THEN 'WARN' ELSE 'FAIL' END AS status FROM p")
def stream_window_psi(spark, folder):
    """Daily drift of event values against the first ten days, by a stream over the event files."""
    reference = table(spark, folder, "events").where("ts < timestamp_ntz '2024-01-11'")
    edges, shares = frozen_baseline(reference, "value")
    out = window_psi(arriving(spark, folder), "ts", "value", edges, shares)
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "psi", "status"), psi=6)


@register("stream_event_rates",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(count(*) / sum(count(*)) OVER "
    "(PARTITION BY date_trunc('day', ts)), 6) AS rate FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('day', ts), event_type")
def stream_event_rates(spark, folder):
    """Share of each kind of event per day, by a stream over the event files."""
    out = window_rates(arriving(spark, folder), "ts", F.col("event_type"))
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "n", "rate"), rate=6)
