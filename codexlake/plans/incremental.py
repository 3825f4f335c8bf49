"""Registered queries of incremental and streaming work, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codexlake.sources.scratch import new_path, written
from codexlake.streaming import board, gates, reprocess, state
from codexlake.streaming.tables import StateTable

RUNNERS = ("model_select", "kraken", "reconcile", "agent_b", "agent_c")
WAIT_MINUTES, LATE = 720, "1 day"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(_read(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _pick(values, c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def phase_board(spark, d):
    """Every event is a phase of its user's document; the board as a stream leaves it."""
    e = _stream(spark, d, "events")
    phases = e.select(F.col("user_id").cast("string").alias("doc_id"), _pick(state.STAGES, F.col("event_id")).alias("phase"), _pick((state.DONE, state.ERROR, "started"), F.floor(F.col("event_id") / 7)).alias("status"), F.col("event_type").alias("decision"), F.col("event_id").alias("ord"))
    table = StateTable(spark, new_path(spark, "board"), board.BOARD, ["doc_id"], "updated")
    board.follow(phases, table, new_path(spark, "board-offsets"), once=True).awaitTermination()
    line = F.transform("phases", lambda p: F.concat_ws(":", p.phase, p.status, p.decision, p.n.cast("string")))
    return table.read().select("doc_id", F.array_join(line, " ").alias("phases"), "n_events", "updated")


def _gates(spark, d) -> tuple[str, str]:
    """Views and clicks of a user post the user's gate, sign-ups and purchases answer it. The folders of the outcomes and the checkpoint."""
    e = _stream(spark, d, "events").where("event_type <> 'error'")
    answer = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    rows = e.select(F.col("user_id").cast("string").alias("gate"), answer.alias("decision"), F.when(answer.isNull(), F.concat(F.lit("m"), "event_id")).alias("message"), "ts", F.col("event_id").alias("ord"))
    out, check = new_path(spark, "gates"), new_path(spark, "gates-state")
    with gates.keyed_state(spark):
        query = gates.gate_stream(rows, WAIT_MINUTES, LATE).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, check


def gate_history(spark, d):
    return spark.read.schema(gates.OUTCOME).parquet(_gates(spark, d)[0])


def open_gates(spark, d):
    """What the stopped stream left open, from its checkpoint."""
    return gates.open_gates(spark, _gates(spark, d)[1])


def reprocess_report(spark, d):
    """The states that all events leave; each error asks for a field of its user's document again. Kraken fails on every fifth document."""
    e = _read(spark, d, "events")
    logged = e.select(F.col("user_id").alias("doc_id"), _pick(state.STAGES, F.col("event_id")).alias("stage"), _pick((state.DONE, state.ERROR, state.DIRTY), F.floor(F.col("event_id") / 7)).alias("status"), F.col("event_id").alias("ord"))
    states = state.advance(state.new_states(e.select(F.col("user_id").alias("doc_id"))), logged)
    asked = e.where("event_type = 'error'").select(F.col("user_id").alias("doc_id"), _pick(tuple(state.INVALIDATION), F.col("event_id")).alias("field"), F.lit(None).cast("string").alias("stage"))
    fails = {"kraken": (F.col("doc_id") % 5 == 0)}
    run = lambda s: lambda docs: docs.select("doc_id", F.lit(s).alias("artifact"), F.when(fails.get(s, F.lit(False)), "no image").alias("error"))
    report = reprocess.reprocess(states, asked, {s: run(s) for s in RUNNERS})[2]
    return report.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("ran", "skipped", "errors")], "published")


def order_outcomes(spark, d):
    """A customer is an order, its orders are the pages, the ledger holds customers with an urgent one that is finished; multiples of 13 fail."""
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("order_id"), F.col("o_orderkey").alias("page"), "o_orderstatus", "o_orderpriority")

    def process(row):
        if row["order_id"] % 13 == 0:
            raise ValueError("unreadable")
        return "done"

    asked = _read(spark, d, "customer").select(F.col("c_custkey").alias("order_id"))
    ledger = o.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("order_id")
    return reprocess.run_orders(asked, o, ledger, process)[0]


def second_passes(spark, d):
    """A document's century is that of the first model of its language that covers it, until it stays."""
    p = _read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("ordinal"), F.max("p_size").alias("size"))
    models = p.select("ordinal", _pick(("de", "es", "fr", "mul"), F.col("ordinal")).alias("lang"), (F.col("size") % 9 + 10).cast("int").alias("first"))
    covered = models.select("lang", "ordinal", "first", F.explode(F.sequence("first", F.col("first") + 2)).alias("century"))
    best = written(covered.groupBy("lang", "century").agg(F.min(F.struct("ordinal", "first")).alias("m")), "registry")
    derive = lambda rows: rows.join(best, ["lang", "century"], "left").select("doc_id", "lang", F.col("m.first").alias("century"), F.col("m.ordinal").alias("model"))
    criteria = _read(spark, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 9 + 11).cast("int").alias("century"))
    found, _ = reprocess.rerun_until_stable(criteria, derive, rounds=12)
    return found.select("doc_id", "lang", "century", "model", "round")


QUERIES = {f.__name__: f for f in (phase_board, gate_history, open_gates, reprocess_report, order_outcomes, second_passes)}

_STAGES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(state.STAGES))
_MATRIX = ", ".join(f"('{f}', '{s}')" for f, (dirty, _) in state.INVALIDATION.items() for s in dirty)
_FIELDS = ", ".join(f"'{f}'" for f in state.INVALIDATION)
#: The gates' state machine, a row at a time: what is open after row n, and the outcome that row n brought.
_GATES = f"""RECURSIVE rows AS (
        SELECT CAST(user_id AS VARCHAR) AS gate, CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS decision, 'm' || event_id AS message,
               epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'),
    steps AS (
        SELECT gate, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS message, CAST(NULL AS BIGINT) AS posted, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS whom, CAST(NULL AS BIGINT) AS was, CAST(NULL AS BIGINT) AS decided FROM (SELECT DISTINCT gate FROM rows)
        UNION ALL
        SELECT gate, n, CASE WHEN r_decision IS NOT NULL THEN NULL ELSE r_message END, CASE WHEN r_decision IS NOT NULL THEN NULL WHEN live THEN posted ELSE us END,
               CASE WHEN live THEN r_decision END, CASE WHEN live AND r_decision IS NOT NULL THEN 'human' WHEN posted IS NOT NULL AND NOT live THEN 'timeout' END,
               posted, CASE WHEN live THEN us ELSE posted + {WAIT_MINUTES * 60_000_000} END
        FROM (SELECT s.gate, r.n, s.posted, r.decision AS r_decision, r.message AS r_message, r.us, s.posted IS NOT NULL AND r.us <= s.posted + {WAIT_MINUTES * 60_000_000} AS live FROM steps s JOIN rows r ON r.gate = s.gate AND r.n = s.n + 1)),
    ends AS (SELECT gate, message, posted, posted + {WAIT_MINUTES * 60_000_000} AS deadline FROM steps s WHERE posted IS NOT NULL AND n = (SELECT max(n) FROM rows r WHERE r.gate = s.gate)),
    mark AS (SELECT max(us) - 86400000000 AS w FROM rows)"""

SQL = {
    "phase_board": f"""WITH stages(nth, phase) AS (VALUES {_STAGES}),
        e AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id % {len(state.STAGES)} AS nth, CASE (event_id // 7) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'started' END AS status, event_type, event_id FROM events),
        g AS (SELECT doc_id, nth, min(event_id) AS first, max(event_id) AS last, arg_max(status, event_id) AS status, arg_max(event_type, event_id) AS decision, count(*) AS n FROM e GROUP BY 1, 2)
        SELECT doc_id, string_agg(phase || ':' || status || ':' || decision || ':' || n, ' ' ORDER BY first) AS phases, CAST(sum(n) AS BIGINT) AS n_events, max(last) AS updated FROM g JOIN stages USING (nth) GROUP BY doc_id""",
    "gate_history": f"""WITH {_GATES}
        SELECT gate, decision, whom AS decided_by, was AS posted_us, decided AS decided_us FROM steps WHERE whom IS NOT NULL
        UNION ALL SELECT gate, NULL, 'timeout', posted, deadline FROM ends, mark WHERE deadline < w""",
    "open_gates": f"WITH {_GATES} SELECT gate, message, posted AS posted_us, deadline AS deadline_us FROM ends, mark WHERE deadline >= w",
    "reprocess_report": f"""WITH stages(nth, stage) AS (VALUES {_STAGES}), matrix(field, stage) AS (VALUES {_MATRIX}), docs AS (SELECT DISTINCT user_id AS doc_id FROM events),
        log AS (SELECT user_id AS doc_id, event_id % {len(state.STAGES)} AS nth, CASE (event_id // 7) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'dirty' END AS status, event_id AS ord FROM events),
        d AS (SELECT doc_id, nth, max(ord) FILTER (WHERE status = 'dirty') AS dirty FROM log GROUP BY 1, 2),
        o AS (SELECT doc_id, nth, arg_min(status, ord) AS status FROM log JOIN d USING (doc_id, nth) WHERE status <> 'dirty' AND ord > coalesce(dirty, -1) GROUP BY 1, 2),
        asked AS (SELECT DISTINCT user_id AS doc_id, [{_FIELDS}][1 + event_id % {len(state.INVALIDATION)}] AS field FROM events WHERE event_type = 'error'),
        hit AS (SELECT DISTINCT doc_id, stage FROM asked JOIN matrix USING (field)),
        s AS (SELECT docs.doc_id, nth, stages.stage, hit.stage IS NOT NULL OR coalesce(o.status, 'pending') IN ('pending', 'dirty') AS open
              FROM docs CROSS JOIN stages LEFT JOIN d USING (doc_id, nth) LEFT JOIN o USING (doc_id, nth) LEFT JOIN hit ON hit.doc_id = docs.doc_id AND hit.stage = stages.stage WHERE docs.doc_id IN (SELECT doc_id FROM asked)),
        f AS (SELECT *, bool_or(stage = 'kraken' AND open AND doc_id % 5 = 0) OVER (PARTITION BY doc_id) AS fails FROM s),
        r AS (SELECT *, open AND stage NOT IN ('vlm', 'agent_d') AND NOT (fails AND nth > 3) AS ran FROM f)
        SELECT doc_id, coalesce(string_agg(stage, ',' ORDER BY nth) FILTER (WHERE ran), '') AS ran, coalesce(string_agg(stage, ',' ORDER BY nth) FILTER (WHERE NOT ran), '') AS skipped,
               CASE WHEN bool_or(fails) THEN 'kraken' ELSE '' END AS errors, bool_or(ran) AND NOT bool_or(fails) AS published FROM r GROUP BY doc_id""",
    "order_outcomes": """WITH n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
        p AS (SELECT c_custkey AS order_id, coalesce(n.n, 0) AS n_pages, l.k IS NOT NULL AS known FROM customer LEFT JOIN n ON n.k = c_custkey LEFT JOIN l ON l.k = c_custkey)
        SELECT order_id, n_pages, CASE WHEN known THEN 'skipped' WHEN n_pages = 0 THEN 'empty' WHEN order_id % 13 = 0 THEN 'errors' ELSE 'done' END AS outcome,
               CASE WHEN NOT known AND n_pages > 0 AND order_id % 13 = 0 THEN 'unreadable' END AS error FROM p""",
    "second_passes": """WITH RECURSIVE p AS (SELECT min(p_partkey) AS ordinal, max(p_size) AS size FROM part GROUP BY p_brand, p_type),
        m AS (SELECT ordinal, ['de', 'es', 'fr', 'mul'][1 + ordinal % 4] AS lang, size % 9 + 10 AS first FROM p),
        best AS (SELECT lang, century, min(ordinal) AS model, arg_min(first, ordinal) AS first FROM (SELECT *, unnest([first, first + 1, first + 2]) AS century FROM m) GROUP BY 1, 2),
        r AS (SELECT doc_id, lang, doc_id % 9 + 11 AS c, 0 AS round, true AS changed, CAST(NULL AS BIGINT) AS model FROM documents
              UNION ALL SELECT r.doc_id, r.lang, coalesce(b.first, r.c), r.round + 1, coalesce(b.first, r.c) <> r.c, b.model FROM r LEFT JOIN best b ON b.lang = r.lang AND b.century = r.c WHERE r.changed AND r.round < 12)
        SELECT doc_id, lang, CAST(c AS INTEGER) AS century, model, round FROM r WHERE round > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round DESC) = 1""",
}
