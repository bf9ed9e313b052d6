"""Session jobs on the event log: a user's events are a session, an event's type its command, its props the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdspark.functions.storage import materialize
from cmdspark.operators import advice, mining, validation

from . import command_jobs, validation_jobs
from .mining_jobs import LONG, ORDER, SESSION, event_sequence, table

RULES = advice.StateRules(
    flags=("signed_up", "viewed", "bought"),
    sets={"signed_up": ("signup",), "viewed": ("view", "click"), "bought": ("purchase",)},
    clears={"viewed": ("error",)},
    line_sets=(("bought", ("signup",), "9"),),
    warn=(("purchase", ("viewed",), "nothing viewed"), ("purchase", ("signed_up",), "not signed up"), ("error", ("viewed", "bought"), "error first")),
)
#: Events of this type are left out of the model, so that it has unseen transitions.
MODEL_NOISE = "^signup$"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a command log; an event counts as valid below one value, as existing below another."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("command"), F.col("props").alias("cmd_line"),
        F.coalesce(F.col("value") < 80, F.lit(False)).alias("valid"), F.coalesce(F.col("value") < 150, F.lit(False)).alias("exists"),
    )


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return advice.transition_probability(mining.transitions(event_sequence(spark, sf_dir), SESSION, ORDER, noise=MODEL_NOISE))


def a2_state_before(spark, sf_dir):
    return advice.replay(event_log(spark, sf_dir), RULES).select("session_id", "seq", "command", "valid", *RULES.flags, "prev")


def a3_state_warnings(spark, sf_dir):
    replayed = advice.replay(event_log(spark, sf_dir), RULES)
    return replayed.select("session_id", "seq", F.array_join(advice.state_warnings(RULES, F.col("command")), "; ").alias("warnings")).filter("warnings <> ''")


def a5_transition_advice(spark, sf_dir):
    done = advice.transition_advice(advice.replay(event_log(spark, sf_dir), RULES), model(spark, sf_dir))
    return done.select("session_id", "seq", "prev", "command", "rare", "suggestion")


def a7_final_state(spark, sf_dir):
    return advice.final_state(event_log(spark, sf_dir), RULES)


def a8_advise(spark, sf_dir):
    done = advice.advise(event_log(spark, sf_dir), model(spark, sf_dir), RULES)
    return done.withColumns({"warnings": F.array_join("warnings", "; "), "suggestions": F.array_join("suggestions", "; ")})


def long_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with nine of ten users as one session."""
    return event_log(spark, sf_dir).withColumn("session_id", F.when(F.col("session_id") % 10 == 0, F.col("session_id")).otherwise(F.lit(-1)))


def a2_long_state(spark, sf_dir):
    """A2, A4 with a session that no single task replays."""
    return advice.replay(long_log(spark, sf_dir), RULES, split_over=LONG).select("session_id", "seq", "command", "valid", *RULES.flags, "prev")


def a8_long_advise(spark, sf_dir):
    done = advice.advise(long_log(spark, sf_dir), model(spark, sf_dir), RULES, split_over=LONG)
    return done.withColumns({"warnings": F.array_join("warnings", "; "), "suggestions": F.array_join("suggestions", "; ")})


def session_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's command line validated at three levels, then advised on in its session."""
    lines = validation_jobs.lines(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("long"))
    # the log is read twice, to find long sessions and to replay it, and lines should be judged once
    done = materialize(validation_jobs.validated(spark, sf_dir).select("cmd_line", "command", "valid", F.col("command_exists").alias("exists")), "validated")
    log = lines.withColumnRenamed("event_id", "seq").join(done, "cmd_line")
    return advice.advise(log, model(spark, sf_dir), RULES)


def a8_session_advice(spark, sf_dir):
    done = session_advice(spark, sf_dir)
    return done.withColumns({"warnings": F.array_join("warnings", "; "), "suggestions": F.array_join("suggestions", "; ")})


def a8_session_report(spark, sf_dir):
    """V28 at level 4: the report of each event's command line and its session's advice; the model is mined from known commands but one."""
    done = materialize(command_jobs.validated(spark, sf_dir), "validated")
    found = validation.report(done, validation.suggest(done, command_jobs.catalogue(spark)))
    lines = command_jobs.lines(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id")), "event_id").withColumnRenamed("event_id", "seq")
    log = lines.join(done.select("cmd_line", "command", "valid", F.col("command_exists").alias("exists")), "cmd_line")
    prob = advice.transition_probability(mining.transitions(log.filter("exists and command <> 'reset'"), ["session_id"], ["seq"]))
    told = advice.advise(log, prob).join(lines.select("seq", "cmd_line"), "seq").join(found, "cmd_line")
    return told.select("session_id", "seq", advice.advice_report(F.col("report"), F.col("warnings"), F.col("suggestions")).alias("report"))


QUERIES = {f.__name__: f for f in (a2_state_before, a2_long_state, a3_state_warnings, a5_transition_advice, a7_final_state, a8_advise, a8_long_advise, a8_session_advice, a8_session_report)}

_LOG_BODY = """,
e AS (SELECT *, CASE WHEN valid AND command = 'signup' THEN true END AS e1,
             CASE WHEN valid AND command IN ('view', 'click') THEN true WHEN valid AND command = 'error' THEN false END AS e2,
             CASE WHEN valid AND (command = 'purchase' OR command = 'signup' AND contains(lower(cmd_line), '9')) THEN true END AS e3 FROM log)
"""
_LOG = """
WITH log AS (SELECT user_id AS session_id, event_id AS seq, event_type AS command, props AS cmd_line, coalesce(value < 80, false) AS valid, coalesce(value < 150, false) AS "exists" FROM events)
""" + _LOG_BODY
_STATE_BODY = """,
st AS (SELECT session_id, seq, command, valid, "exists", coalesce(last_value(e1 IGNORE NULLS) OVER w, false) AS signed_up, coalesce(last_value(e2 IGNORE NULLS) OVER w, false) AS viewed,
              coalesce(last_value(e3 IGNORE NULLS) OVER w, false) AS bought, last_value(CASE WHEN valid THEN command END IGNORE NULLS) OVER w AS prev
       FROM e WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wa AS (SELECT *, concat_ws('; ', CASE WHEN command = 'purchase' AND NOT viewed THEN 'nothing viewed' END, CASE WHEN command = 'purchase' AND NOT signed_up THEN 'not signed up' END,
              CASE WHEN command = 'error' AND NOT viewed AND NOT bought THEN 'error first' END) AS state_warnings FROM st)
"""
_STATE = _LOG + _STATE_BODY
_ADVICE_BODY = f""",
p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
t AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL AND NOT regexp_matches(a, '{MODEL_NOISE}') AND NOT regexp_matches(b, '{MODEL_NOISE}') GROUP BY 1, 2),
m AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS prob, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM t),
c AS (SELECT a, string_agg(b, ', ' ORDER BY r) AS common FROM m WHERE r <= 3 GROUP BY a),
ad AS (SELECT wa.*, CASE WHEN m.prob < 0.3 THEN '''' || command || ''' after ''' || prev || ''' is rare in typical flows (' || round_even(m.prob * 100, 0)::INT || '%)' END AS rare,
              CASE WHEN m.prob IS NULL AND c.common IS NOT NULL THEN '''' || command || ''' is uncommon after ''' || prev || '''. Common next: ' || c.common END AS suggestion
       FROM wa LEFT JOIN m ON m.a = wa.prev AND m.b = wa.command LEFT JOIN c ON c.a = wa.prev)
"""
_ADVICE = _STATE + _ADVICE_BODY
_LONG_LOG = _LOG.replace("user_id AS session_id", "CASE WHEN user_id % 10 = 0 THEN user_id ELSE -1 END AS session_id")
_VALIDATED = validation_jobs.VALIDATED_SQL + """,
log AS (SELECT session_id::BIGINT AS session_id, event_id AS seq, v3.command, cmd_line, valid, command_exists AS "exists" FROM li JOIN v3 USING (cmd_line))
"""
_ADVISED = """SELECT session_id, seq, command, valid, CASE WHEN "exists" THEN concat_ws('; ', nullif(state_warnings, ''), rare) ELSE '' END AS warnings,
         CASE WHEN "exists" THEN coalesce(suggestion, '') ELSE '' END AS suggestions FROM ad"""
_TOLD = command_jobs.FINDINGS_SQL + """,
log AS (SELECT user_id AS session_id, event_id AS seq, ts, nullif(command, '') AS command, cmd_line, valid, command_exists FROM command_events JOIN ve USING (cmd_line)),
st AS (SELECT *, coalesce(bool_or(valid AND command = 'set_atpg') OVER w, false) AS configured, last_value(CASE WHEN valid THEN command END IGNORE NULLS) OVER w AS prev
       FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT command AS a, lead(command) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM log WHERE command_exists AND command <> 'reset'),
t AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2),
m AS (SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS prob, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM t),
c AS (SELECT a, string_agg(b, ', ' ORDER BY r) AS common FROM m WHERE r <= 3 GROUP BY a),
ad AS (SELECT st.*, CASE WHEN command_exists THEN concat_ws(chr(10), CASE WHEN st.command = 'run_atpg' THEN '  warning L4: No faults defined — coverage may be limited (use add_faults -all)' END,
              CASE WHEN st.command = 'run_atpg' AND NOT configured THEN '  warning L4: ATPG using default settings (no set_atpg detected)' END, CASE WHEN st.command = 'run_atpg' THEN '  warning L4: ATPG model not built — run run_build_model first' END,
              CASE WHEN m.prob < 0.3 THEN '  warning L4: ''' || st.command || ''' after ''' || prev || ''' is rare in typical flows (' || round_even(m.prob * 100, 0)::INT || '%)' END,
              CASE WHEN m.prob IS NULL AND c.common IS NOT NULL THEN '  suggestion L4: ''' || st.command || ''' is uncommon after ''' || prev || '''. Common next: ' || c.common END) END AS told
       FROM st LEFT JOIN m ON m.a = st.prev AND m.b = st.command LEFT JOIN c ON c.a = st.prev)
"""
SQL = {
    "a8_session_advice": _VALIDATED + _LOG_BODY + _STATE_BODY + _ADVICE_BODY + _ADVISED,
    "a2_long_state": _LONG_LOG + _STATE_BODY + "SELECT session_id, seq, command, valid, signed_up, viewed, bought, prev FROM st",
    "a8_long_advise": _LONG_LOG + _STATE_BODY + _ADVICE_BODY + _ADVISED,
    "a8_session_report": _TOLD + "SELECT session_id, seq, concat_ws(chr(10), report, nullif(told, '')) AS report FROM ad JOIN rp USING (cmd_line)",
    "a2_state_before": _STATE + "SELECT session_id, seq, command, valid, signed_up, viewed, bought, prev FROM st",
    "a3_state_warnings": _STATE + "SELECT session_id, seq, state_warnings AS warnings FROM wa WHERE state_warnings <> ''",
    "a5_transition_advice": _ADVICE + "SELECT session_id, seq, prev, command, rare, suggestion FROM ad",
    "a7_final_state": _LOG
    + """SELECT session_id, coalesce(max_by(e1, CASE WHEN e1 IS NOT NULL THEN seq END), false) AS signed_up, coalesce(max_by(e2, CASE WHEN e2 IS NOT NULL THEN seq END), false) AS viewed,
         coalesce(max_by(e3, CASE WHEN e3 IS NOT NULL THEN seq END), false) AS bought, max_by(command, CASE WHEN valid THEN seq END) AS prev FROM e GROUP BY session_id""",
    "a8_advise": _ADVICE + _ADVISED,
}
