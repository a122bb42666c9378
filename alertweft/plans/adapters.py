"""Deterministic views that give the warehouse tables the shapes the operators read.

Each view exists twice: as a DataFrame and as the SQL common table expression
used by the twins.  All arithmetic is on integers so both agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertweft.fixed import ACTIONS, CONDITION_POLICY, CONDITIONS, SEVERITIES, VERDICTS
from alertweft.functions.ordinal import policy_value
from alertweft.functions.text import str_array
from alertweft.session import spread

# line number -> event code of the evidence view
EVIDENCE_CODES = [1, 3, 11, 13, 22, 4624, 4688]
MODELS = ["gemini-2.5-flash", "claude-sonnet-4-6"]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(str_array(values), index.cast("int"))


class Lake:
    """The tables of one folder plus the derived views, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def events(self) -> DataFrame:
        """Canonical events from the event table."""
        return canonical_events(self.table("events"))

    def spread_events(self) -> DataFrame:
        """The same events over all cores, for queries that make or parse a text, or try many rules, per event."""
        return canonical_events(spread(self.table("events"), "event_id"))

    def evidence(self) -> DataFrame:
        """One row per evidence item of a package (case = order)."""
        line = F.col("l_linenumber")
        code = F.get(F.array(*[F.lit(c) for c in EVIDENCE_CODES]), line - 1)
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"),
            line.alias("line_no"),
            F.when(line == 1, "A0").otherwise(F.concat(F.lit("EV-00"), (line - 1).cast("string"))).alias("evidence_id"),
            F.col("l_partkey").cast("string").alias("record_id"),
            F.col("l_shipdate").cast("timestamp").alias("event_time"),
            F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("event_time_utc"),
            code.alias("event_code"),
            F.when(line % 2 == 0, "sysmon").otherwise("security").alias("sensor"),
            F.concat(F.lit("host-"), F.col("l_suppkey").cast("string")).alias("computer"),
            F.concat(F.lit("user-"), (F.col("l_suppkey") % 7).cast("string")).alias("user"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            (line == 1).alias("is_alert"),
            F.create_map(
                F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"),
                F.lit("quantity"), F.col("l_quantity").cast("bigint").cast("string"),
                F.lit("part"), F.col("l_partkey").cast("string"),
            ).alias("attributes"),
        )

    def derivations(self) -> DataFrame:
        return self.table("lineitem").filter("l_linenumber = 2 and l_returnflag = 'R'").select(
            F.col("l_orderkey").alias("case_id"), F.lit("DER-001").alias("derivation_id"),
            F.lit("A0").alias("source_evidence_id"), F.lit("command_line").alias("source_field"),
        ).distinct()

    def declared(self) -> DataFrame:
        """Events each package states to hold; some state one too many."""
        case = F.col("l_orderkey")
        return self.table("lineitem").groupBy(case.alias("case_id")).agg(F.count(F.lit(1)).alias("n")).select(
            "case_id", (F.col("n") + F.when(F.col("case_id") % 43 == 0, 1).otherwise(0)).alias("declared_count"))

    def outputs(self) -> DataFrame:
        """One triage decision per order."""
        k = F.col("o_orderkey")
        rationale = F.concat(
            F.when(k % 5 != 0, F.lit("Alert A0 shows the observed signal.")).otherwise(F.lit("The signal is weak.")),
            F.when(k % 3 == 0, F.concat(F.lit(" Event ev-00"), (k % 6 + 1).cast("string"), F.lit(" adds context.")))
            .otherwise(F.lit("")),
            F.when(k % 17 == 0, F.lit(" The decoded payload is hostile.")).otherwise(F.lit("")),
        )
        return self.table("orders").select(
            k.alias("case_id"),
            _pick(VERDICTS, (7 * k) % 3).alias("verdict"),
            _pick(SEVERITIES, (11 * k) % 5).alias("severity"),
            ((k % 101) / F.lit(100.0)).alias("confidence"),
            F.array(F.lit("A0"), F.concat(F.lit("EV-00"), (k % 8 + 1).cast("string"))).alias("key_evidence"),
            rationale.alias("rationale"),
            _pick(ACTIONS, (13 * k) % 5).alias("action"),
        )

    def truth(self) -> DataFrame:
        """Ground truth per order, consistent with the condition policy."""
        condition = _pick(CONDITIONS, F.col("o_custkey") % 4)
        return self.table("orders").select(
            F.col("o_orderkey").alias("case_id"),
            condition.alias("condition"),
            F.when(condition == "strong", "up_rank").otherwise("down_rank").alias("role"),
            policy_value(condition, 0).alias("expected_verdict"),
            policy_value(condition, 1).alias("severity_band"),
            policy_value(condition, 2).alias("action_band"),
            F.array(F.lit("A0")).alias("supporting"),
            F.when(condition == "strong", F.array().cast("array<string>")).otherwise(F.array(F.lit("EV-001"))).alias("counter"),
            F.lit("1.1").alias("rubric_version"),
        )

    def truth_drafts(self) -> DataFrame:
        """Ground truth with seeded annotation faults, for the audits."""
        k = F.col("case_id")
        return self.truth().select(
            "case_id", "condition",
            F.when(k % 89 == 0, "preserve").otherwise(F.col("role")).alias("role"),
            F.when(k % 83 == 0, "benign").otherwise(F.col("expected_verdict")).alias("expected_verdict"),
            F.when(k % 79 == 0, F.reverse("severity_band")).otherwise(F.col("severity_band")).alias("severity_band"),
            F.when(k % 67 == 0, F.array(F.lit("monitor"))).otherwise(F.col("action_band")).alias("action_band"),
            F.when(k % 61 == 0, F.array().cast("array<string>")).otherwise(F.col("supporting")).alias("supporting"),
            F.when(k % 73 == 0, F.array_append("counter", F.lit("EV-009")))
            .when(k % 71 == 0, F.array_append("counter", F.lit("A0"))).otherwise(F.col("counter")).alias("counter"),
            F.when(k % 97 == 0, "1.0").otherwise(F.lit("1.1")).alias("rubric_version"),
        )

    def runs(self) -> DataFrame:
        """Decisions of two models in three rounds each."""
        cells = F.array(*[
            F.struct(F.lit(m).alias("model"), F.lit(r).alias("round")) for m in MODELS for r in (1, 2, 3)
        ])
        k, o = F.col("case_id"), self.outputs()
        wide = o.select("*", F.explode(cells).alias("cell")).select(
            *o.columns, F.col("cell.model").alias("model"), F.col("cell.round").alias("round")
        )
        shifted_action = _pick(ACTIONS, (13 * k + F.when(k % 7 == 0, F.col("round") - 1).otherwise(0)) % 5)
        shifted_verdict = _pick(
            VERDICTS, (7 * k + F.when((k % 5 == 0) & (F.col("model") == MODELS[1]), 1).otherwise(0)) % 3
        )
        return wide.select(
            "case_id", "model", "round",
            F.when(k % 2 == 0, "dev").otherwise("heldout").alias("split"),
            shifted_verdict.alias("verdict"), "severity", "confidence", "key_evidence", "rationale",
            shifted_action.alias("action"),
        )

    def usage(self) -> DataFrame:
        """Append-only token usage: some cases twice, some missing."""
        k = F.col("case_id")
        base = self.runs().filter(k % 13 != 0)
        seq = F.explode(F.when(k % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        return base.select("case_id", "model", "round", "split", seq.alias("seq")).select(
            "*",
            (500 + k % 900 + F.col("seq") * 3).alias("input_tokens"),
            (50 + k % 300 + F.col("seq")).alias("output_tokens"),
            F.when(k % 3 == 0, "batch").otherwise("realtime").alias("billing_mode"),
            F.concat("model", F.when(F.col("round") > 1, F.concat(F.lit("__A2_round"), F.col("round").cast("string")))
                     .otherwise(F.lit("__A2"))).alias("tag"),
        )


def canonical_events(raw: DataFrame) -> DataFrame:
    """The canonical event shape of an event table, batch or stream."""
    code = (
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 3)
        .when(F.col("event_type") == "error", 4625).when(F.col("event_type") == "signup", 4624).otherwise(5145)
    )
    uid = F.col("user_id")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return raw.select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("record_key"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time_utc"),
        "user_id", "event_type", "value", "props",
        code.alias("event_code"),
        F.when(F.col("event_id") % 2 == 0, "sysmon").otherwise("security").alias("sensor"),
        F.concat(F.lit("host-"), F.lpad((uid % 10).cast("string"), 2, "0")).alias("computer"),
        F.col("event_id").alias("guid"),
        F.floor(F.col("event_id") / 2).alias("parent_guid"),
        k.cast("bigint").alias("k"),
        F.concat(F.lit("user-"), uid.cast("string")).alias("user"),
        F.create_map(
            F.lit("user"), F.concat(F.lit("user-"), uid.cast("string")),
            F.lit("event_type"), F.col("event_type"),
            F.lit("value"), F.col("value").cast("string"),
            F.lit("k"), k,
        ).alias("attributes"),
        F.create_map().cast("map<string,string>").alias("derived"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case_of(condition: str, part: int) -> str:
    arms = []
    for name, policy in CONDITION_POLICY.items():
        value = policy[part]
        arms.append(f"WHEN '{name}' THEN " + (f"'{value}'" if isinstance(value, str) else _sql_list(value)))
    return f"CASE {condition} {' '.join(arms)} END"


_COND = f"{_sql_list(CONDITIONS)}[CAST(o_custkey % 4 + 1 AS INT)]"

# view name -> (SQL body, views it needs)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "ev": ("""
        SELECT event_id, CAST(event_id AS VARCHAR) AS record_key, ts, epoch_us(ts) AS us, user_id, event_type,
               value, props,
               CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4625
                    WHEN 'signup' THEN 4624 ELSE 5145 END AS event_code,
               CASE WHEN event_id % 2 = 0 THEN 'sysmon' ELSE 'security' END AS sensor,
               'host-' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS computer,
               event_id AS guid, event_id // 2 AS parent_guid,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               'user-' || user_id AS user_name,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS time_text
        FROM events""", []),
    "pkg": (f"""
        SELECT l_orderkey AS case_id, l_linenumber AS line_no,
               CASE WHEN l_linenumber = 1 THEN 'A0' ELSE 'EV-00' || (l_linenumber - 1) END AS evidence_id,
               CAST(l_partkey AS VARCHAR) AS record_id, l_shipdate AS event_time,
               strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS event_time_utc,
               {EVIDENCE_CODES}[l_linenumber] AS event_code,
               CASE WHEN l_linenumber % 2 = 0 THEN 'sysmon' ELSE 'security' END AS sensor,
               'host-' || l_suppkey AS computer, 'user-' || (l_suppkey % 7) AS user_name,
               l_returnflag AS flag, l_linestatus AS status, l_linenumber = 1 AS is_alert, CAST(l_quantity AS BIGINT) AS quantity,
               CAST(l_partkey AS VARCHAR) AS part
        FROM lineitem""", []),
    "der": ("""
        SELECT DISTINCT l_orderkey AS case_id, 'DER-001' AS derivation_id, 'A0' AS source_evidence_id
        FROM lineitem WHERE l_linenumber = 2 AND l_returnflag = 'R'""", []),
    "o": (f"""
        SELECT o_orderkey AS case_id,
               {_sql_list(VERDICTS)}[(7 * o_orderkey) % 3 + 1] AS verdict,
               {_sql_list(SEVERITIES)}[(11 * o_orderkey) % 5 + 1] AS severity,
               (o_orderkey % 101) / 100.0::DOUBLE AS confidence,
               ['A0', 'EV-00' || (o_orderkey % 8 + 1)] AS key_evidence,
               (CASE WHEN o_orderkey % 5 <> 0 THEN 'Alert A0 shows the observed signal.' ELSE 'The signal is weak.' END)
               || (CASE WHEN o_orderkey % 3 = 0 THEN ' Event ev-00' || (o_orderkey % 6 + 1) || ' adds context.' ELSE '' END)
               || (CASE WHEN o_orderkey % 17 = 0 THEN ' The decoded payload is hostile.' ELSE '' END) AS rationale,
               {_sql_list(ACTIONS)}[(13 * o_orderkey) % 5 + 1] AS action
        FROM orders""", []),
    "gt": (f"""
        SELECT o_orderkey AS case_id, {_COND} AS condition,
               CASE WHEN {_COND} = 'strong' THEN 'up_rank' ELSE 'down_rank' END AS role,
               {_case_of(_COND, 0)} AS expected_verdict, {_case_of(_COND, 1)} AS severity_band,
               {_case_of(_COND, 2)} AS action_band, ['A0'] AS supporting,
               CASE WHEN {_COND} = 'strong' THEN [] ELSE ['EV-001'] END AS counter, '1.1' AS rubric_version
        FROM orders""", []),
    "gtd": ("""
        SELECT case_id, condition,
               CASE WHEN case_id % 89 = 0 THEN 'preserve' ELSE role END AS role,
               CASE WHEN case_id % 83 = 0 THEN 'benign' ELSE expected_verdict END AS expected_verdict,
               CASE WHEN case_id % 79 = 0 THEN list_reverse(severity_band) ELSE severity_band END AS severity_band,
               CASE WHEN case_id % 67 = 0 THEN ['monitor'] ELSE action_band END AS action_band,
               CASE WHEN case_id % 61 = 0 THEN CAST([] AS VARCHAR[]) ELSE supporting END AS supporting,
               CASE WHEN case_id % 73 = 0 THEN list_append(counter, 'EV-009')
                    WHEN case_id % 71 = 0 THEN list_append(counter, 'A0') ELSE counter END AS counter,
               CASE WHEN case_id % 97 = 0 THEN '1.0' ELSE '1.1' END AS rubric_version
        FROM gt""", ["gt"]),
    "run": (f"""
        SELECT o.case_id, m.model, r.round, CASE WHEN o.case_id % 2 = 0 THEN 'dev' ELSE 'heldout' END AS split,
               {_sql_list(VERDICTS)}[(7 * o.case_id + CASE WHEN o.case_id % 5 = 0 AND m.model = '{MODELS[1]}'
                    THEN 1 ELSE 0 END) % 3 + 1] AS verdict,
               o.severity, o.confidence, o.key_evidence, o.rationale,
               {_sql_list(ACTIONS)}[(13 * o.case_id + CASE WHEN o.case_id % 7 = 0 THEN r.round - 1 ELSE 0 END) % 5 + 1]
                    AS action
        FROM o, (VALUES ('{MODELS[0]}'), ('{MODELS[1]}')) m(model), (VALUES (1), (2), (3)) r(round)""", ["o"]),
    "usage": ("""
        SELECT run.case_id, run.model, run.round, run.split, s.seq,
               500 + run.case_id % 900 + s.seq * 3 AS input_tokens, 50 + run.case_id % 300 + s.seq AS output_tokens,
               CASE WHEN run.case_id % 3 = 0 THEN 'batch' ELSE 'realtime' END AS billing_mode,
               model || CASE WHEN round > 1 THEN '__A2_round' || round ELSE '__A2' END AS tag
        FROM run, (VALUES (1), (2)) s(seq)
        WHERE run.case_id % 13 <> 0 AND (s.seq = 1 OR run.case_id % 11 = 0)""", ["run"]),
}


def add_view(name: str, body: str, needs: str = "") -> None:
    """Make a further SQL view available to twins."""
    VIEWS[name] = (body, needs.split())


def with_views(names: list[str], body: str) -> str:
    """Prefix a twin with the views it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name):
        for need in VIEWS[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][0]})" for name in ordered)
    text = body.lstrip()
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes},\n{text[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"
