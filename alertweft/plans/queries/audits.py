"""CHK-29..33/35/36 and INT: audits and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.fixed import FORBIDDEN_PATTERNS
from alertweft.functions.ordinal import policy_value
from alertweft.functions.stats import count_where
from alertweft.functions.text import labels
from alertweft.operators import audits as A, case_gate as CG, gate as G, integrity as I, packages as K, scoring as S
from alertweft.operators.redaction import has_any
from alertweft.plans.adapters import _case_of, add_view
from alertweft.plans.queries.rounds import RUN_KEYS
from alertweft.plans.registry import query
from alertweft.plans.rule_library import taxonomy_rows
from alertweft.session import scratch_path


def case_configs(lake):
    """Case configuration with seeded inconsistencies, one row per order."""
    k = F.col("case_id")
    return lake.truth_drafts().select(
        "case_id", F.when(k % 59 == 0, k + 1).otherwise(k).alias("config_case_id"), "condition",
        F.when(k % 53 == 0, "weak").otherwise(F.col("condition")).alias("folder"), F.when(k % 2 == 0, "dev").otherwise("heldout").alias("split"),
        F.when(k % 47 == 0, "dev").otherwise(F.when(k % 2 == 0, "dev").otherwise("heldout")).alias("config_split"),
        F.when(k % 43 == 0, 3).otherwise(1 + k % 2).alias("tier"), (k % 41 != 0).alias("has_proposition"), (k % 37 == 0).alias("no_absence_audit"),
        "supporting", "counter", "severity_band", "expected_verdict", "role")


add_view("cc", """SELECT case_id, CASE WHEN case_id % 59 = 0 THEN case_id + 1 ELSE case_id END AS config_case_id, condition, CASE WHEN case_id % 53 = 0 THEN 'weak' ELSE condition END AS folder,
    CASE WHEN case_id % 2 = 0 THEN 'dev' ELSE 'heldout' END AS split, CASE WHEN case_id % 47 = 0 OR case_id % 2 = 0 THEN 'dev' ELSE 'heldout' END AS config_split,
    CASE WHEN case_id % 43 = 0 THEN 3 ELSE 1 + case_id % 2 END AS tier, case_id % 41 <> 0 AS has_proposition, case_id % 37 = 0 AS no_absence_audit, supporting, counter, severity_band, expected_verdict, role FROM gtd""", "gtd")


@query("chk_29", "cc valid", """
    SELECT case_id, concat_ws('|', CASE WHEN config_case_id <> case_id THEN 'case_id' END, CASE WHEN config_split <> split THEN 'split' END, CASE WHEN folder <> condition THEN 'directory' END,
        CASE WHEN tier NOT IN (1, 2) THEN 'tier' END, CASE WHEN NOT has_proposition THEN 'proposition' END,
        CASE WHEN len(list_filter(supporting || counter, lambda x: NOT list_contains(coalesce(ids, []), x))) > 0 THEN 'unmapped_ids' END) AS errors FROM cc LEFT JOIN valid USING (case_id)""")
def chk_29(lake):
    configs = case_configs(lake)
    ids = S.known_ids(lake.evidence(), lake.derivations())
    named = configs.select("case_id", F.explode(F.array_union("supporting", "counter")).alias("evidence_id"))
    unmapped = named.join(ids, ["case_id", "evidence_id"], "left_anti").select("case_id").distinct().withColumn("unmapped", F.lit(True))
    checked = configs.join(unmapped, "case_id", "left")
    return checked.select("case_id", F.array_join(labels([
        (F.col("config_case_id") != F.col("case_id"), "case_id"), (F.col("config_split") != F.col("split"), "split"), (F.col("folder") != F.col("condition"), "directory"),
        (~F.col("tier").isin(1, 2), "tier"), (~F.col("has_proposition"), "proposition"), (F.col("unmapped"), "unmapped_ids")]), "|").alias("errors"))


add_view("xp", """SELECT event_id, user_id, CASE WHEN event_id % 400 = 7 THEN 0 ELSE event_id END AS record_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_last, k FROM ev""", "ev")


@query("chk_30", "xp", """
    SELECT event_id, concat_ws('|', CASE WHEN (k % 20 = 3) <> false THEN 'wrapper_keys' END, CASE WHEN k = 4 THEN 'preview' END, CASE WHEN is_last AND user_id % 10 = 0 THEN 'lastrow' END,
        CASE WHEN k = 5 THEN 'required_fields' END, CASE WHEN count(*) OVER (PARTITION BY user_id, record_id) > 1 THEN 'duplicate' END) AS errors FROM xp""")
def chk_30(lake):
    """Export rows per file (user): wrapper keys, preview, last-row flag, required fields, duplicates."""
    ev = lake.events()
    last = ev.groupBy("user_id").agg(F.max("event_id").alias("m"))
    k, is_last = F.col("k"), F.col("event_id") == F.col("m")
    keys = F.when(is_last, F.array(F.lit("preview"), F.lit("result"), F.lit("lastrow"))).otherwise(F.array(F.lit("preview"), F.lit("result")))
    rows = ev.join(last, "user_id").select(
        "event_id", "user_id", F.when(F.col("event_id") % 400 == 7, 0).otherwise(F.col("event_id")).alias("record_id"),
        F.when(k % 20 == 3, F.array_append(keys, F.lit("extra"))).otherwise(keys).alias("wrapper_keys"), (k == 4).alias("preview"),
        (is_last & (F.col("user_id") % 10 != 0)).alias("lastrow"), F.when(k == 5, 1).otherwise(0).alias("missing_fields"))
    return A.last_row_faults(rows, ["user_id"], "event_id").select("event_id", F.array_join("errors", "|").alias("errors"))


@query("chk_31", "cc", f"""
    SELECT case_id, concat_ws('|', CASE WHEN folder <> condition THEN 'folder' END, CASE WHEN expected_verdict <> {_case_of('condition', 0)} THEN 'verdict' END,
        CASE WHEN list_sort(severity_band) <> list_sort({_case_of('condition', 1)}) THEN 'severity_band' END, CASE WHEN NOT list_contains({_case_of('condition', 3)}, role) THEN 'role' END,
        CASE WHEN condition = 'missing' AND no_absence_audit THEN 'absence_audit' END, CASE WHEN condition = 'counter' AND len(counter) = 0 THEN 'counter_ids' END) AS errors FROM cc""")
def chk_31(lake):
    c = F.col("condition")
    return case_configs(lake).select("case_id", F.array_join(labels([
        (F.col("folder") != c, "folder"), (F.col("expected_verdict") != policy_value(c, 0), "verdict"),
        (F.array_sort("severity_band") != F.array_sort(policy_value(c, 1)), "severity_band"), (~F.array_contains(policy_value(c, 3), F.col("role")), "role"),
        ((c == "missing") & F.col("no_absence_audit"), "absence_audit"), ((c == "counter") & (F.size("counter") == 0), "counter_ids")]), "|").alias("errors"))


@query("chk_32", "facts gtd o", f"""
    SELECT case_id, concat_ws('|', CASE WHEN dup > 0 THEN 'duplicate_ids' END, CASE WHEN main_id IS DISTINCT FROM 'A0' THEN 'main_id' END,
        CASE WHEN regexp_matches(rationale, '(?i)\\b(?:weak|strong)\\b') THEN 'leak' END,
        CASE WHEN action_band <> {_case_of('condition', 2)} OR expected_verdict <> {_case_of('condition', 0)} THEN 'decision_band' END) AS errors
    FROM facts JOIN gtd USING (case_id) JOIN o USING (case_id)""")
def chk_32(lake):
    """QA gate of built cases: package facts, leakage of decision labels, decision band."""
    facts = G.package_facts(lake.evidence(), lake.derivations())
    truth = lake.truth_drafts().select("case_id", "condition", "expected_verdict", "action_band")
    c = F.col("condition")
    joined = facts.join(truth, "case_id").join(lake.outputs().select("case_id", "rationale"), "case_id")
    return joined.select("case_id", F.array_join(labels([
        (F.col("duplicate_ids") > 0, "duplicate_ids"), (~F.col("main_id").eqNullSafe("A0"), "main_id"),
        (has_any(F.col("rationale"), [FORBIDDEN_PATTERNS["decision label"]]), "leak"),
        ((F.col("action_band") != policy_value(c, 2)) | (F.col("expected_verdict") != policy_value(c, 0)), "decision_band")]), "|").alias("errors"))


@query("chk_33", "run", """SELECT case_id, model, round, concat_ws('|', CASE WHEN case_id % 61 = 0 THEN 'temperature' END, CASE WHEN case_id % 67 = 0 THEN 'max_tokens' END) AS drift
    FROM run WHERE case_id % 61 = 0 OR case_id % 67 = 0""")
def chk_33(lake):
    k = F.col("case_id")
    requested = lake.runs().select(*RUN_KEYS, F.when(k % 61 == 0, 0.7).otherwise(0.0).alias("temperature"), F.when(k % 67 == 0, F.lit(None).cast("int")).otherwise(2048).alias("max_tokens"))
    return A.contract_drift(requested, {"temperature": 0.0, "max_tokens": 2048}).select(*RUN_KEYS, F.array_join("drift", "|").alias("drift"))


@query("chk_35", "o", """SELECT case_id, CASE WHEN case_id % 13 = 0 THEN 'missing' ELSE 'duplicate' END AS problem FROM o WHERE case_id % 13 = 0 OR case_id % 11 = 0
    UNION ALL SELECT case_id + 100000000, 'extra' FROM o WHERE case_id % 700 = 0""")
def chk_35(lake):
    usage = lake.usage().filter("round = 1 and model like 'gemini%'").select("case_id")
    stray = lake.outputs().filter("case_id % 700 = 0").select((F.col("case_id") + 100000000).alias("case_id"))
    return A.id_completeness(lake.outputs(), usage.unionByName(stray), "case_id")


@query("chk_35_cells", "run", """SELECT case_id, model, round, CASE WHEN case_id % 13 = 0 OR (case_id + round) % 17 = 0 THEN 'missing' ELSE 'duplicate' END AS problem FROM run
    WHERE case_id % 13 = 0 OR (case_id + round) % 17 = 0 OR case_id % 11 = 0
    UNION ALL SELECT case_id + 100000000, model, round, 'extra' FROM run WHERE (case_id + round) % 700 = 0""")
def chk_35_cells(lake):
    """Usage ids of every model and round against the decisions; rounds lack and add others."""
    usage = lake.usage().filter("(case_id + round) % 17 <> 0").select(*RUN_KEYS)
    stray = lake.runs().filter("(case_id + round) % 700 = 0").select((F.col("case_id") + 100000000).alias("case_id"), "model", "round")
    return A.id_completeness(lake.runs(), usage.unionByName(stray), ["case_id", "model", "round"])


_CLASSES = taxonomy_rows()
_LEAKS = {101: " T1059.001", 103: " wazuh", 107: " attack_step_3", 109: " Caldera", 113: " tainox3aedeeSh"}


@query("chk_32_gate", "pkg der o gt gtd", f"""
    WITH e AS (SELECT case_id, evidence_id AS id, count(*) AS n, bool_or(case_id % 37 = 0 AND line_no = 2) AS named FROM pkg GROUP BY 1, 2),
    h AS (SELECT case_id, id FROM e UNION ALL SELECT case_id, derivation_id FROM der),
    f AS (SELECT case_id, sum(n) AS n_events, bool_or(n > 1) AS repeated, bool_or(named) AS named, bool_or(id = 'A0') AS alert FROM e GROUP BY 1),
    u AS (SELECT DISTINCT case_id FROM (SELECT case_id, unnest(list_concat(supporting, counter)) AS id FROM gt) c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.case_id = c.case_id AND h.id = c.id)),
    p AS (SELECT case_id, rationale || {" || ".join(f"CASE WHEN case_id % {n} = 0 THEN '{w}' ELSE '' END" for n, w in _LEAKS.items())} AS text FROM o)
    SELECT case_id, CASE WHEN case_id % 97 = 0 THEN 'incomplete' ELSE concat_ws('|', CASE WHEN case_id % 59 = 0 THEN 'taxonomy' END, CASE WHEN case_id % 61 = 0 THEN 'timing' END,
        CASE WHEN case_id % 47 = 0 THEN 'trigger not passed' END, CASE WHEN case_id % 31 = 0 THEN 'selected event' END, CASE WHEN case_id % 127 = 0 THEN 'audited family' END,
        CASE WHEN case_id % 53 = 0 THEN 'audited pattern' END, CASE WHEN case_id % 67 = 0 THEN 'runbook' END, CASE WHEN case_id % 71 = 0 THEN 'no source' END,
        CASE WHEN case_id % 71 <> 0 AND case_id % 73 = 0 THEN 'source absent' END, CASE WHEN case_id % 71 <> 0 AND case_id % 73 <> 0 AND case_id % 79 = 0 THEN 'source hash' END,
        {", ".join(f"CASE WHEN regexp_matches(text, '(?i){pattern}') THEN 'leaked {name}' END" for name, pattern in FORBIDDEN_PATTERNS.items())},
        CASE WHEN case_id % 89 = 0 THEN 'case ids' END, CASE WHEN repeated THEN 'repeated id' END, CASE WHEN u.case_id IS NOT NULL THEN 'unknown id' END,
        CASE WHEN n_events IS NULL OR case_id % 43 = 0 THEN 'event count' END, CASE WHEN named THEN 'record id' END,
        CASE WHEN expected_verdict <> {_case_of('condition', 0)} OR severity_band <> {_case_of('condition', 1)} OR action_band <> {_case_of('condition', 2)} THEN 'decision band' END,
        CASE WHEN case_id % 41 = 0 AND alert THEN 'provenance ids' END) END AS faults
    FROM p JOIN gtd USING (case_id) LEFT JOIN f USING (case_id) LEFT JOIN u USING (case_id)""")
def chk_32_gate(lake):
    """The gate of built cases with a seeded fault of every kind."""
    k = F.col("case_id")
    seeded = lambda every, fault, sound: F.when(k % every == 0, fault).otherwise(sound)
    place = (k % len(_CLASSES)).cast("int")
    part = lambda i: F.get(F.array(*[F.lit(c[i]) for c in _CLASSES]), place)
    null, text, key = F.lit(None).cast("string"), F.col("rationale"), F.concat(F.lit("s"), k.cast("string"))
    for every, word in _LEAKS.items():
        text = F.concat(text, F.when(k % every == 0, word).otherwise(""))
    truth = lake.truth_drafts().select("case_id", "condition", F.col("expected_verdict").alias("verdict"), "severity_band", "action_band")
    source, pattern = F.sha2(key, 256), seeded(59, F.lit("no-such-pattern"), part(1))
    cases = lake.outputs().select("case_id", "rationale").join(truth, "case_id").join(lake.declared(), "case_id", "left").select(
        "case_id", seeded(89, k + 1, k).alias("truth_case_id"), k.alias("selection_case_id"), k.alias("provenance_case_id"), (k % 97 != 0).alias("documents_complete"),
        seeded(61, F.lit("after"), F.lit(CG.TIMING)).alias("timing"), (k % 47 != 0).alias("trigger_passed"), key.alias("selected_key"), seeded(31, null, key).alias("expected_key"),
        part(2).alias("rule_case"), part(0).alias("family"), pattern.alias("pattern"), seeded(127, null, part(0)).alias("audit_family"), seeded(53, F.lit("other"), pattern).alias("audit_pattern"),
        seeded(67, F.lit("see the notes"), F.lit(f"The rule is in {CG.RULE_FILE}.")).alias("runbook"), seeded(71, null, source).alias("source_sha256"),
        seeded(73, null, seeded(79, F.sha2(F.lit("changed"), 256), source)).alias("actual_sha256"), text.alias("package_text"), F.col("declared_count").alias("event_count"),
        "condition", "verdict", "severity_band", "action_band")
    evidence, neutral = lake.evidence(), F.concat(F.lit("SRC-"), F.col("evidence_id"))
    row = lambda df, kind, name, record=null: df.select("case_id", F.lit(kind).alias("kind"), F.col(name).alias("id"), record.alias("record_id"))
    cited = lake.truth().select("case_id", F.explode(F.concat("supporting", "counter")).alias("id"))
    ids = row(evidence, CG.EVENT, "evidence_id", F.when((k % 37 == 0) & (F.col("line_no") == 2), "4711").otherwise(neutral)).unionByName(
        row(lake.derivations(), CG.DERIVATION, "derivation_id")).unionByName(row(cited, CG.CITED, "id")).unionByName(
        row(evidence.filter("not (case_id % 41 = 0 and evidence_id = 'A0')"), CG.TRACED, "evidence_id"))
    return CG.case_faults(cases, ids, taxonomy_rows()).select("case_id", F.array_join("faults", "|").alias("faults"))


def listing(lake):
    """File listing of the case folders; some folders lack or hold too much."""
    k = F.col("case_id")
    files = F.array_compact(F.array(
        F.lit("build/case.json"), F.when(k % 23 != 0, F.lit("model_input/alert_package.json")), F.when(k % 29 != 0, F.lit("annotations/ground_truth.json")),
        F.lit("source/provenance.json"), F.when(k % 31 == 0, F.lit("queries/old.md"))))
    return lake.outputs().select("case_id", F.explode(files).alias("file"))


@query("chk_36", "o", """SELECT case_id, concat_ws('|', CASE WHEN case_id % 23 = 0 THEN 'MISSING model_input/alert_package.json' END, CASE WHEN case_id % 29 = 0 THEN 'MISSING annotations/ground_truth.json' END,
    CASE WHEN case_id % 31 = 0 THEN 'UNEXPECTED queries/old.md' END) AS faults FROM o WHERE case_id % 23 = 0 OR case_id % 29 = 0 OR case_id % 31 = 0""")
def chk_36(lake):
    expected = ["build/case.json", "model_input/alert_package.json", "annotations/ground_truth.json", "source/provenance.json"]
    return A.structure_faults(listing(lake), expected, ["queries/old.md"]).select("case_id", F.array_join("faults", "|").alias("faults"))


def written_tree(lake):
    """A folder tree with one file set per top-level category."""
    root = scratch_path(lake.spark, "tree")
    lake.outputs().select("case_id", "rationale").write.json(f"{root}/tier1/a")
    lake.events().select("props").write.text(f"{root}/eval/outputs/m")
    lake.table("nation").write.csv(f"{root}/rubric/n")
    return root


@query("int_01")
def int_01(lake):
    """Manifest of files written from the tables."""
    rows = I.manifest(lake.spark, written_tree(lake)).filter("not path like '%_SUCCESS' and not path like '%.crc'")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), count_where(F.length("sha256") == 64).alias("hashed"))


@query("int_02", sql="""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 17 = 0 THEN 'MISSING' WHEN o_orderkey % 19 = 0 THEN 'NEW' WHEN o_orderkey % 23 = 0 THEN 'MODIFIED' ELSE 'SAME' END AS status FROM orders""")
def int_02(lake):
    k = F.col("o_orderkey")
    rows = lake.table("orders").select(k.alias("case_id"), I.row_digest(k, F.col("o_custkey"), F.col("o_orderstatus")).alias("sha256"))
    c = F.col("case_id")
    old = rows.filter((c % 17 == 0) | (c % 19 != 0))
    new = rows.filter(c % 17 != 0).withColumn("sha256", F.when(c % 23 == 0, "changed").otherwise(F.col("sha256")))
    return I.reconcile(old, new, "case_id", "sha256")


@query("int_03", "pkg", "SELECT evidence_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN case_id % 21 = 0 AND evidence_id = 'A0' THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM pkg GROUP BY evidence_id")
def int_03(lake):
    """Packages rebuilt through a JSON round trip against those built from the table; seeded changes must be found."""
    path = scratch_path(lake.spark, "rebuild")
    columns = ["case_id", "evidence_id", "record_id", "event_time_utc", "computer", "flag"]
    direct = lake.evidence().select(*columns)
    drift = (F.col("case_id") % 21 == 0) & (F.col("evidence_id") == "A0")
    direct.withColumn("computer", F.when(drift, "host-x").otherwise(F.col("computer"))).write.json(path)
    again = lake.spark.read.schema(direct.schema).json(path)
    gone = I.difference(direct, again).filter("excess > 0").groupBy("evidence_id").agg(F.sum("excess").alias("c"))
    total = direct.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("rows"))
    return total.join(gone, "evidence_id", "left").select("evidence_id", "rows", F.coalesce("c", F.lit(0)).cast("bigint").alias("changed"))


@query("int_04", sql="""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 14 = 0 THEN 'missing' WHEN o_orderkey % 15 = 0 THEN 'unreferenced' ELSE 'staged' END AS status FROM orders""")
def int_04(lake):
    """Provenance rows against staged files by name and hash."""
    k = F.col("o_orderkey")
    rows = lake.table("orders").select(k.alias("case_id"), F.concat(F.lit("log-"), k.cast("string")).alias("name"), I.row_digest(k).alias("sha256"))
    c = F.col("case_id")
    declared = rows.filter((c % 14 == 0) | (c % 15 != 0)).withColumn("p", F.lit(True))
    staged = rows.filter(c % 14 != 0).withColumn("f", F.lit(True))
    both = declared.join(staged, ["case_id", "name", "sha256"], "full_outer")
    return both.select("case_id", F.when(F.col("f").isNull(), "missing").when(F.col("p").isNull(), "unreferenced").otherwise("staged").alias("status"))


@query("int_05", sql="""
    WITH r AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS h, o_orderkey || '|' || sha256(CAST(o_orderkey AS VARCHAR)) AS leaf FROM orders),
    l4 AS (SELECT left(h, 4) AS g, count(*) AS n, sha256('cfg-1' || string_agg(leaf, chr(10) ORDER BY leaf)) AS d FROM r GROUP BY 1),
    l3 AS (SELECT left(g, 3) AS g, sum(n) AS n, sha256('cfg-1' || string_agg(d, chr(10) ORDER BY d)) AS d FROM l4 GROUP BY 1),
    l2 AS (SELECT left(g, 2) AS g, sum(n) AS n, sha256('cfg-1' || string_agg(d, chr(10) ORDER BY d)) AS d FROM l3 GROUP BY 1),
    l1 AS (SELECT left(g, 1) AS g, sum(n) AS n, sha256('cfg-1' || string_agg(d, chr(10) ORDER BY d)) AS d FROM l2 GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256('cfg-1' || string_agg(d, chr(10) ORDER BY d)) AS digest FROM l1""")
def int_05(lake):
    """Composite digest over all (case, hash) pairs and the configuration, as a hash tree."""
    k = F.col("o_orderkey")
    return I.set_digest(lake.table("orders").select(k.alias("case_id"), I.row_digest(k).alias("sha256")), "case_id", "sha256", "cfg-1")


@query("int_06", sql="""SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 9 <> 0 THEN 'present' WHEN o_orderpriority LIKE '1%' THEN 'required_missing' ELSE 'allowed_missing' END AS status FROM orders""")
def int_06(lake):
    orders = lake.table("orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.startswith("o_orderpriority", F.lit("1")), "required").otherwise("cache").alias("retention"))
    cached = orders.filter("case_id % 9 <> 0").select("case_id", F.lit(True).alias("here"))
    return orders.join(cached, "case_id", "left").select("case_id", F.when(F.col("here"), "present").when(F.col("retention") == "required", "required_missing").otherwise("allowed_missing").alias("status"))


@query("chk_34_documents", "pkg", "SELECT CAST(count(DISTINCT case_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS items FROM pkg")
def chk_34_documents(lake):
    """Re-ordering evidence leaves the published documents' content unchanged: items are counted from the sink form."""
    docs = K.documents(lake.evidence(), lake.derivations())
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("event_count").alias("items"))
