"""RED, SCL-06..16, UDF: redaction, pseudonyms, leak scans, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertweft.fixed import CASE_LEAK_PATTERN, FORBIDDEN_PATTERNS, FRAMEWORK_PATTERN, LEAK_PATTERN, TECHNIQUE_PATTERN
from alertweft.functions import codec as C
from alertweft.functions.text import joined
from alertweft.operators import aliases as A, redaction as X
from alertweft.operators.scoring import over_assertion
from alertweft.plans.queries.scoring import _over_sql
from alertweft.plans.registry import query

SEED = " See t1059.001 of Atomic-Red-Team, pw At0micStrong, PurpleSharp."


def seeded(lake, every=3):
    """Documents, every few with a sentence that must be redacted."""
    return lake.table("documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % every == 0, SEED).otherwise("")))


_SEEDED = f"(SELECT * REPLACE (text || CASE WHEN doc_id % 3 = 0 THEN '{SEED}' ELSE '' END AS text) FROM documents)"


@query("red_01", sql=rf"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{TECHNIQUE_PATTERN}', '[id]', 'gi'), 'at0micstrong', '[redacted-password]', 'gi'),
           '{FRAMEWORK_PATTERN}', '[x]', 'gi')) AS digest FROM {_SEEDED}""")
def red_01(lake):
    return seeded(lake).select("doc_id", F.md5(X.redact_tokens(F.col("text"))).alias("digest"))


def b64_utf16(text):
    return C.base64_text(F.encode(text, "UTF-16LE"))


@query("red_02", sql="""
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Import-Module [x]; Invoke-[x]Test [id] #' || conv_id WHEN 1 THEN 'Get-Date # nothing here' ELSE '' END AS decoded,
           turn % 3 <> 1 OR true AS kept, CASE turn % 3 WHEN 0 THEN 'run [x] ' WHEN 1 THEN 'run [x] ' ELSE 'run [x] plain' END AS outside FROM conversations""")
def red_02(lake):
    """Encoded arguments are decoded, redacted and re-encoded; clean blobs keep their bytes."""
    t = F.col("turn") % 3
    blob = b64_utf16(F.when(t == 0, F.concat(F.lit("Import-Module AtomicRedTeam; Invoke-AtomicTest T1059 #"), F.col("conv_id").cast("string"))).otherwise("Get-Date # nothing here"))
    command = F.when(t == 2, F.lit("run Atomic plain")).otherwise(F.concat(F.lit("run Atomic -enc "), blob))
    rows = lake.table("conversations").select("conv_id", "turn", blob.alias("blob"), t.alias("t"), X.redact(command).alias("clean"))
    return rows.select("conv_id", "turn", C.encoded_command(F.col("clean")).alias("decoded"),
                       ((F.col("t") != 1) | F.contains("clean", F.col("blob"))).alias("kept"),
                       F.regexp_replace("clean", "-enc .*", "").alias("outside"))


@query("red_03", "pkg", "SELECT case_id, evidence_id, record_id, flag || ' [id]' AS flag, 'n [x]' AS note FROM pkg")
def red_03(lake):
    attributes = F.create_map(
        F.lit("flag"), F.concat(F.col("attributes")["flag"], F.lit(" T1021.002")), F.lit("note"), F.lit("n atomics"))
    rows = lake.evidence().select("case_id", "evidence_id", "record_id", X.redact_map(attributes).alias("a"))
    return rows.select("case_id", "evidence_id", "record_id", F.col("a")["flag"].alias("flag"), F.col("a")["note"].alias("note"))


LITERALS = {"the": "[a]", "[a]": "[b]", "no-such-literal": "?"}


@query("red_04", sql="SELECT doc_id, md5(replace(replace(text, 'the', '[a]'), '[a]', '[b]')) AS digest FROM documents")
def red_04(lake):
    return X.replace_literals(lake.table("documents"), "text", LITERALS).select("doc_id", F.md5("redacted").alias("digest"))


@query("red_04_counts", sql="""
    SELECT 'the' AS literal, CAST(sum((length(text) - length(replace(text, 'the', ''))) // 3) AS BIGINT) AS occurrences FROM documents
    UNION ALL SELECT '[a]', CAST(sum((length(replace(text, 'the', '[a]')) - length(replace(replace(text, 'the', '[a]'), '[a]', ''))) // 3) AS BIGINT) FROM documents
    UNION ALL SELECT 'no-such-literal', CAST(0 AS BIGINT)""")
def red_04_counts(lake):
    """Occurrences per literal over all documents; zero marks configuration drift."""
    return X.unmatched_literals(X.replace_literals(lake.table("documents"), "text", LITERALS), LITERALS)


def host_rows(lake):
    """(case, host) rows: a case is a day, hosts have domains of differing depth."""
    host = F.concat(F.lit("Workstation-Range-0"), (F.col("user_id") % 7).cast("string"), F.when(F.col("user_id") % 3 == 0, ".corp.example.org").otherwise(""))
    return lake.events().select(F.date_format("event_time", "yyyy-MM-dd").alias("day"), host.alias("host"), "user_id")


@query("red_05", "ev", """
    WITH h AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 'Workstation-Range-0' || user_id % 7 || CASE WHEN user_id % 3 = 0 THEN '.corp.example.org' ELSE '' END AS host FROM ev),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY host) AS rn, split_part(host, '.', 1) AS short, contains(host, '.') AS dom FROM h),
    f AS (SELECT day, lower(host) AS alias, format('host-{:02d}', rn) || CASE WHEN dom THEN '.corp.local' ELSE '' END AS pseudonym, rn * 10 + 1 AS pri FROM r
      UNION ALL SELECT day, lower(short), format('host-{:02d}', rn), rn * 10 + 2 FROM r
      UNION ALL SELECT day, lower(rtrim(left(short, 15), '-_.')), format('host-{:02d}', rn), -rn FROM r
      UNION ALL SELECT day, 'corp.example.org', 'corp.local', rn * 10 + 4 FROM r WHERE dom UNION ALL SELECT day, 'corp', 'corp', rn * 10 + 5 FROM r WHERE dom)
    SELECT day, alias, max_by(pseudonym, pri) AS pseudonym FROM f GROUP BY day, alias""")
def red_05(lake):
    return X.host_pseudonyms(host_rows(lake), "day", "host")


def account_rows(lake):
    u = F.col("user_id")
    name = (F.when(u % 11 == 0, "NT AUTHORITY\\SYSTEM").when(u % 13 == 0, "host-3$").when(u % 5 == 0, F.concat(F.lit("CORP\\U"), u.cast("string"), F.lit("$")))
            .otherwise(F.concat(F.lit("corp\\u"), u.cast("string"))))
    return lake.events().select(F.date_format("event_time", "yyyy-MM-dd").alias("day"), name.alias("account"))


@query("red_06", "ev", """
    WITH n AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN user_id % 5 = 0 THEN 'U' || user_id ELSE 'u' || user_id END AS name
               FROM ev WHERE user_id % 11 <> 0 AND user_id % 13 <> 0)
    SELECT day, lower(name) AS alias, format('user-{:02d}', row_number() OVER (PARTITION BY day ORDER BY name)) AS pseudonym FROM n""")
def red_06(lake):
    return X.user_pseudonyms(account_rows(lake), "day", "account")


@query("red_07", sql="SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'tion', '1', 'gi'), 'the', '2', 'gi')) AS digest FROM documents")
def red_07(lake):
    """One-pass replacement with the aliases of each language; with keys that cannot interfere it equals the nested replaces of the twin."""
    docs = lake.table("documents").select("doc_id", "lang", "text")
    pairs = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(p).alias("pseudonym")) for a, p in (("the", "2"), ("tion", "1"), ("TiON", "1"))])
    aliases = docs.select("lang").distinct().select("lang", F.inline(pairs))
    return A.replace_in_cases(docs, "lang", ["text"], aliases).select("doc_id", F.md5("text").alias("digest"))


@query("red_08", sql=r"""SELECT doc_id, md5('proc {guid} ' || text) AS digest FROM documents""")
def red_08(lake):
    text = F.concat(F.lit("proc {9B1D8C1E-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("} "), F.col("text"))
    masked = F.regexp_replace(text, r"(?i)\{[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}", "{guid}")
    return lake.table("documents").select("doc_id", F.md5(masked).alias("digest"))


@query("red_09", sql="SELECT o_orderkey AS case_id, 'cmd|-u|' || o_orderpriority || '|[redacted-credential]' AS arguments FROM orders")
def red_09(lake):
    args = F.array(F.lit("cmd"), F.lit("-u"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    hidden = F.transform(args, lambda a, i: F.when(i == 3, F.lit("[redacted-credential]")).otherwise(a))
    return lake.table("orders").select(F.col("o_orderkey").alias("case_id"), F.array_join(hidden, "|").alias("arguments"))


@query("red_10", sql=rf"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i){LEAK_PATTERN}', 1), lambda x: lower(x)))), '|') AS hits
    FROM {_SEEDED} WHERE regexp_matches(text, '(?i){LEAK_PATTERN}')""")
def red_10(lake):
    hits = seeded(lake).select("doc_id", X.leak_hits(F.col("text")).alias("h")).filter(F.size("h") > 0)
    return hits.select("doc_id", joined(F.array_distinct(F.transform("h", F.lower))).alias("hits"))


@query("red_11", sql="SELECT doc_id, CASE doc_id % 20 WHEN 0 THEN 'Invoke-Atomic|T1059.003' ELSE 'PurpleSharp' END AS decoded_hits FROM documents WHERE doc_id % 20 IN (0, 7)")
def red_11(lake):
    """Tokens of all documents; some carry an encoded leak in one of the two encodings."""
    d = F.col("doc_id") % 20
    blob = (F.when(d == 0, F.concat(F.lit(" blob "), b64_utf16(F.lit("Invoke-AtomicTest T1059.003"))))
            .when(d == 7, F.concat(F.lit(" blob "), C.base64_text(F.encode(F.lit("load the PurpleSharp module"), "UTF-8")))).otherwise(""))
    docs = lake.table("documents").withColumn("text", F.concat("text", blob))
    found = X.encoded_leaks(docs, "doc_id", "text")
    return found.select("doc_id", F.array_join("decoded_hits", "|").alias("decoded_hits"))


def _class_sql(source, label, pattern):
    quoted = pattern.replace("'", "''")
    return (f"SELECT doc_id, '{label}' AS label, regexp_extract(text, '(?i){quoted}', 0) AS hit FROM {source} "
            f"WHERE regexp_matches(text, '(?i){quoted}')")


_TAIL = " A weak Caldera case; do not leak attack step 4 or correct_verdict."
_TAILED = f"(SELECT * REPLACE (text || CASE WHEN doc_id % 4 = 0 THEN '{_TAIL}' ELSE '' END AS text) FROM documents)"
CLASSES = {**FORBIDDEN_PATTERNS, "case leak": CASE_LEAK_PATTERN}


@query("red_12", sql=" UNION ALL ".join(_class_sql(_TAILED, k, p) for k, p in CLASSES.items()))
def red_12(lake):
    docs = lake.table("documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 4 == 0, _TAIL).otherwise("")))
    return X.labelled_hits(docs, "doc_id", "text", CLASSES)


@query("red_13", sql="SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def red_13(lake):
    return X.contained_passages(lake.table("documents"), "doc_id", "text", lake.table("benchmark").withColumnRenamed("text", "passage"), "item_id", "passage")


@query("scl_06", sql="SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'payload: ' || text WHEN 1 THEN '' ELSE 'ls -la /tmp/x' END AS decoded FROM conversations")
def scl_06(lake):
    t = F.col("turn") % 3
    command = (F.when(t == 0, F.concat(F.lit("powershell -EncodedCommand "), b64_utf16(F.concat(F.lit("payload: "), F.col("text")))))
               .when(t == 1, F.lit("powershell -e short")).otherwise(F.concat(F.lit("p -enc "), F.regexp_replace(b64_utf16(F.lit("ls -la /tmp/x")), "=", ""))))
    return lake.table("conversations").select("conv_id", "turn", C.encoded_command(command).alias("decoded"))


@query("scl_07", sql="SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Write-' || lang || '$x' ELSE '' END AS clear FROM documents")
def scl_07(lake):
    body = F.concat(F.lit("iex ( 'Wri' + 'te-' + '"), F.col("lang"), F.lit("~x' ).replace('~',[string][char]36)"))
    command = F.when(F.col("doc_id") % 2 == 0, body).otherwise("iex 'plain'")
    return lake.table("documents").select("doc_id", C.quoted_concat(command).alias("clear"))


@query("scl_08", sql="SELECT o_orderkey AS case_id, o_orderpriority || ' é' AS text FROM orders")
def scl_08(lake):
    encoded = F.hex(F.encode(F.concat("o_orderpriority", F.lit(" é")), "UTF-8"))
    return lake.table("orders").select(F.col("o_orderkey").alias("case_id"), C.hex_text(encoded).alias("text"))


@query("scl_09", sql="SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'ls|-la|' || url END AS arguments FROM pages")
def scl_09(lake):
    token = F.url_encode(C.base64_text(F.encode(F.to_json(F.array(F.lit("ls"), F.lit("-la"), F.col("url"))), "UTF-8")))
    parameter = F.when(F.col("page_id") % 5 == 0, "%%%").otherwise(token)
    return lake.table("pages").select("page_id", F.array_join(C.url_json_array(parameter), "|").alias("arguments"))


@query("scl_10", sql="SELECT l_orderkey AS case_id, l_linenumber AS line_no, sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)) AS digest FROM lineitem")
def scl_10(lake):
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")]
    return lake.table("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line_no"), F.sha2(F.concat_ws("|", *parts), 256).alias("digest"))


@query("scl_11", sql="SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS verdict, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS rationale FROM conversations")
def scl_11(lake):
    from alertweft.sources.model_text import parse_decision
    body = F.to_json(F.struct(F.col("role").alias("verdict"), F.col("text").alias("rationale")))
    t = F.col("turn") % 4
    reply = (F.when(t == 0, body).when(t == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(t == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done."))).otherwise("no json at all"))
    parsed = lake.table("conversations").select("conv_id", "turn", parse_decision(reply).alias("d"))
    return parsed.select("conv_id", "turn", "d.verdict", "d.rationale")


@query("scl_12", "usage", "SELECT DISTINCT tag, model AS base, CASE WHEN round > 1 THEN 'A2_round' || round ELSE 'A2' END AS suffix, round FROM usage")
def scl_12(lake):
    from alertweft.sources.outputs import base_model, round_of
    return lake.usage().select("tag", base_model(F.col("tag")).alias("base"), F.split_part("tag", F.lit("__"), F.lit(2)).alias("suffix"), round_of(F.col("tag")).alias("round")).distinct()


@query("scl_13", sql="SELECT doc_id, CAST(1000 + doc_id AS VARCHAR) AS serial, CAST(doc_id % 300 AS INTEGER) AS syscall, 1765796989444000 + doc_id * 1000 AS us FROM documents")
def scl_13(lake):
    from alertweft.sources.audit_log import audit_fields
    d = F.col("doc_id")
    line = F.concat(F.lit("type=SYSCALL msg=audit("), F.format_string("%d.%03d", F.lit(1765796989) + F.floor((d + 444) / 1000), (d + 444) % 1000), F.lit(":"),
                    (d + 1000).cast("string"), F.lit("): arch=c000003e syscall="), (d % 300).cast("string"), F.lit(" success=yes "), F.col("text"))
    return lake.table("documents").select("doc_id", *audit_fields(line)).select("doc_id", "serial", "syscall", F.unix_micros("event_time").alias("us"))


@query("scl_14", sql=rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\bT[0-9]{{4}}(?:\.[0-9]{{3}})?\b'))), '|') AS techniques
    FROM (SELECT doc_id, text || ' T1059.001 T1003 T1059.001 XT1234' AS text FROM documents)""")
def scl_14(lake):
    found = F.regexp_extract_all(F.concat("text", F.lit(" T1059.001 T1003 T1059.001 XT1234")), F.lit(r"\bT\d{4}(?:\.\d{3})?\b"), F.lit(0))
    return lake.table("documents").select("doc_id", joined(F.array_distinct(found)).alias("techniques"))


_CONV = """lower(text || CASE turn % 3 WHEN 0 THEN ' This clearly confirms execution! It might be fine.' WHEN 1 THEN ' It was likely confirmed as a breach.' ELSE '' END)"""


@query("scl_15", sql=f"SELECT conv_id, turn, {_over_sql(_CONV)} AS over_asserted FROM conversations")
def scl_15(lake):
    t = F.col("turn") % 3
    tail = F.when(t == 0, " This clearly confirms execution! It might be fine.").when(t == 1, " It was likely confirmed as a breach.").otherwise("")
    return lake.table("conversations").select("conv_id", "turn", over_assertion(F.lower(F.concat("text", tail))).alias("over_asserted"))


@query("scl_16", sql="SELECT conv_id, turn, contains(lower(text), 'est') OR contains(lower(text), 'the ') AS mentioned FROM conversations")
def scl_16(lake):
    low = F.lower("text")
    terms = F.array(F.lit("EST"), F.lit("The "))
    return lake.table("conversations").select("conv_id", "turn", F.exists(terms, lambda t: F.contains(low, F.lower(t))).alias("mentioned"))


@query("scl_17", sql="SELECT o_orderkey AS case_id, o_orderkey >= 100 AND o_orderkey < 1000 AND o_orderkey % 2 = 0 AS valid FROM orders")
def scl_17(lake):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "INJ-").otherwise("inj-"), k.cast("string"))
    return lake.table("orders").select(k.alias("case_id"), name.rlike(r"^[A-Z]+-\d{3}$").alias("valid"))


@query("udf_01", sql="SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'payload: ' || text ELSE 'ab' END AS value FROM conversations")
def udf_01(lake):
    """Derivation registry: the method name picks the column builder."""
    enc = C.derive("base64_utf16le", F.concat(F.lit("x -e "), b64_utf16(F.concat(F.lit("payload: "), F.col("text")))))
    cat = C.derive("ps_deobfuscate_concat", F.lit("iex ('a'+'b')"))
    return lake.table("conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, enc).otherwise(cat).alias("value"))


@query("udf_02", "pkg", "SELECT case_id, evidence_id, record_id, 'flag=' || flag || '|quantity=' || quantity || '|status=-' AS attributes FROM pkg")
def udf_02(lake):
    """Builder registry: named transforms chained with DataFrame.transform."""
    from alertweft.operators import packages as K
    from alertweft.operators.projection import attribute_text
    out = lake.evidence().transform(K.build("suppress_provenance", ["part"])).transform(K.build("overwrite_attribute", "status", "-"))
    return out.select("case_id", "evidence_id", "record_id", attribute_text(F.col("attributes")).alias("attributes"))


@query("udf_03", "ev", "SELECT 'column' AS selector, CAST(count(*) AS BIGINT) AS matches FROM ev WHERE k > 50 UNION ALL SELECT 'rule', CAST(count(*) AS BIGINT) FROM ev WHERE event_type = 'view'")
def udf_03(lake):
    """Selectors are columns or rule documents, never row lambdas."""
    from alertweft.operators import rules as R, selection as S
    return S.not_exactly_one(lake.events(), {
        "column": F.col("k") > 50, "rule": R.predicate({"field": "attributes.event_type", "op": "eq", "value": "view"})})


@query("udf_05", "ev", "SELECT event_id, 'seen by [user] on [host]' AS text FROM ev")
def udf_05(lake):
    """Per-row mappings: every row brings its own key set to the one-pass replacement."""
    text = F.concat(F.lit("seen by "), F.upper("user"), F.lit(" on "), F.col("computer"))
    return lake.events().select("event_id", A.replace_simultaneous(text, F.create_map(F.col("user"), F.lit("[user]"), F.col("computer"), F.lit("[host]"))).alias("text"))


