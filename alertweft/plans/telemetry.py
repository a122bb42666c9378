"""Endpoint telemetry view: the attributes of every event follow from its ``k`` value."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, functions as F

from alertweft.functions.codec import encoded_command
from alertweft.plans.adapters import Lake

SYSTEM32 = "C:\\Windows\\System32\\"
_BLOB = base64.b64encode("$input | Out-String; exit".encode("utf-16le")).decode()
_POWERSHELL = SYSTEM32 + "WindowsPowerShell\\v1.0\\powershell.exe"

# scenario -> (event code, attributes, rules it must trigger)
SCENARIOS = [
    (1, {"image": SYSTEM32 + "net.exe", "command_line": "net user /add bob"}, ["ACCT-001"]),
    (4625, {"sub_status": "0xC0000064", "workstation_name": "ws-1"}, ["BF-002"]),
    (3, {"destination_port": "3389", "initiated": "False"}, ["BF-001"]),
    (1, {"image": SYSTEM32 + "certutil.exe", "command_line": "certutil -exportPFX -PrivateKey my out.pfx"}, ["CERT-001"]),
    (13, {"target_object": "HKLM\\System\\Services\\EventLog\\Start", "details": "DWORD (0x00000004)"}, ["EVL-001"]),
    (13, {"target_object": "HKU\\S-1\\Environment\\UserInitMprLogonScript", "registry_event": "SetValue"},
     ["LGN-002", "LOGON-001"]),
    (10, {"target_image": SYSTEM32 + "lsass.exe", "source_image": "C:\\t\\mimikatz.exe", "granted_access": "0x1010"},
     ["LS-001"]),
    (1, {"image": SYSTEM32 + "cmd.exe", "parent_image": SYSTEM32 + "wbem\\WmiPrvSE.exe",
         "command_line": "cmd.exe /Q /c cd  1> \\\\127.0.0.1\\ADMIN$\\__1 2>&1"}, []),
    (1, {"image": SYSTEM32 + "cmd.exe", "parent_image": SYSTEM32 + "wbem\\WmiPrvSE.exe",
         "command_line": "cmd.exe /Q /c whoami 1> \\\\127.0.0.1\\ADMIN$\\__1 2>&1"}, ["SMB-001"]),
    (4698, {"run_as": "NT AUTHORITY\\SYSTEM", "action_command": "C:\\x.BAT"}, []),
    (20, {"destination": "powershell -w hidden -enc " + _BLOB}, ["WMI-001", "WMI-002"]),
    (0, {"full_log": "ossec: Agent disconnected: 'a-1'."}, ["ER-W03"]),
    (0, {"raw_text": "sudo: root : COMMAND=/usr/bin/systemctl daemon-reload"}, ["ER-M01"]),
    (7, {"image": SYSTEM32 + "spoolsv.exe", "image_loaded": "C:\\w\\spool\\drivers\\x64\\3\\a.dll"}, ["ER-C03"]),
    (3, {"image": SYSTEM32 + "cscript.exe", "protocol": "TCP", "initiated": "true"}, ["ER-W01"]),
    (8, {"start_module": "-"}, ["INJ-001"]),
    (1, {"image": "C:\\t\\rcs\u202efdp.exe"}, ["RTLO-001"]),
    (1, {"image": _POWERSHELL, "parent_image": _POWERSHELL,
         "command_line": "powershell -ExecutionPolicy Bypass -enc " + _BLOB}, ["PS-001"]),
    (1, {"image": SYSTEM32 + "notepad.exe", "command_line": "notepad.exe a.txt"}, []),
    (22, {"image": SYSTEM32 + "svchost.exe", "query_name": "example.com"}, []),
]


def telemetry(lake: Lake) -> DataFrame:
    """Canonical events whose code and attributes are those of scenario ``k mod 20``."""
    ev = lake.spread_events()
    pick = (F.col("k") % len(SCENARIOS)).cast("int")
    maps = F.array(*[
        F.create_map(*[F.lit(x) for pair in attrs.items() for x in pair]) for _, attrs, _ in SCENARIOS
    ])
    shaped = ev.withColumn("event_code", F.get(F.array(*[F.lit(c) for c, _, _ in SCENARIOS]), pick)).withColumn(
        "attributes", F.get(maps, pick)
    )
    command = F.coalesce(F.col("attributes")[F.lit("command_line")], F.lit(""))
    return shaped.withColumn("derived", F.create_map(F.lit("decoded_command"), encoded_command(command)))


#: events that share a host, seconds between them by block, and the time the first block starts at
BLOCK, STEPS_MS, BURST_START = 40, (300, 1000, 2000, 20000), 1_700_000_000_000_000


def burst_telemetry(lake: Lake) -> DataFrame:
    """The events dealt to logon, remote desktop and driver bursts, for the rules with an aggregation block.

    Forty events in a row make a block: one host, a fixed step between its events and a
    pause in its middle.  Steps, repeated values and missing ones make groups of every
    rule fail by count, span, gap or distinct values.
    """
    e = F.col("event_id")
    block, place = F.floor(e / BLOCK), e % BLOCK
    step = F.get(F.array(*[F.lit(s) for s in STEPS_MS]), (block % len(STEPS_MS)).cast("int"))
    us = F.lit(BURST_START) + (block % 1_000_000) * 810_000_000 + place * step * 1000 + F.when(place >= BLOCK // 2, 5_000_000).otherwise(0)
    name = block.cast("string")
    value = F.when(e % 13 != 0, F.concat(F.lit("v"), (e % F.when(block % 5 == 0, 7).otherwise(11)).cast("string")))
    text = lambda word: F.concat(F.lit(word + "-"), name)
    entries = lambda pairs: F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    logon = entries([("sub_status", F.lit("0xC0000064")), ("workstation_name", text("ws")), ("target_user_name", value)])
    desktop = entries([("destination_port", F.lit("3389")), ("initiated", F.lit("False")), ("source_ip", text("src")),
                       ("destination_ip", text("dst")), ("source_port", value)])
    image = F.concat(F.lit("C:\\w\\spool\\drivers\\x64\\3\\"), F.coalesce(value, F.lit("none")), F.lit(".dll"))
    driver = entries([("image", F.lit(SYSTEM32 + "spoolsv.exe")), ("process_id", name), ("image_loaded", image)])
    kind = (e % 3).cast("int")
    return lake.table("events").select(
        "event_id", e.cast("string").alias("record_key"), F.timestamp_micros(us.cast("bigint")).alias("event_time"),
        F.get(F.array(F.lit(4625), F.lit(3), F.lit(7)), kind).alias("event_code"), F.concat(F.lit("host-"), (block % 10).cast("string")).alias("computer"),
        F.get(F.array(logon, desktop, driver), kind).alias("attributes"))


def bursts_sql(limits: dict[str, dict]) -> str:
    """Groups of the three aggregated rules over the burst telemetry, from their thresholds: (rule_case, grp, n, start_us, end_us, n_distinct, first_event)."""
    steps = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(STEPS_MS))
    arms = " ".join(f"WHEN '{case}' THEN {{{case}}}" for case in limits)
    pick = lambda name, missing: "CASE rule_case " + arms.format(**{c: missing if v[name] is None else v[name] for c, v in limits.items()}) + " END"
    return f"""
    b AS (SELECT event_id AS e, event_id // {BLOCK} AS b, event_id % {BLOCK} AS p, CASE event_id % 3 WHEN 0 THEN 'BF-002' WHEN 1 THEN 'BF-001' ELSE 'ER-C03' END AS rule_case,
        CASE WHEN event_id % 13 <> 0 THEN 'v' || event_id % (CASE WHEN (event_id // {BLOCK}) % 5 = 0 THEN 7 ELSE 11 END) ELSE 'none' END AS v FROM events),
    t AS (SELECT *, {BURST_START} + (b % 1000000) * 810000000 + p * (CASE b % {len(STEPS_MS)} {steps} END) * 1000 + CASE WHEN p >= {BLOCK // 2} THEN 5000000 ELSE 0 END AS us FROM b),
    g AS (SELECT *, us - lag(us) OVER (PARTITION BY rule_case, b ORDER BY us) AS gap FROM t),
    s AS (SELECT *, sum(CASE WHEN gap > {pick('gap', 1 << 62)} THEN 1 ELSE 0 END) OVER (PARTITION BY rule_case, b ORDER BY us) AS sid FROM g),
    found AS (SELECT rule_case, CASE rule_case WHEN 'BF-002' THEN 'host-' || b % 10 || '|ws-' || b WHEN 'BF-001' THEN 'src-' || b || '|dst-' || b || '|3389' ELSE CAST(b AS VARCHAR) END AS grp,
        CAST(count(*) AS BIGINT) AS n, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) AS BIGINT) AS end_us, CAST(count(DISTINCT v) AS BIGINT) AS n_distinct, min(e) AS first_event
        FROM s GROUP BY rule_case, b, sid HAVING count(*) >= {pick('count', 1)} AND max(us) - min(us) <= {pick('within', 1 << 62)} AND count(DISTINCT v) >= {pick('distinct', 0)})"""


def expected_hits_sql() -> str:
    """VALUES rows (scenario, rule) for the SQL twins."""
    return ", ".join(f"({i}, '{rule}')" for i, (_, _, hits) in enumerate(SCENARIOS) for rule in hits)
