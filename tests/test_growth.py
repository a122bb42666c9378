"""What made jobs grow faster than their input, or leave cores idle, on rows of their own."""

import datetime as dt
import time
from pathlib import Path

from pyspark.sql import functions as F

from alertweft.operators import lineage as N, packages as K, projection as P
from alertweft.operators.replay import natural
from alertweft.plans.adapters import Lake
from alertweft.sources import sinks, windows as Wd


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events_folder(spark, tmp_path, n=40):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 3, "click", 1.0, f"{{k: {i}}}") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_events_of_one_small_file_are_spread_over_all_cores(spark, tmp_path):
    lake = Lake(spark, events_folder(spark, tmp_path))
    assert lake.events().rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert lake.spread_events().rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert sorted(map(str, lake.spread_events().collect())) == sorted(map(str, lake.events().collect()))


def test_mapped_names_are_looked_up_not_branched_over(spark):
    text = "01/02/2024 03:04:05 AM\nEventCode={}\nComputerName=h\nRecordNumber=7\nMessage=m\n\nSubject:\n\tAccount Name:\t\tS\n\nNew Logon:\n\tAccount Name:\t\t u v \t\n\tLogon Type:\t3\n\tLogon Type:\t4\n"
    raws = spark.createDataFrame([(text.format(c),) for c in ("4624", "5140", "9", "")], "raw string")
    parsed = Wd.canonical_from_stanza(raws)
    assert "CASE WHEN (event_code" not in plan(parsed).replace("#", "") and "WHEN (_c" not in plan(parsed)
    found = {r.event_code: r.attributes for r in parsed.collect()}
    assert found == {"4624": {"target_user_name": "u v", "logon_type": "3"}, "5140": found["5140"], "9": {}, "": {}}
    xml = spark.createDataFrame([(f"<Event><EventID>{c}</EventID><Data Name='Image'></Data><Data Name='x'>1</Data><Data Name='x'>2</Data></Event>",) for c in (1, 77)], "raw string")
    assert {r.event_code: r.attributes for r in P.canonical_from_xml(xml).collect()} == {"1": {}, "77": {"Image": "", "x": "2"}}


def test_stanza_lines_that_almost_match(spark):
    raw = "EventCode=1\nMessage=x\n" + "\t" * 20_000 + "\nAa:\tb\rc\nD E: f\nGg: \n\tHh:\t\t\ti: j\n"
    start = time.time()
    found = spark.createDataFrame([(raw,)], "raw string").select(Wd.stanza_fields(F.col("raw")).alias("f")).first().f
    assert [tuple(x) for x in found] == [("Aa", "b"), ("Hh", "i: j"), ("Gg|Hh", "i: j")] and time.time() - start < 20


def test_walks_of_a_forest_double_their_depth(spark):
    edges = spark.createDataFrame([(0, 0)] + [(i, i // 2) for i in range(1, 600)] + [(1000 + i, 1000 + i + 1) for i in range(70)], "guid long, parent_guid long")
    parent = {r.guid: r.parent_guid for r in edges.collect() if r.guid != r.parent_guid}
    reach = N.closure(edges)
    assert {r.dist for r in reach.select("dist").distinct().collect()} == {1, 2, 3, 4, 8, 16, 32, 64}
    want = set()
    for a in (599, 300, 3, 1000, 1005):
        at, d = a, 0
        while at in parent:
            at, d = parent[at], d + 1
            want.add((a, at, d))
    anchors = spark.createDataFrame([(a,) for a in (599, 300, 3, 1000, 1005, 1005, None)], "guid long")
    up = N.ancestors(reach, anchors)
    assert "anti" not in plan(up).lower()
    assert sorted((r.anchor, r.guid, r.depth) for r in up.collect()) == sorted(want)
    everyone = N.ancestors(reach, edges.select("guid")).select("guid", "anchor", "depth")
    everyone = everyone.join(edges.select(F.col("guid").alias("guid")), "guid", "left_semi")
    down = N.descendants(reach, edges.select("guid"))
    assert sorted(map(tuple, down.select("anchor", "guid", "depth").collect())) == sorted(map(tuple, everyone.collect()))


def test_two_parents_or_a_cycle_keep_the_careful_walk(spark):
    ladder = [(i, i + 1) for i in range(20)] + [(i, i + 2) for i in range(19)]
    for extra, steps in ((ladder, 10), ([(i, i + 1) for i in range(20)] + [(50, 51), (51, 50)], 20)):
        reach = N.closure(spark.createDataFrame(extra, "guid long, parent_guid long"))
        assert {r.dist for r in reach.select("dist").distinct().collect()} <= {1, 2, 3, 4}
        up = N.ancestors(reach, spark.createDataFrame([(0,)], "guid long")).collect()
        assert len(up) == 20 and len({r.guid for r in up}) == 20 and max(r.depth for r in up) == steps


def test_documents_shuffle_no_key_twice_and_are_compressed(spark, tmp_path):
    rows = [(c, e, f"2024-01-0{d}T00:00:00Z", r, 1, "h", {"flag": "N"}) for c in range(300) for e, d, r in (("EV-002", 1, "9"), ("EV-001", 2, "8"), ("EV-001", 1, "7"), ("A0", 3, "6"))]
    evidence = spark.createDataFrame(rows, "case_id long, evidence_id string, event_time_utc string, record_id string, event_code int, computer string, attributes map<string,string>")
    derived = spark.createDataFrame([(1, "DER-001", "A0", "x")], "case_id long, derivation_id string, source_evidence_id string, source_field string")
    found = K.documents(evidence, derived)
    assert "struct(evidence_id" in plan(found) and ", item," not in plan(found)
    row = found.filter("case_id = 1").first()
    assert [i.source_event.event_record_id for i in row.evidence_items] == ["7", "8", "9"] and row.main_alert.evidence_id == "A0"
    sinks.write_documents(found, f"{tmp_path}/docs")
    files = [f for f in Path(f"{tmp_path}/docs").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert spark.read.json(f"{tmp_path}/docs").count() == 300


def test_order_of_a_replay_is_formed_for_keys_of_digits_and_others(spark):
    keys = ["12", "7", "a7", "A12", "", "0012", "1" * 25, "7\n", "٣", None]
    old = lambda key: F.array_join(F.transform(F.regexp_extract_all(key, F.lit(r"(\d+|\D+)"), F.lit(1)),
                                               lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(F.lower(r))), "\u0001")
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(natural(F.col("k")).alias("new"), old(F.col("k")).alias("old")).collect()
    assert all(r.new == r.old for r in got)


def test_methods_that_the_jit_skips_are_not_generated(spark, tmp_path):
    from alertweft.plans import load_queries
    load_queries()[0]["flt_01"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
