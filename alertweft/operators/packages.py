"""Alert packages: numbering, context, exclusions, counterfactuals, documents, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from alertweft.functions.ranking import split_row_number


def number_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence ids by (time text, record id); the alert keeps ``A0``."""
    rest = evidence.filter("not is_alert")
    ranked = split_row_number(rest, ["case_id"], F.left("event_time_utc", F.lit(7)), [F.col("event_time_utc"), F.col("record_id")], "_rn")
    numbered = ranked.withColumn("evidence_id", F.format_string("EV-%03d", "_rn")).drop("_rn")
    return numbered.unionByName(evidence.filter("is_alert").withColumn("evidence_id", F.lit("A0")))


def context(items: DataFrame, keys: list[str]) -> DataFrame:
    """Observed context per package: sorted distinct hosts, users and types, time window, count.

    Values are made distinct before they are gathered, so the gathered arrays
    hold what the package document lists and nothing more.
    """
    lists = items.select(*keys, F.inline(F.array(
        F.struct(F.lit("computers").alias("part"), F.col("computer").alias("value")),
        F.struct(F.lit("users").alias("part"), F.col("user").alias("value")),
        F.struct(F.lit("types").alias("part"), F.col("event_type").alias("value")),
    ))).filter("value <> ''").distinct()
    pick = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("value")))).alias(p)
    gathered = lists.groupBy(*keys).agg(pick("computers"), pick("users"), pick("types"))
    window = items.groupBy(*keys).agg(
        F.min("event_time_utc").alias("start"), F.max("event_time_utc").alias("end"), F.count(F.lit(1)).alias("event_count"))
    return window.join(gathered, keys, "left")


def exclude_attributes(evidence: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence without the excluded attributes, exclusions that matched nothing).

    The second frame must be empty before a package is published.
    """
    key = ["case_id", "evidence_id"]
    fields = exclusions.groupBy(*key).agg(F.collect_set("field").alias("_drop"))
    cleaned = evidence.join(fields, key, "left").withColumn(
        "attributes",
        F.when(F.col("_drop").isNull(), F.col("attributes")).otherwise(
            F.map_filter("attributes", lambda k, v: ~F.array_contains(F.col("_drop"), k))),
    ).drop("_drop")
    present = evidence.select(*key, F.explode(F.map_keys("attributes")).alias("field")).distinct()
    known = evidence.select(*key).distinct()
    stale = exclusions.join(present, [*key, "field"], "left_anti")
    labelled = stale.join(known.withColumn("_known", F.lit(True)), key, "left").select(
        *key, "field", F.when(F.col("_known"), "field_absent").otherwise("unknown_evidence").alias("problem"))
    return cleaned, labelled


def renumber(evidence: DataFrame, selected: DataFrame) -> DataFrame:
    """A package over a chosen id list: ``selected`` has (case_id, neutral_id, source_ids in order)."""
    order = selected.select("case_id", "neutral_id", F.posexplode("source_ids").alias("pos", "evidence_id"))
    visible = F.when(F.col("pos") == 0, "A0").otherwise(F.format_string("EV-%03d", "pos"))
    return evidence.join(order, ["case_id", "evidence_id"]).withColumn("visible_id", visible).drop("pos")


# Registry of counterfactual builders: operation name -> DataFrame transform.
BUILDERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {}


def builder(name: str):
    def register(fn):
        BUILDERS[name] = fn
        return fn

    return register


@builder("suppress_provenance")
def suppress_provenance(fields: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Remove attributes that reveal where evidence came from."""
    return lambda df: df.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~k.isin(fields)))


@builder("overwrite_attribute")
def overwrite_attribute(field: str, value: str, where: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Give one attribute a fixed value on the chosen rows."""
    def apply(df: DataFrame) -> DataFrame:
        others = F.map_filter("attributes", lambda k, v: k != field)
        changed = F.map_concat(others, F.create_map(F.lit(field), F.lit(value)))
        return df.withColumn("attributes", changed if where is None else F.when(where, changed).otherwise(F.col("attributes")))

    return apply


@builder("drop_derivations")
def drop_derivations() -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("derived", F.create_map().cast("map<string,string>"))


def build(name: str, *args, **kwargs) -> Callable[[DataFrame], DataFrame]:
    """A registered builder, for ``DataFrame.transform``."""
    if name not in BUILDERS:
        raise ValueError(f"unknown builder {name!r}; known: {sorted(BUILDERS)}")
    return BUILDERS[name](*args, **kwargs)


def evidence_struct() -> Column:
    """The published evidence item."""
    return F.struct(
        "evidence_id", F.when(F.col("evidence_id") == "A0", True).alias("is_triggering_alert"), "event_time_utc",
        F.struct("event_code", F.col("record_id").alias("event_record_id")).alias("source_event"), "computer", "attributes",
    )


def documents(evidence: DataFrame, derivations: DataFrame) -> DataFrame:
    """One nested document per case: alert, evidence items and derivations.

    A package is a single document by definition, so its items meet in one row
    here, at the sink, and nowhere before.
    """
    # an item holds its own sort key, which is therefore not shuffled beside it
    sort_key = lambda x: F.struct(x["evidence_id"], x["event_time_utc"], x["source_event"]["event_record_id"])
    in_order = lambda a, b: F.when(sort_key(a) < sort_key(b), -1).when(sort_key(a) > sort_key(b), 1).otherwise(0)
    items = evidence.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("evidence_id") != "A0", evidence_struct())), in_order).alias("evidence_items"),
        F.min_by(F.when(F.col("evidence_id") == "A0", evidence_struct()), F.struct(F.col("evidence_id") != "A0", "event_time_utc", "record_id")).alias("main_alert"),
        F.count(F.lit(1)).alias("event_count"),
    ).select("case_id", "main_alert", "evidence_items", "event_count")
    derived = derivations.groupBy("case_id").agg(F.collect_set(F.struct("derivation_id", "source_evidence_id", "source_field")).alias("deterministic_derivations"))
    return items.join(derived, "case_id", "left")


def role_notes(evidence: DataFrame, roles: DataFrame, multi: bool) -> DataFrame:
    """Selection metadata: record id, type, source and role note per evidence id, with the default note."""
    from alertweft.operators.projection import qualified_key
    keyed = evidence.withColumn("role_key", qualified_key(F.col("record_id"), F.col("sensor"), multi))
    default = F.concat(F.lit("additional correlated "), F.col("event_type"), F.lit(" event retained by the fixed selection"))
    return keyed.join(roles, ["case_id", "role_key"], "left").withColumn("role_note", F.coalesce("role_note", default))
