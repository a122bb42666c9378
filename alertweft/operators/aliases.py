"""Replacement of many aliases in one pass: the longest alias at each place, without regard to case.

The aliases of a case become one automaton (a trie with failure links), built once for
all texts of the case that a task holds.  Replacements are never replaced again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from alertweft.session import materialise, ship

ship(__name__)

#: bytes of text of one case that a task takes; larger cases are cut and their aliases sent to every part
SLICE_BYTES = 16 << 20
#: automata a worker keeps for mappings that come with the rows
KEPT = 64


def _lower(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Replacer:
    """All aliases of a case; of two that differ in case only the later one counts, and an empty one says nothing."""

    def __init__(self, mapping: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for alias, value in mapping.items():
            if alias and value is not None:
                self.automaton.add_word(_lower(alias), (len(alias), value))
        if len(self.automaton):
            self.automaton.make_automaton()

    def replace(self, text: str | None) -> str | None:
        if not text or not len(self.automaton):
            return text
        longest: dict[int, tuple[int, str]] = {}  # aliases that start at a place end in order, so the last is the longest
        for last, found in self.automaton.iter(_lower(text)):
            longest[last + 1 - found[0]] = found
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                size, value = longest[start]
                out += [text[at:start], value]
                at = start + size
        return "".join([*out, text[at:]]) if out else text


def replace_simultaneous(text: Column, mapping: Column) -> Column:
    """Replace all keys of a map that comes with the row; a null text or map gives null.

    For maps that many rows share, :func:`replace_in_cases` sends each only once.
    """

    def run(texts: pd.Series, mappings: pd.Series) -> pd.Series:
        known: dict[tuple, Replacer] = {}
        out = []
        for value, found in zip(texts, mappings):
            if value is None or found is None:
                out.append(None)
                continue
            key = tuple(dict(found).items())
            if key not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[key] = Replacer(dict(key))
            out.append(known[key].replace(value))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text, mapping)


def replace_in_cases(rows: DataFrame, case: str, columns: list[str], aliases: DataFrame) -> DataFrame:
    """``rows`` with every alias of their case replaced in ``columns`` (strings, or the values of string maps).

    ``aliases`` is (case, alias, pseudonym).  Rows and aliases meet in one sorted
    stream: the aliases of a case come first, then its texts one batch after the
    other, so a task holds one automaton and one batch.  A case with much text is cut
    into slices.  Rows of a case without aliases, or without a case, stay as they are.
    """
    kinds = {c: rows.schema[c].dataType for c in columns}
    values = [F.map_values(c) if isinstance(kinds[c], T.MapType) else F.array(c) for c in columns]
    size = sum(F.coalesce(F.octet_length(F.array_join(v, "")), F.lit(0)) for v in values)
    # texts travel once: beside them go the other columns and the keys of maps
    rest = [F.map_keys(c).alias(c) if c in columns else F.col(c) for c in rows.columns if c not in columns or isinstance(kinds[c], T.MapType)]
    texts = rows.select(F.col(case).alias("case"), F.struct(*rest, F.lit(0).alias("_kept")).alias("row"), F.array(*values).alias("texts"), size.alias("bytes"))
    sizes = materialise(texts.groupBy("case").agg(F.sum("bytes").alias("bytes")), "case-sizes")
    # few by nature: their number is bounded by the bytes of all texts over those of a slice
    cut = sizes.select("case", F.ceil(F.col("bytes") / SLICE_BYTES).cast("int").alias("slices")).where("slices > 1 and case is not null")
    # so a task holds a few slices, however much text there is
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // SLICE_BYTES))
    whole = F.coalesce("slices", F.lit(1))
    placed = texts.join(cut, "case", "left").select(
        "case", F.pmod(F.xxhash64("texts"), whole).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("alias"),
        F.lit(None).cast("string").alias("pseudonym"), "row", "texts")
    sent = aliases.select(F.col(case).alias("case"), "alias", "pseudonym").join(cut, "case", "left").select(
        "case", F.explode(F.sequence(F.lit(0), whole - 1)).alias("slice"), F.lit(0).alias("kind"), "alias", "pseudonym",
        F.lit(None).cast(placed.schema["row"].dataType).alias("row"), F.lit(None).cast(placed.schema["texts"].dataType).alias("texts"))
    # rows without a case are spread by their texts
    key = F.coalesce(F.xxhash64("case"), F.xxhash64("texts"))
    stream = placed.unionByName(sent).withColumn("key", key).repartition(parts, "key", "slice").sortWithinPartitions("key", "case", "slice", "kind")
    schema = T.StructType([placed.schema["row"], placed.schema["texts"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mapping, replacer = None, {}, None
        for batch in batches:
            out = []
            names = ("case", "slice", "kind", "alias", "pseudonym", "texts")
            for found, part, kind, alias, pseudonym, value in zip(*(batch.column(n).to_pylist() for n in names)):
                if (found, part) != at:
                    at, mapping, replacer = (found, part), {}, None
                if not kind:
                    mapping[alias] = pseudonym
                    continue
                if replacer is None:
                    replacer = Replacer(mapping)
                out.append([None if group is None else [replacer.replace(t) for t in group] for group in value])
            kept = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            yield pa.RecordBatch.from_arrays([kept.column("row"), pa.array(out, batch.schema.field("texts").type)], names=["row", "texts"])

    done = stream.select("case", "slice", "kind", "alias", "pseudonym", "row", "texts").mapInArrow(run, schema)
    again = []
    for c in rows.columns:
        if c not in columns:
            again.append(F.col("row")[c].alias(c))
            continue
        new = F.get("texts", F.lit(columns.index(c)))
        again.append((F.when(F.col("row")[c].isNotNull(), F.map_from_arrays(F.col("row")[c], new)) if isinstance(kinds[c], T.MapType) else F.get(new, F.lit(0))).alias(c))
    return done.select(*again)
