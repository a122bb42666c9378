"""Redaction, pseudonyms and leak scans; everything runs as JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from alertweft.fixed import (
    BASE64_TOKEN, CORPUS_DOMAINS, ENCODED_ARGUMENT, FRAMEWORK_PATTERN, LEAK_PATTERN, TECHNIQUE_PATTERN,
    TEST_CREDENTIAL_PATTERN, WELL_KNOWN_ACCOUNTS,
)
from alertweft.functions.codec import base64_bytes, base64_text, utf16le_text, utf8_text
from alertweft.functions.text import occurrences, replace_all
from alertweft.session import materialise


def redact_tokens(text: Column) -> Column:
    """Technique ids, the test credential, framework names: in this order."""
    text = F.regexp_replace(text, f"(?i){TECHNIQUE_PATTERN}", "[id]")
    text = F.regexp_replace(text, f"(?i){TEST_CREDENTIAL_PATTERN}", "[redacted-password]")
    return F.regexp_replace(text, f"(?i){FRAMEWORK_PATTERN}", "[x]")


def _recode(blob: Column) -> Column:
    plain = utf16le_text(base64_bytes(blob))
    clean = redact_tokens(plain)
    changed = base64_text(F.encode(clean, "UTF-16LE"))
    return F.when(plain.isNull() | (clean == plain), blob).otherwise(changed)


def redact(text: Column) -> Column:
    """Redact plain text and the decoded content of encoded arguments; clean blobs keep their bytes."""
    pattern = F.lit("(?i)" + ENCODED_ARGUMENT)
    outside = F.transform(F.split(text, "(?i)" + ENCODED_ARGUMENT), redact_tokens)
    prefixes = F.regexp_extract_all(text, pattern, F.lit(1))
    blobs = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), _recode)
    tails = F.slice(outside, F.lit(2), F.greatest(F.size(outside) - 1, F.lit(0)))
    pieces = F.zip_with(F.zip_with(prefixes, blobs, lambda p, b: F.concat(p, b)), tails, lambda a, t: F.concat(a, t))
    return F.when(F.size(prefixes) == 0, redact_tokens(text)).otherwise(F.concat(F.get(outside, F.lit(0)), F.array_join(pieces, "")))


def redact_map(attributes: Column) -> Column:
    """Apply :func:`redact` to every value of an attribute map."""
    return F.transform_values(attributes, lambda k, v: redact(v))


def replace_literals(df: DataFrame, text: str, mapping: dict[str, str]) -> DataFrame:
    """Apply case-scoped literal replacements and keep an occurrence count per literal."""
    value, counts = F.col(text), []
    for i, (source, target) in enumerate(mapping.items()):
        counts.append(occurrences(value, source).alias(f"n{i}"))
        value = replace_all(value, {source: target})
    return df.select("*", *counts, value.alias("redacted"))


def unmatched_literals(counted: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Literals that occur nowhere: a drift error for the caller to check."""
    totals = counted.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(mapping))])
    rows = F.array(*[F.struct(F.lit(s).alias("literal"), F.col(f"n{i}").alias("occurrences")) for i, s in enumerate(mapping)])
    return totals.select(F.inline(rows))


def host_pseudonyms(hosts: DataFrame, case: str, host: str) -> DataFrame:
    """(case, alias, pseudonym) rows for every form a host name takes.

    Full, short and 15-character forms, the domain and its first label.  When
    forms collide, plain forms of later hosts win and derived forms never
    replace an existing one.
    """
    distinct = hosts.select(case, host).filter(F.col(host) != "").distinct()
    ranked = distinct.withColumn("rn", F.row_number().over(W.partitionBy(case).orderBy(host)))
    short, dom = F.split_part(F.col(host), F.lit("."), F.lit(1)), F.regexp_extract(host, r"^[^.]*\.(.*)$", 1)
    name = F.format_string("host-%02d", "rn")
    net = F.regexp_replace(F.left(short, F.lit(15)), "[-_.]+$", "")
    derived = (F.length(net) >= 8) & (F.lower(net) != F.lower(short))
    label = F.split_part(dom, F.lit("."), F.lit(1))
    has_dom = dom != ""
    row = lambda test, alias, value, order: F.when(test, F.struct(
        F.lower(alias).alias("alias"), value.alias("pseudonym"), order.alias("pri")))
    rn = F.col("rn").cast("int")
    forms = F.array_compact(F.array(
        row(F.lit(True), F.col(host), F.concat(name, F.when(has_dom, ".corp.local").otherwise("")), rn * 10 + 1),
        row(F.lit(True), short, name, rn * 10 + 2),
        row(derived, net, name, -rn),
        row(has_dom, dom, F.lit("corp.local"), rn * 10 + 4),
        row(has_dom, label, F.lit("corp"), rn * 10 + 5),
    ))
    exploded = ranked.select(case, F.inline(forms))
    return exploded.groupBy(case, "alias").agg(F.max_by("pseudonym", "pri").alias("pseudonym"))


def user_pseudonyms(users: DataFrame, case: str, user: str) -> DataFrame:
    """(case, alias, pseudonym) rows for human account names."""
    name = F.regexp_replace(F.trim(F.element_at(F.split(F.col(user), r"\\"), -1)), r"\$+$", "")
    named = users.select(case, name.alias("name")).distinct()
    human = named.filter(~F.lower("name").isin(WELL_KNOWN_ACCOUNTS) & ~F.col("name").rlike(r"(?i)^host-\d"))
    ranked = human.withColumn("rn", F.row_number().over(W.partitionBy(case).orderBy("name")))
    return ranked.groupBy(case, F.lower("name").alias("alias")).agg(F.format_string("user-%02d", F.min("rn")).alias("pseudonym"))


def case_aliases(hosts: DataFrame, users: DataFrame, case: str) -> DataFrame:
    """(case, alias, pseudonym): host forms, then users, then the corpus domains; earlier entries win."""
    both = hosts.withColumn("pri", F.lit(0)).unionByName(users.withColumn("pri", F.lit(1)))
    domains = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(p).alias("pseudonym"), F.lit(2).alias("pri")) for a, p in CORPUS_DOMAINS.items()])
    every = both.unionByName(both.select(case).distinct().select(case, F.inline(domains)))
    return every.groupBy(case, "alias").agg(F.min_by("pseudonym", "pri").alias("pseudonym"))


def leak_hits(text: Column) -> Column:
    """Distinct leak tokens of a text, ordered without regard to case."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)" + LEAK_PATTERN), F.lit(1)))
    keyed = F.array_sort(F.transform(found, lambda h: F.struct(F.lower(h).alias("a"), h.alias("b"))))
    return F.transform(keyed, lambda s: s["b"])


def encoded_leaks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Leak tokens hidden in base64-looking tokens, decoded as UTF-16LE and as UTF-8.

    Only texts that hold such a token are exploded, one row per token, so one
    huge text does not stay in one expression.
    """
    tokens = docs.filter(F.col(text).rlike(BASE64_TOKEN)).select(
        key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({BASE64_TOKEN})"), F.lit(1)))).alias("token"))
    data = tokens.withColumn("data", base64_bytes(F.col("token")))
    both = F.array_union(leak_hits(F.coalesce(utf16le_text(F.col("data")), F.lit(""))), leak_hits(F.coalesce(utf8_text(F.col("data")), F.lit(""))))
    hits = data.select(key, F.explode(both).alias("hit")).distinct()
    return hits.groupBy(key).agg(F.array_sort(F.collect_list("hit")).alias("decoded_hits"))


def labelled_hits(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """First hit of every pattern class per document, long form, one scan."""
    hits = F.array(*[F.struct(F.lit(label).alias("label"), F.regexp_extract(text, f"(?i){p}", 0).alias("hit")) for label, p in patterns.items()])
    return docs.select(key, F.inline(hits)).filter("hit <> ''")


def has_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(f"(?i){p}") for p in patterns], F.lit(False))


#: words of a run, characters of the pieces that stand for shorter passages, and rows of one run that a task joins
RUN, PIECES, FREQUENT = 4, (16, 8, 4, 2, 1), 100_000


def _starts(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _word_runs(words: Column, first: int, last: Column) -> Column:
    """Hashes of the runs of RUN words that start from ``first`` to ``last``."""
    return F.transform(_starts(F.lit(first), last), lambda i: F.xxhash64(F.lit(0), *[F.get(words, i + n - 1) for n in range(RUN)]))


def _pieces(chars: Column, size: Column) -> Column:
    """Hashes of all pieces of ``size`` characters."""
    return F.transform(_starts(F.lit(1), F.size(chars) - size + 1), lambda i: F.xxhash64(size, F.array_join(F.slice(chars, i, size), "")))


def contained_passages(docs: DataFrame, doc_key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """(document, passage) pairs where the document contains the passage literally.

    A passage stands for the runs of four of its inner space-separated words, which must
    appear unchanged in any text that contains it; one too short for that, for its pieces of
    16, 8, 4, 2 or 1 characters, whichever is the longest it has.  Documents are unfolded
    once, into the hashes of their runs and of the pieces that some passage needs, and
    keep those that occur in a passage.  How many documents have a run is counted, each passage is
    looked up by the rarest of its runs only, and a run that many documents have is
    salted.  A passage with a run that no document has is out at once.  What meets is
    compared literally.  An empty passage is contained in nothing.
    """
    words, chars = F.split("p", " "), F.split("p", "")
    kind = F.when(F.size(words) >= RUN + 2, 0)
    for size in PIECES:
        kind = kind.when(F.length("p") >= size, size)
    sized = passages.select(F.col(passage_key).alias("k"), F.col(passage).alias("p")).where("p <> ''").withColumn("kind", kind)
    one = F.lit(1)
    own = F.when(F.col("kind") == 0, _word_runs(words, 2, F.size(words) - RUN)).otherwise(_pieces(chars, F.col("kind")))
    needed = materialise(sized.select("k", "p", "kind", F.explode(F.array_distinct(own)).alias("h")), "passage-runs")
    kinds = sorted(r.kind for r in needed.select("kind").distinct().collect())  # at most one more than PIECES
    split = docs.select(F.col(doc_key).alias("d"), F.split(text, " ").alias("w"), F.split(text, "").alias("c"))
    theirs = [_pieces(F.col("c"), F.lit(n)) if n else _word_runs(F.col("w"), 1, F.size("w") - RUN + 1) for n in kinds]
    every = F.array_distinct(F.concat(*theirs)) if theirs else F.array().cast("array<bigint>")
    held = materialise(split.select("d", F.explode(every).alias("h")).join(needed.select("h").distinct(), "h", "left_semi"), "passage-meets")
    counted = held.groupBy("h").agg(F.count(one).alias("n"))
    # a run that no document has is the rarest, and has nothing to meet
    rarest = needed.join(counted, "h", "left").groupBy("k", "p").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("r")).select("k", "p", "r.*")
    parts = F.ceil(F.col("n") / FREQUENT).cast("int")
    often = counted.where(F.col("n") > FREQUENT).select("h", parts.alias("parts"))  # no more than all rows over FREQUENT
    left = held.join(often, "h", "left").select("h", "d", F.pmod(F.xxhash64("d"), F.coalesce("parts", one)).cast("int").alias("salt"))
    right = rarest.where("n > 0").select("k", "p", "h", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    met = left.join(right, ["h", "salt"]).select("d", "k", "p").distinct()
    whole = docs.select(F.col(doc_key).alias("d"), F.col(text).alias("x"))
    return met.join(whole, "d").filter(F.contains("x", "p")).select(F.col("d").alias(doc_key), F.col("k").alias(passage_key))
