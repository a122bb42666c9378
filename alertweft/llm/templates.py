"""Benchmark decontamination through templates.

A text is read as two token streams.  The literal stream has lower-cased words
with numbers and units replaced by typed placeholders; the named stream also
replaces capitalised words, so that a question whose names and figures were
changed still reads the same.  Windows of a stream are hash-joined with the
windows of the benchmark.  Along alignments of a document and an item that lie
close together the slot values must be consistent: one name of the item stands
for one name in the document, and the other way round; windows with a unit that
stands for two are left out, and numbers may coincide.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from alertweft.llm.common import sorted_groups, text_bytes, whole_row
from alertweft.session import materialise, ship

ship(__name__)

WINDOW = 8
#: items of fewer tokens are too short to tell a leak from chance
SHORTEST = 5
#: literal words a window needs
LITERALS = 4
#: share of an item's windows, or number of windows, that make a leak
SHARE, MANY = 0.5, 16
#: distance of two alignments that words put in or left out account for
NEARBY = WINDOW
#: number of the stream of whole items that have no window
WHOLE = 2

# fixed values: unit words that may follow a number
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes oz lb lbs pound pounds "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years percent degrees km/h mph kmh kb mb gb tb usd eur gbp dollar dollars euro euros cent cents"
).split()
# fixed values: number words
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

_DIGITS = b"0123456789"
_EDGE = b".,;:!?\"'()[]{}<>*#&%$|_=+~`^/\\-"
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?$")
_MEASURE = re.compile(r"([$€£]?[+-]?\d[\d.,]*)([^\W\d_]+)$")
_NAME, _NUM, _UNIT, _PLACE = 1, 2, 4, 7
_SEED = 9
_P = np.uint64(0x9E3779B97F4A7C15)
_BITS = 24
_PAGE = 15


_UNIT_WORDS, _NUMBER_WORDS = frozenset(u.encode() for u in UNITS), frozenset(n.encode() for n in NUMBERS)
#: marks in a text's codes: nothing there, and several codes for one word
_NONE, _MANY = 0, _NUM | _NAME


def _code(word: bytes) -> tuple[int, ...]:
    """Codes of one raw word: a 61-bit hash above three flag bits; none for bare punctuation."""
    core = word.strip(_EDGE)
    if core.isascii():
        low, capital = core.lower(), core[:1].isupper() and len(core) > 1 and not core.isupper()
    else:
        text = core.decode("utf-8", "ignore")
        low, capital = text.lower().encode(), text[:1].isupper() and len(text) > 1 and not text.isupper()
    if low in _NUMBER_WORDS:
        return (_NUM,)
    if word.translate(None, _DIGITS) != word:
        text = core.decode("utf-8", "ignore")
        if _NUMBER.match(text or word.decode("utf-8", "ignore")):
            return (_NUM,)
        if (m := _MEASURE.match(text.lower())) and m[2].encode() in _UNIT_WORDS:
            return (_NUM, _hash(m[2].encode()) | _UNIT)
    if not core:
        return ()
    return (_hash(low) | (_UNIT if low in _UNIT_WORDS else 0) | (_NAME if capital else 0),)


def _hash(low: bytes) -> int:
    return xxh64_intdigest(low, _SEED) & ~_PLACE


class Stream:
    """Codes of raw words, remembered between texts."""

    def __init__(self, most: int = 300_000):
        self.seen: dict[bytes, int] = {}
        self.many: dict[bytes, tuple[int, ...]] = {}
        self.most = most

    def _learn(self, word: bytes) -> int:
        found = _code(word)
        if len(found) > 1:
            self.many[word] = found
        code = self.seen[word] = found[0] if len(found) == 1 else _MANY if found else _NONE
        return code

    def read(self, text: bytes | None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(codes, raw words, word number of each code)."""
        words = (text or b"").split()
        seen, learn = self.seen, self._learn
        if len(seen) > self.most:
            seen.clear()
            self.many.clear()
        raw = np.array([c if (c := seen.get(w)) is not None else learn(w) for w in words], dtype=np.uint64)
        owner = np.flatnonzero(raw)
        codes = raw[owner]
        several = np.flatnonzero(codes == _MANY)
        if len(several):
            parts = [self.many[words[i]] for i in owner[several].tolist()]
            sizes = np.ones(len(codes), dtype=np.int64)
            sizes[several] = [len(x) for x in parts]
            starts = np.cumsum(sizes) - sizes
            codes, owner = np.repeat(codes, sizes), np.repeat(owner, sizes)
            for at, x in zip(starts[several].tolist(), parts):
                codes[at : at + len(x)] = x
        return codes, words, owner


def ends_sentence(words: list[bytes]) -> bool:
    """Whether one of the words closes a sentence or a heading."""
    return any(w.rstrip(b"\"')]}*_")[-1:] in (b".", b"!", b"?", b":", b";") for w in words)


def streams(codes: np.ndarray, text: np.ndarray | None = None, cut: Callable[[int], bool] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The literal and the named stream as (token, placeholder kind, place in codes).

    A unit is a placeholder right after a number only.  Runs of one placeholder
    are one token, up to a place where ``cut`` says that a sentence ends before a code.
    ``text`` numbers the text of each code where there are several.
    """
    kind = (codes & np.uint64(_PLACE)).astype(np.int64)
    token = codes & ~np.uint64(_PLACE)
    same = np.ones(max(0, len(codes) - 1), dtype=bool) if text is None else text[1:] == text[:-1]
    number = kind == _NUM
    unit = np.zeros(len(codes), dtype=bool)
    unit[1:] = number[:-1] & (kind[1:] & _UNIT > 0) & ~number[1:] & same
    out = []
    for named in (False, True):
        slot = np.where(number, _NUM, np.where(unit, _UNIT, np.where(named & (kind & _NAME > 0), _NAME, 0)))
        first = np.ones(len(codes), dtype=bool)
        first[1:] = (slot[1:] == 0) | (slot[1:] != slot[:-1]) | ~same
        if cut:
            for i in np.flatnonzero(~first).tolist():
                first[i] = cut(i)
        at = np.flatnonzero(first)
        slot = slot[at]
        out.append((np.where(slot > 0, slot.astype(np.uint64), token[at]), slot, at))
    return out


def window_hashes(token: np.ndarray, slot: np.ndarray, length: int, named: bool, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the windows with enough literal words; of the named stream those with a name only."""
    n = len(token) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[length:] - sums[:-length]

    good = count(slot == 0) >= min(LITERALS, length - 1)
    if named:
        good &= count(slot == _NAME) > 0
    if text is not None:
        good &= text[length - 1 :] == text[:n]
    total = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        total = (total ^ (total >> np.uint64(29))) * _P + token[k : k + n]
    total ^= total >> np.uint64(32)
    at = np.flatnonzero(good)
    return at, total[at]


def _slots(words: list[bytes], owner: np.ndarray, stream: tuple, start: int, length: int) -> list[str]:
    """Slot values of a window as offset:kind:edge:value, a run of words being one value; edge marks the ends of the text."""
    token, slot, at = stream
    out = []
    for k in np.flatnonzero(slot[start : start + length]).tolist():
        lo = at[start + k]
        hi = at[start + k + 1] if start + k + 1 < len(at) else len(owner)
        run = [words[w].strip(_EDGE).decode("utf-8", "ignore") for w in dict.fromkeys(owner[lo:hi].tolist())]
        edge = ("<" if start + k == 0 else "") + (">" if start + k == len(at) - 1 else "")
        out.append(f"{k}:{slot[start + k]}:{edge}:{' '.join(run)}")
    return out


_OUT = "key long, id long, stream int, at int, h long, slots array<string>"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays(
        [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["key", "id", "stream", "at", "h", "slots"])


def _scan(texts: DataFrame, short: list[int], bits=None, whole: list[int] = ()) -> DataFrame:
    """Windows of (key, id, text); with ``bits`` only those whose hash may be in the benchmark.

    Without ``bits`` the texts are benchmark items, and an item shorter than a window is one window.
    An item without any window is one run of its words as they are; ``whole`` has the lengths of such runs.
    """
    def exact(texts: list, found: list, lengths: list[int] | None) -> None:
        """Runs of plain words of the given lengths, or each text as one run."""
        for key, own, _, words, _ in texts:
            cores = [c for c in (w.strip(_EDGE).decode("utf-8", "ignore").lower().encode() for w in words) if c]
            token = np.array([xxh64_intdigest(c, _SEED) for c in cores], dtype=np.uint64)
            for length in [len(token)] if lengths is None else lengths:
                if length >= SHORTEST:
                    places, h = window_hashes(token, np.zeros(len(token), np.int64), length, False)
                    if bits is not None:
                        places, h = places[(keep := in_bits(h))], h[keep]
                    found += [(key, own, WHOLE, s, x, [str(length)]) for s, x in zip(places.tolist(), h.view(np.int64).tolist())]

    def in_bits(h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - _BITS)
        return bits.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0

    def together(texts: list, found: list) -> None:
        """Windows of several texts (key, id, codes, words, owner) in one go."""
        codes = np.concatenate([x[2] for x in texts])
        sizes = np.array([len(x[2]) for x in texts])
        text = np.repeat(np.arange(len(texts)), sizes)
        offset = np.cumsum(sizes) - sizes
        begun = len(found)

        def cut(i: int) -> bool:
            _, _, _, words, owner = texts[text[i]]
            own = i - offset[text[i]]
            return ends_sentence(words[owner[own - 1] : owner[own]])

        for named, (token, slot, at) in enumerate(streams(codes, text, cut)):
            owner_text = text[at]
            counts = np.bincount(owner_text, minlength=len(texts))
            start = np.cumsum(counts) - counts
            # an item shorter than a window is one window
            lengths = {WINDOW, *short} if bits is not None else {WINDOW, *(n for n in counts.tolist() if SHORTEST <= n < WINDOW)}
            for length in sorted(lengths):
                places, h = window_hashes(token, slot, length, bool(named), owner_text)
                if bits is not None:
                    keep = in_bits(h)
                elif length < WINDOW:
                    keep = counts[owner_text[places]] == length
                else:
                    keep = np.ones(len(places), dtype=bool)
                for s, x in zip(places[keep].tolist(), h[keep].view(np.int64).tolist()):
                    t = owner_text[s]
                    key, own, _, words, owner = texts[t]
                    lo, hi = start[t], start[t] + counts[t]
                    mine = (token[lo:hi], slot[lo:hi], at[lo:hi] - offset[t])
                    found.append((key, own, named, int(s - lo), x, _slots(words, owner, mine, int(s - lo), length)))
        if bits is None:
            seen = {f[0] for f in found[begun:]}
            exact([x for x in texts if x[0] not in seen], found, None)
        elif whole:
            exact(texts, found, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found, texts, waiting = Stream(), [], [], 0
        for batch in batches:
            for key, own, text in zip(*[c.to_pylist() for c in batch.columns]):
                codes, words, owner = reader.read(text)
                if len(codes):
                    texts.append((key, own, codes, words, owner))
                    waiting += len(codes)
                if waiting > 50_000:
                    together(texts, found)
                    texts, waiting = [], 0
                if len(found) > 20_000:
                    yield _rows(found)
                    found = []
        if texts:
            together(texts, found)
        yield _rows(found)

    return texts.mapInArrow(run, _OUT)


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit per slice of the hash space that a benchmark window falls into: 2 MB, whatever the benchmark."""
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << _BITS, dtype=bool)
        for batch in batches:
            own[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        sheets = own.reshape(-1, 1 << _PAGE)
        used = np.flatnonzero(sheets.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([np.packbits(sheets[i], bitorder="little").tobytes() for i in used], pa.binary())],
            names=["page", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in group.column("bits").to_pylist()])
        return pa.table({"page": group.column("page").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    parts = windows.select("h").mapInArrow(pages, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary")
    out = np.zeros(((1 << _BITS) >> _PAGE, (1 << _PAGE) // 8), dtype=np.uint8)
    for row in parts.collect():  # at most 512 pages of 4 kB
        out[row.page] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def text_key(id_col: str, text_col: str):
    """Key of a row by id and text, so that rows that share an id or have none are judged by their own text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def read_slots(item_at: int, item: list[str], doc: list[str]) -> list[tuple]:
    """(place in the item, kind, edge, item value, document value) of every slot of two windows that met.

    At an end of the item the document's run may go on; it counts by as many words
    as the item has.  Only such a slot keeps its edge, and it has no vote.
    """
    out = []
    for x, y in zip(item, doc):
        offset, kind, edge, mine = x.split(":", 3)
        theirs, n = y.split(":", 3)[3].split(" "), mine.count(" ") + 1
        edge = edge if len(theirs) > n else ""
        theirs = theirs[-n:] if edge == "<" else theirs[:n] if edge == ">" else theirs
        out.append((item_at + int(offset), int(kind), edge, mine, " ".join(theirs)))
    return out


def _consistent(windows: dict[int, list[tuple]]) -> dict[int, list[tuple]]:
    """The windows by place that agree on what stands for what; none if a name inside the item stands for two, or two for one."""
    votes: dict[tuple, Counter] = defaultdict(Counter)
    for place, kind, edge, mine, theirs in {s for slots in windows.values() for s in slots}:
        votes[kind, mine][theirs] += 0 if edge else 1
    chosen = {k: max(c, key=lambda v: (c[v], v)) for k, c in votes.items()}
    names = {k[1]: [v for v, n in c.items() if n] for k, c in votes.items() if k[0] == _NAME}
    used = [v for found in names.values() for v in found]
    if any(len(found) > 1 for found in names.values()) or len(used) > len(set(used)):
        return {}
    return {at: slots for at, slots in windows.items() if all(kind == _NUM or chosen[kind, mine] == theirs for _, kind, _, mine, theirs in slots)}


def judge(rows: list[tuple], windows: int) -> tuple[int, int, int] | None:
    """(matched, slots, changed) of the best alignment of a document and an item, None if there is no leak.

    ``rows`` has (shift, place in the item, slots), sorted.  Shifts at most NEARBY
    apart are tried together, a place of the item being taken from the shift with
    the most windows, and each by itself.
    """
    shifts: dict[int, dict[int, list[tuple]]] = defaultdict(dict)
    for shift, at, slots in rows:
        shifts[shift][at] = slots
    pools, last = [], None
    for shift in shifts:
        if last is None or shift - last > NEARBY:
            pools.append([])
        pools[-1].append(shift)
        last = shift
    tried = list(shifts.values())
    for pool in pools:
        if len(pool) > 1:
            together: dict[int, list[tuple]] = {}
            for shift in sorted(pool, key=lambda x: (len(shifts[x]), x)):
                together.update(shifts[shift])
            tried.append(together)
    best = None
    for found in tried:
        if len(found) < SHARE * windows and len(found) < MANY:
            continue
        kept = _consistent(found)
        if not kept or (len(kept) < SHARE * windows and len(kept) < MANY):
            continue
        slots = {(place, kind, mine, theirs) for s in kept.values() for place, kind, _, mine, theirs in s}
        changed = len({(kind, mine, theirs) for _, kind, mine, theirs in slots if mine != theirs})
        if best is None or (len(kept), -changed) > (best[0], -best[2]):
            best = (len(kept), len(slots), changed)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, id, item, matched, windows, coverage, n_slots, changed): documents that hold a benchmark item.

    ``matched`` of the item's ``windows`` meet along nearby alignments in one stream;
    ``changed`` counts slots whose value differs, so 0 is a verbatim leak.  A pair
    is a leak at half the item's windows or at sixteen.  An item without any window
    is a leak where all its words follow each other.  Null and empty texts
    match nothing, repeated rows each match, items below five tokens are not
    judged, and further columns are not read.  Long texts are read whole; without
    documents or items there are no rows.  Only a bitmap of fixed size is
    broadcast; windows that pass it are joined by hash.
    """
    spark = docs.sparkSession

    def texts(df: DataFrame, own: str, text: str) -> DataFrame:
        return df.select(text_key(own, text).alias("key"), F.col(own).cast("long").alias("id"), text_bytes(text).alias("text"))

    items = materialise(_scan(texts(benchmark, item_col, item_text_col), []).distinct(), "leak-items")
    single = items.groupBy("key", "stream").agg(F.max("at").alias("last")).where(f"last = 0 and stream < {WHOLE}")
    short = [] if single.isEmpty() else list(range(SHORTEST, WINDOW))
    bits = spark.sparkContext.broadcast(_bitmap(items))
    whole = sorted(int(r.n) for r in items.where(F.col("stream") == WHOLE).select(F.col("slots")[0].alias("n")).distinct().collect())
    hits = _scan(texts(docs, id_col, text_col), short, bits, whole).distinct()
    left = hits.select(F.col("key").alias("doc"), F.col("id").alias("doc_id"), "stream", F.col("at").alias("doc_at"), "h", F.col("slots").alias("doc_slots"))
    right = items.select(F.col("key").alias("item"), F.col("id").alias("item_id"), "stream", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"))
    met = left.join(right, ["h", "stream"]).where(F.size("doc_slots") == F.size("item_slots"))
    counts = items.groupBy(F.col("key").alias("item"), "stream").agg(F.countDistinct("at").cast("int").alias("windows"))
    placed = met.join(counts, ["item", "stream"]).withColumn("shift", F.col("doc_at") - F.col("item_at")).select(
        "doc", "doc_id", "item", "item_id", "stream", "shift", "item_at", "item_slots", "doc_slots", "windows"
    ).repartition("doc", "item", "stream").sortWithinPartitions("doc", "item", "stream", "shift", "item_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in sorted_groups(batches, ["doc", "item", "stream"]):
            doc, doc_id, item, item_id, stream, windows = (group.column(n)[0].as_py() for n in ("doc", "doc_id", "item", "item_id", "stream", "windows"))
            rows = [(0, 0, [])] if stream == WHOLE else [
                (shift, at, read_slots(at, a, b)) for shift, at, a, b in zip(*(group.column(n).to_pylist() for n in ("shift", "item_at", "item_slots", "doc_slots")))]
            if best := judge(rows, windows):
                out.append((doc, doc_id, item, item_id, best[0], windows, best[0] / windows, *best[1:]))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    kinds = {"doc": "long", "doc_id": "long", "item": "long", "item_id": "long", "matched": "long", "windows": "long", "coverage": "double", "n_slots": "int", "changed": "int"}
    names = list(kinds)
    arrow = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[k]) for n, k in kinds.items()])
    leak = placed.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    best = leak.groupBy("doc", "doc_id", "item", "item_id").agg(F.max(F.struct(
        "coverage", "matched", "windows", "n_slots", (-F.col("changed")).alias("same"))).alias("b"))
    return best.select(
        F.col("doc").alias("key"), F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col),
        "b.matched", "b.windows", "b.coverage", "b.n_slots", (-F.col("b.same")).alias("changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that hold a benchmark item; all columns and repeated rows stay as they are.

    Null and empty texts hold no item and stay, long texts are read whole, an empty table stays empty.
    """
    gone = leaks(docs, benchmark, id_col, text_col).select("key", F.col(id_col).alias("id")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), text_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, (rows["key"] == gone["key"]) & rows["id"].eqNullSafe(gone["id"]), "left_anti").select("row.*")
