"""Licence scans: a trained paragraph classifier, calibrated, and confirmed by templates.

Lines are judged by themselves and again together with their neighbours up to a
blank line, in overlapping spans where they are long.  Sparse word n-grams of
the licence templates are the features of a multinomial logistic regression over
licence families and the class "unknown".  It is trained on damaged copies of
the templates, on paragraphs of the corpus and on templates with their words out
of order, and, as unknown, on near misses: templates whose licence name was changed
and notices of licences of no family.  A temperature calibrates it, fitted on held-out cases
among which are whole licences that were not trained on.  A family is reported where it
is more likely than not, and confirmed where one of its templates is found in the
paragraph, the licence's name in full and not denied.  A paragraph that has the template
but not the name speaks of another licence and is reported as "other".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from alertweft.llm.common import text_bytes
from alertweft.llm.labelled import draw
from alertweft.session import ship

ship(__name__)

UNKNOWN, OTHER = "unknown", "other"
#: words of a span and from one span to the next
SPAN, HOP = 80, 40
#: corpus paragraphs that the unknown class is trained on at most, from so many sampled documents, so many each
DOCUMENTS, PARAGRAPHS = 2000, 3
#: damaged copies made of each template
COPIES = 40
#: probability a family needs, and share of a template's word pairs that confirms it
LIKELY, FOUND = 0.5, 0.6

# fixed values: customary licence notices by family
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
}

# fixed values: customary notices of licences of no family above, to train the unknown class on and to calibrate it
FOREIGN = [
    "This program is licensed under the GNU Affero General Public License, version 3.",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
]
FOREIGN_HELD_OUT = [
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.",
    "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
]
#: words that deny what follows them, and how many words on
_DENIALS, _DENIES = frozenset(("not", "never", "no", "isn't", "aren't", "cannot", "non")), 3
#: what may follow a name that does not end in "License"
_AFTER = frozenset(("license", "licence", "licensed", "international", "unported", "generic", "universal", "version", "v"))

_EDGE = b".,;:!?\"'()[]{}<>*#&%$|_=+~`^/\\"
#: words too common to be features by themselves
_PLAIN = frozenset("a all and any are as at be by can either for form forms free from in is it later may not of on or that the this to under use with work you".split())


def words(raw: bytes) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(_EDGE).decode("utf-8", "ignore").lower() for x in raw.split()) if w]


def grams(tokens: list[str]) -> set[str]:
    """Word n-grams for n up to three; no plain word alone."""
    out = {w for w in tokens if w not in _PLAIN}
    for n in (2, 3):
        out.update(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    return out


def spans(tokens: list) -> list[list]:
    if len(tokens) <= SPAN:
        return [tokens]
    return [tokens[i : i + SPAN] for i in range(0, len(tokens) - HOP, HOP)]


def pairs(tokens: list[str]) -> set[tuple[str, str]]:
    return set(zip(tokens, tokens[1:]))


def names(template: str) -> list[list[str]]:
    """The licence names in a template: capitalised words up to "License", or from "CC" on; versions are left out.

    A word that starts with a digit, such as a number of clauses, is an empty
    string: any such word, or none, may stand there.
    """
    out, run = [], []
    for raw in [*template.split(), "."]:
        word = raw.strip(_EDGE.decode())
        if word[:1].isupper() or (run and word[:1].isdigit()):
            run.append(word.lower() if word[:1].isupper() else "")
        if not (word[:1].isupper() or word[:1].isdigit()) or raw[-1] in ".,;:)":
            if "license" in run[1:]:
                out.append(run[: run.index("license", 1) + 1])
            elif run and run[0].startswith("cc"):
                out.append(run)
            run = []
    # a version inside a name ends it, as in those of Creative Commons; right behind the first word it is a number of clauses
    return [r[: r.index("")] if "" in r and (r.index("") > 1 or r[0].startswith("cc")) else r for r in out]


def named(name: list[str], tokens: list[str]) -> bool:
    """Whether the words of a name follow each other; nothing but a version or a plain word may extend it."""
    plain = [w for w in name if w]
    spot = name.index("") if "" in name else -1
    for i, word in enumerate(tokens):
        if word != plain[0]:
            continue
        part = tokens[i : i + len(plain) + 1]
        if spot > 0 and len(part) > spot and part[spot][:1].isdigit():
            part = part[:spot] + part[spot + 1 :]
        else:
            part = part[: len(plain)]
        if part != plain:
            continue
        after = tokens[i + len(plain)] if i + len(plain) < len(tokens) else ""
        if plain[-1] == "license" or not after or after[0].isdigit() or after in _PLAIN or after in _AFTER:
            return True
    return False


@dataclass
class Check:
    """What a paragraph is held against to confirm a template: its word pairs and the names in it."""

    pairs: set[tuple[str, str]]
    names: list[list[str]]


def checks() -> dict[str, list[Check]]:
    return {f: [Check(pairs(words(t.encode())), names(t)) for t in texts] for f, texts in TEMPLATES.items()}


@dataclass
class Model:
    """Feature numbers, weights (feature x class), class biases and the temperature."""

    names: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    classes: list[str]
    temperature: float

    def probabilities(self, found: set[str]) -> np.ndarray:
        at = [self.names[g] for g in found if g in self.names]
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def read(self, raw: bytes, seen: dict) -> tuple[list[str], bool]:
        """(words, whether one of them is a feature)."""
        tokens = []
        hit = False
        for x in raw.split():
            w = seen.get(x)
            if w is None:
                low = x.strip(_EDGE).decode("utf-8", "ignore").lower()
                low = low.strip("-") and low  # dashes alone are comment marks
                w = seen[x] = (low, low in self.names)
            if w[0]:
                tokens.append(w[0])
                hit = hit or w[1]
        return tokens, hit

    def judge(self, tokens: list[str], checks: dict[str, list[Check]]) -> list[tuple]:
        """(family, probability, template, similarity, confirmed, first word) of what a span names.

        The words of a confirmed notice are taken out and the rest is judged again, so
        a second notice in the span is found; where two notices share the probability
        each is judged without the words of the other.
        """
        def matched(family: str, have: list[tuple]) -> tuple[float, int, set]:
            found = set(have)
            similarity, number = max((len(t.pairs & found) / len(t.pairs), -i) for i, t in enumerate(checks[family]))
            return similarity, -number, checks[family][-number].pairs

        def place(template: set, have: list[tuple]) -> tuple[int, int]:
            """First word of the densest stretch of the template, and the word behind it."""
            runs: list[list[int]] = []
            for i in (i for i, pair in enumerate(have) if pair in template):
                if not runs or i - runs[-1][-1] > 4:
                    runs.append([])
                runs[-1].append(i)
            longest = max(runs, key=len, default=[0])
            return longest[0], longest[-1] + 2

        def without(template: set, have: list[tuple]) -> list[int]:
            lo, hi = place(template, have)
            return [i for i in range(len(have) + 1) if not lo <= i < hi]

        out, left = [], list(range(len(tokens)))
        while left:
            part = [tokens[i] for i in left]
            p, have = self.probabilities(grams(part)), list(zip(part, part[1:]))
            k = int(p.argmax())
            if self.classes[k] == UNKNOWN:
                break
            similarity, number, template = matched(self.classes[k], have)
            sure = float(p[k])
            if sure < LIKELY:
                rivals = [f for f in np.argsort(-p).tolist() if f != k and self.classes[f] != UNKNOWN and matched(self.classes[f], have)[0] >= FOUND]
                if similarity < FOUND or not rivals:
                    break
                rest = [part[i] for i in without(matched(self.classes[rivals[0]], have)[2], have)]
                sure = float(self.probabilities(grams(rest))[k])
                similarity = matched(self.classes[k], list(zip(rest, rest[1:])))[0]
                if sure < LIKELY or similarity < FOUND:
                    break
            first, family = place(template, have)[0], self.classes[k]
            full = all(named(n, part) for n in checks[family][number].names)
            denied = any(w in _DENIALS for w in part[max(0, first - _DENIES) : first])
            sound = similarity >= FOUND and full and not denied
            out.append((family if full or similarity < FOUND else OTHER, sure, number, similarity, sound, left[first]))
            if similarity < FOUND:
                break
            left = [left[i] for i in without(template, have)]
        return out

    def families(self, tokens: list[str], checks: dict[str, list[Check]], line: list[int] | None = None) -> list[tuple]:
        """The best finding of every family in a paragraph, confirmed before unconfirmed, then the likeliest.

        With ``line``, the line of each word, only spans over several lines are judged.
        """
        best: dict[str, tuple] = {}
        for n, part in enumerate(spans(tokens)):
            at = n * HOP
            if line and (line[at] == line[at + len(part) - 1] or not any(w in self.names for w in part)):
                continue
            for found in self.judge(part, checks):
                found = (*found[:5], at + found[5])
                if found[0] not in best or (found[4], found[1]) > (best[found[0]][4], best[found[0]][1]):
                    best[found[0]] = found
        return list(best.values())

    def scan(self, raw: bytes, seen: dict, checks: dict) -> tuple | None:
        """(family, probability, template, similarity, confirmed) of the surest family of a line, None if unknown.

        Without any feature the answer is that of the biases alone, which is "unknown" by construction.
        """
        tokens, hit = self.read(raw, seen)
        found = self.families(tokens, checks) if hit else []
        return max(found, key=lambda f: (f[4], f[1]))[:5] if found else None

    def findings(self, text: bytes | None, seen: dict, checks: dict) -> tuple[int, list[tuple]]:
        """(lines that are not blank, findings with the number of the line they begin in).

        Lines are judged by themselves, and once more together with their neighbours
        up to a blank line or an empty comment, for notices that are wrapped.
        """
        count, out, block = 0, [], []

        def close() -> None:
            if len(block) > 1 and any(b[2] for b in block):
                tokens, line = [w for b in block for w in b[1]], [b[0] for b in block for _ in b[1]]
                known = {f[1] for f in out if f[0] >= block[0][0] and f[5]}
                out.extend((line[f[5]], *f[:5]) for f in self.families(tokens, checks, line) if f[4] and f[0] not in known)
            block.clear()

        for raw in (text or b"").split(b"\n"):
            if not raw.strip():
                close()
                continue
            tokens, hit = self.read(raw, seen)
            if hit:
                out += [(count, *f[:5]) for f in sorted(self.families(tokens, checks))]
            if tokens:
                block.append((count, tokens, hit))
            else:
                close()
            count += 1
        close()
        return count, sorted(out, key=lambda f: f[0])


def damaged(tokens: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    """A copy of a template with words lost, words put in, and text around it."""
    out = [w for w in tokens if rng.random() > rng.choice([0, 0.05, 0.15])] or tokens
    if filler:
        for _ in range(rng.integers(0, 3)):
            out.insert(rng.integers(0, len(out) + 1), str(rng.choice(filler)))
        lead = [str(w) for w in rng.choice(filler, size=rng.integers(0, 25))]
        tail = [str(w) for w in rng.choice(filler, size=rng.integers(0, 25))]
        out = lead + out + tail
    return out


def near_miss(template: str, filler: list[str], rng: np.random.Generator) -> list[str]:
    """A template whose licence name is another one: a word replaced, put in or joined on; without a name, denied."""
    tokens, found = words(template.encode()), [n for n in names(template) if named(n, words(template.encode()))]
    strange = str(rng.choice(filler or ["strange"]))
    if not found:
        return ["not", *tokens]
    name = [w for w in found[rng.integers(len(found))] if w]
    start = next(i for i in range(len(tokens)) if tokens[i] == name[0])
    # the last word of a longer name is "license"; what tells licences apart stands before it
    at = start + int(rng.integers(max(1, len(name) - 1 if name[-1] == "license" else len(name))))
    how = rng.integers(3)
    changed = [[strange], [tokens[at], strange], [f"{tokens[at]}-{strange}"]][how]
    return tokens[:at] + changed + tokens[at + 1 :]


def fit(corpus: list[bytes], seed: int = 5, epochs: int = 60) -> Model:
    """Train on damaged templates against corpus paragraphs and shuffled templates."""
    rng = np.random.default_rng(seed)
    classes = sorted(TEMPLATES) + [UNKNOWN]
    tokens = {f: [words(t.encode()) for t in texts] for f, texts in TEMPLATES.items()}
    features = {g: i for i, g in enumerate(sorted({g for ts in tokens.values() for t in ts for g in grams(t)}))}
    own = {pair for ts in tokens.values() for t in ts for pair in pairs(t) if not set(pair) <= _PLAIN}
    plain = [p for p in (words(c) for c in corpus) if p and not pairs(p) & own]
    filler = sorted({w for p in plain for w in p[:20]})[:4000]
    cases: list[tuple[set[str], int]] = []
    for k, family in enumerate(classes[:-1]):
        for t in tokens[family]:
            cases += [(grams(damaged(t, filler, rng)), k) for _ in range(COPIES)] + [(grams(t), k)] * 4
            for _ in range(COPIES // 4):  # the same words in another order say nothing
                cases.append((grams([str(w) for w in rng.permutation([*t, *[str(x) for x in rng.choice(filler or ["x"], 20)]])]), len(classes) - 1))
        for t in TEMPLATES[family]:
            for _ in range(COPIES // 4):
                cases.append((grams(damaged(near_miss(t, filler, rng), filler, rng)), len(classes) - 1))
    cases += [(grams(damaged(words(t.encode()), filler, rng)), len(classes) - 1) for t in FOREIGN for _ in range(COPIES)]
    cases += [(grams(p[:SPAN]), len(classes) - 1) for p in plain] + [(set(), len(classes) - 1)] * 20
    cases = [cases[i] for i in rng.permutation(len(cases))]
    kept = len(cases) - len(cases) // 5
    cases += [(grams(damaged(words(t.encode()), filler, rng)), len(classes) - 1) for t in FOREIGN_HELD_OUT for _ in range(COPIES // 4)]
    x, y = np.zeros((len(cases), len(features)), dtype=np.float32), np.array([c[1] for c in cases])
    for row, (found, _) in enumerate(cases):
        x[row, [features[g] for g in found if g in features]] = 1
    w, b, first, second, step = np.zeros((len(features), len(classes))), np.zeros(len(classes)), 0.0, 0.0, 0
    b[-1] = 1.0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(kept), max(1, kept // 256)):
            z = x[at] @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            grad = np.vstack([x[at].T @ p / len(at) + 1e-4 * w, p.mean(axis=0)])
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            move = 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
            b[-1] = max(b[-1], b[:-1].max() + 1)  # without any feature the answer is to be "unknown"
    z = x[kept:] @ w + b

    def loss(t: float) -> float:
        s = z / t
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(s)), y[kept:]]).mean())

    temperature = min(np.geomspace(0.25, 8, 41).tolist(), key=loss)
    return Model(features, w.astype(np.float32), b.astype(np.float32), classes, temperature)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, each: int = PARAGRAPHS) -> Model:
    """Fit with at most about ``documents`` times ``each`` paragraphs of the corpus, cut to SPAN words in the tasks."""
    rows = draw(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), documents, F.col("id"), salt=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                lines = [x for x in (text or b"").split(b"\n") if x.strip()]
                out += [b" ".join(x.split()[:SPAN]) for x in lines[:: max(1, len(lines) // each)][:each]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["p"])

    found = rows.select(text_bytes().alias("text")).mapInArrow(run, "p binary").collect()
    return fit(sorted(bytes(r.p) for r in found))


FINDING = T.StructType([
    T.StructField("paragraph", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()),
    T.StructField("template", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("confirmed", T.BooleanType()),
])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_paragraphs, findings) of every row; findings are the licences by the line they begin in, in order.

    Every line of the whole text is read; ``n_paragraphs`` counts those that are not blank.  Null and empty texts have no
    paragraphs; repeated rows answer alike; other columns are not read; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("n_paragraphs", T.IntegerType()), T.StructField("findings", T.ArrayType(FINDING))])
    arrow = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()),
                                ("template", pa.int32()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = checks()
        seen: dict[bytes, tuple[str, bool]] = {}
        for batch in batches:
            counts, out = [], []
            for text in batch.column(1).to_pylist():
                if len(seen) > 500_000:
                    seen.clear()
                count, found = model.findings(text, seen, known)
                out.append([dict(zip(FINDING.names, f)) for f in found])
                counts.append(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int32()), pa.array(out, arrow)], names=["id", "n_paragraphs", "findings"])

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
