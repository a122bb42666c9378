"""Licence findings against the notices planted in the documents, and on damaged and unknown paragraphs."""

import pytest

from alertweft.llm import licences
from alertweft.llm.queries.op04_licences import op4_licences

NOTICES = {"GNU General Public License, version 3": "gpl", "CC BY-NC 4.0": "cc-by-nc", "Released under the MIT License": "mit",
           "Apache License, Version 2.0": "apache", "All rights reserved": "proprietary"}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    want = {r.doc_id: " ".join(sorted({f for n, f in NOTICES.items() if n in r.text}))
            for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = op4_licences(spark, folder).collect()
    got = {r.doc_id: r.families for r in rows}
    assert sum(bool(v) for v in want.values()) > 20 and got == want
    assert all((r.n_confirmed > 0) == (r.family is not None) for r in rows)


@pytest.fixture(scope="module")
def model():
    return licences.fit([b"The onsen erblest it hein ti inenan eranenes whou therouou thon the than.", b"Plain talk of rights and permission in the street."] * 40)


def find(model, text):
    return model.scan(text.encode(), {}, licences.checks())


def test_families_and_unknown(model):
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            found = find(model, t)
            assert found and found[0] == family and found[4], (family, t, found)
    assert find(model, "released   under the *MIT* license!")[0] == "mit"
    far = "lorem ipsum dolor " * 60 + "This work is licensed under the GNU General Public License, version 3. " + "sit amet " * 50
    assert find(model, far)[0] == "gpl" and find(model, far)[4]
    for t in ("", "entirely other words", "the driver showed her license at the border", "version 2.0 of the plan", "all the rights of man"):
        found = find(model, t)
        assert found is None or not found[4], (t, found)
    assert 0.25 <= model.temperature <= 8


def test_names():
    found = {f: [licences.names(t) for t in ts] for f, ts in licences.TEMPLATES.items()}
    assert found["gpl"][:2] == [[["gnu", "general", "public", "license"]]] * 2 and found["cc-by"] == [[["creative", "commons", "attribution"]], [["cc", "by"]]]
    assert found["bsd"][2:] == [[["bsd", "", "license"]], [["bsd", "license"]]] and found["apache"][0] == [["apache", "license"]] and found["mit"][2] == []
    for clauses in ("BSD License", "BSD 2-Clause License"):
        assert licences.named(["bsd", "", "license"], licences.words(f"the {clauses} here".encode()))
    assert not licences.named(["cc", "by"], ["cc", "by", "nc"]) and licences.named(["cc", "by"], ["under", "cc", "by", "3.0"])


#: none of them in the templates, the foreign licences trained on or those calibrated on
STRANGERS = [
    "Licensed under the European Union Public License, version 1.2.", "This work is licensed under the Artistic License 2.0.",
    "Distributed under the Boost Software License, Version 1.0.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Microsoft Public License.", "Licensed under the IBM Public License, version 1.0.", "Licensed under the Open Data Commons Attribution License.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.", "Released under the MIT No Attribution License.",
    "Licensed under the GNU Affero General Public License, version 3", "Eclipse Public License, Version 2.0", "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.",
    "This file is NOT licensed under the MIT License.", "It was never released under the BSD License.", "Not all rights reserved.",
]


@pytest.mark.parametrize("text", STRANGERS)
def test_other_licences_are_not_confirmed(model, text):
    for around in ("", "the onsen erblest it hein ti "):
        found = model.findings((around + text).encode(), {}, licences.checks())[1]
        assert not any(f[5] for f in found), found


def test_a_notice_beside_another_licence(model):
    both = "Licensed under the Eclipse Public License, Version 2.0. " + "the onsen erblest it hein " * 5 + "Released under the MIT License."
    found = model.findings(both.encode(), {}, licences.checks())[1]
    assert [f[1] for f in found if f[5]] == ["mit"] and not {"mpl", "gpl"} & {f[1] for f in found if f[5]}


def test_edge_rows(spark, docs_of):
    notice = "Licensed under CC BY-NC 4.0."
    docs = docs_of([(1, None), (2, ""), (3, "\n \n"), (None, notice), (4, notice), (4, notice), (5, "x y\n" * 40_000 + notice)])
    model = licences.train(docs)
    rows = licences.scan(docs, model).collect()
    got = sorted((r.doc_id or 0, r.n_paragraphs, [(f.paragraph, f.family) for f in r.findings]) for r in rows)
    assert got == [(0, 1, [(0, "cc-by-nc")]), (1, 0, []), (2, 0, []), (3, 0, []), (4, 1, [(0, "cc-by-nc")]), (4, 1, [(0, "cc-by-nc")]), (5, 40_001, [(40_000, "cc-by-nc")])]
    assert licences.scan(docs.limit(0), licences.train(docs.limit(0))).collect() == []
