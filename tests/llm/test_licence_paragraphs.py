"""Wrapped notices, and several families in one line or paragraph."""

import textwrap

import pytest

from alertweft.llm import licences

PLAIN = [b"The onsen erblest it hein ti inenan eranenes whou therouou thon the than.", b"Plain talk of rights and permission in the street."]


@pytest.fixture(scope="module")
def model():
    return licences.fit(PLAIN * 40)


def families(model, text):
    return {f[1] for f in model.findings(text.encode(), {}, licences.checks())[1] if f[5]}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_wrapped_notices(model, mark):
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            wrapped = "\n".join(mark + x for x in textwrap.wrap(t, 40))
            assert family in families(model, f"{mark}some file of the onsen\n{wrapped}\n{mark}the thon than"), (family, t)
    apart = "Permission is hereby granted, free of charge, to any person\n\nlicence of the street\n\nobtaining a copy of this plan"
    assert families(model, apart) == set()


def test_several_families(model):
    gap = " the onsen erblest it hein" * 30
    mit, gpl, bsd = licences.TEMPLATES["mit"][0], licences.TEMPLATES["gpl"][0], licences.TEMPLATES["bsd"][0]
    assert families(model, mit + gap + " " + gpl) == {"mit", "gpl"}
    assert families(model, mit + " the thon than " + gpl) == {"mit", "gpl"}
    assert families(model, "\n".join(textwrap.wrap(bsd + " the thon than " + gpl + gap + " " + mit, 60))) == {"bsd", "gpl", "mit"}
