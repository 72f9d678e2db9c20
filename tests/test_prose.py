"""Each detector on short texts: a category is there, or not, or a number of times."""

from collections import Counter
from dataclasses import replace

import pytest

from prosemill.config import DEFAULT_RULES, Config
from prosemill.operators.prose import findings

FENCED = "```\ndelve\n```\nWe `utilize` it.\n\nWe will delve into details."
#: (text, category, number: None for any, 0 for none)
CASES = [
    ("This update stands as a testament to progress.", "puffery", 1),
    ("We will delve into the details tomorrow.", "buzzword", None),
    ("It is not just speed but also quality that matters.", "negative-parallel", None),
    ("However, we launched, and furthermore we iterated, and thus we shipped.", "connector-glut", None),
    ("we wrap up the change and just ship it tomorrow.", "*", 0),
    ("This covers everything from onboarding to retention to advocacy.", "weasel", None),
    ("Experts say the change improved results [1].", "weasel", 0),
    ("Experts say the change improved results.", "weasel", 1),
    ("Furthermore, we will ship the feature tomorrow.", "transition", None),
    ("This is a game-changing solution that unlocks the power of data.", "marketing", None),
    ("Intro sentence. Another sentence.\n\n- bullet one\n- bullet two\n\nConclusion sentence.", "sentence-length", 0),
    ("We utilized the system.", "buzzword", None),
    (FENCED, "buzzword", 1),
    ("---\ntitle: in conclusion\n---\nWe will leverage the system.", "buzzword", None),
    ("---\ntitle: in conclusion\n---\nWe will leverage the system.", "template", 0),
    ("See https://example.com/deep-dive for details. We ship tomorrow.", "buzzword", 0),
    ("See [notes](https://example.com/deep-dive). We ship tomorrow.", "buzzword", 0),
    ("As an AI language model, I cannot access external links.", "template", None),
    ("Subject: Quick update\n\nWe shipped the fix.", "template", None),
    ("We used a robust API v2 for RFC-1234.", "buzzword", 0),
    ("We used a robust, scalable API v2 for RFC-1234.", "buzzword", 2),
    ("Additionally, we shipped API v2.", "transition", 0),
    ("Additionally, in other words, we shipped API v2.", "transition", 2),
    ("95% of requests succeeded in the last window.", "confidence", 0),
    ("Our model hits 95% accuracy every time.", "confidence", 1),
    ("We hit 95% test coverage.", "confidence", 0),
    ("Our world-class tool leads benchmarks (Smith, 2024).", "confidence", 0),
    ("Our world-class tool leads benchmarks.", "confidence", 1),
    ("**One** **two** **three** **four** in one paragraph.", "formatting", None),
    ("- **One:** a\n- **Two:** b\n- **Three:** c\n", "formatting", None),
    ("- **One:** a\n- Two: b\n- **Three:** c\n", "formatting", 0),
    ("- ✅ Ship the fix\n- follow up", "formatting", None),
    ("This feels odd? it keeps going anyway.", "tone", None),
    ("Is this odd?", "tone", 0),
    ("<!-- lint:ignore-line -->\nAs an AI language model, I try.\nAs an AI language model, I try.", "template", 1),
    ("As an AI language model, I try. <!-- lint:ignore-line -->\nAs an AI language model, I try.", "template", 1),
    ("<!-- lint:ignore buzzword -->\nAdditionally, we will leverage the system.\n<!-- lint:end-ignore -->", "buzzword", 0),
    ("<!-- lint:ignore buzzword -->\nAdditionally, we will leverage the system.\n<!-- lint:end-ignore -->", "transition", 1),
    ("<!-- lint:off -->\nWe leverage it.\n<!-- lint:on -->\nWe leverage it.", "buzzword", 1),
    ("<!-- lint:off -->\nWe leverage it.", "buzzword", 0),
    ("We go. We run. We stop. Then home.", "cadence", 1),
    ("The same long sentence here. The same long sentence here. Other words.", "repetition", 1),
    ("Stop! Now! Please.", "tone", 1),
    ("Red, green, and blue.", "rule-of-three", 1),
    ("One — two — three.", "em-dash", 1),
    ("# Summary\n\nText.\n\n# Conclusion\n\nText.\n", "structure", None),
    ("#### Too deep\n", "structure", 1),
    ("# Why this matters?\n", "structure", 1),
    ("# All Words Are Capital\n", "formatting", 1),
    ("\n".join(f"- item {i}" for i in range(8)), "structure", 1),
    ("Try it free today.", "call-to-action", 1),
    ("It’s fine.", "quote-style", 1),
    ("", "*", 0),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)] + [(len(CASES), None)], "doc_id long, text string")
    out = {i: Counter() for i in range(len(CASES) + 1)}
    for r in findings(docs).collect():
        out[r["doc_id"]][r["category"]] += 1
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    text, category, n = CASES[i]
    got = sum(found[i].values()) if category == "*" else found[i][category]
    assert (got > 0) if n is None else (got == n), (text, dict(found[i]))


def test_null_text_has_no_findings(found):
    assert not found[len(CASES)]


def test_profile_rules(spark):
    rules = replace(DEFAULT_RULES, broad_terms=("solution", "mission"), required_patterns=("TODO",), forbidden_patterns=("secret",), max_headings=1, required_headings=("goal",), banned_headings=("^misc",), min_code_blocks=1, min_section_sentences=2)
    docs = spark.createDataFrame([(0, "The resolution passed. The permission check failed."), (1, "This solution will improve everything. A secret."), (2, "# Goal\n\nOne. Two. Three.\n\n# Misc\n\nOne.\n")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["detector"]) for r in findings(docs, Config(rules=rules)).collect())
    assert got[0, "D13"] == 0 and got[1, "D13"] == 1 and got[1, "D29"] == 1 and got[0, "D28"] == 1
    assert got[2, "D19f"] == 1 and got[2, "D19g"] == 0 and got[2, "D19h"] == 1 and got[2, "D27"] == 1 and got[2, "D25"] == 1 and got[1, "D19g"] == 1


def test_offsets_are_bytes(spark):
    docs = spark.createDataFrame([(0, "Été. Nous\nOur robust plan, robust.")], "doc_id long, text string")
    rows = sorted(findings(docs, detectors=["D3"]).collect(), key=lambda r: r["at"])
    text = "Été. Nous\nOur robust plan, robust.".encode()
    assert [text[r["at"] : r["to"]] for r in rows] == [b"robust", b"robust"]
    assert [(r["line"], r["column"]) for r in rows] == [(2, 5), (2, 18)]
