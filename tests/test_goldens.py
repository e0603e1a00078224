"""Whole interchange files of known cases, byte for byte.

``TEXTLOOM_CASES`` names a folder with ``cases/<name>/`` and ``golden/<name>.json``; without it nothing is compared.
"""

import json
import os
from pathlib import Path

import pytest

from textloom.operators import collate, graph, render
from textloom.sources import witnesses

ROOT = Path(os.environ.get("TEXTLOOM_CASES", ""))
NAMES = sorted(p.stem for p in ROOT.glob("golden/*.json")) if os.environ.get("TEXTLOOM_CASES") else []


@pytest.mark.skipif(not NAMES, reason="TEXTLOOM_CASES isn't set")
@pytest.mark.parametrize("name", NAMES)
def test_interchange_equals_golden(spark, name):
    w, config, lexicon = witnesses.from_case(spark, str(ROOT / "cases" / name))
    made = render.interchange(w, collate.variations(w, config, lexicon), graph.variant_graph(w, config, lexicon)).collect()[0]["json"]
    assert render.pretty(made) + "\n" == (ROOT / "golden" / f"{name}.json").read_text(encoding="utf-8")


def test_pretty_form():
    assert render.pretty('{"b":[],"a":{"x":"1/2","l":[1]}}') == '{\n  "a" : {\n    "l" : [\n      1\n    ],\n    "x" : "1\\/2"\n  },\n  "b" : [\n\n  ]\n}'
    assert json.loads(render.pretty('{"a": "é\\u0001"}')) == {"a": "é\u0001"}
