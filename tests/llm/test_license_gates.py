"""Every rule of the license scan is reached by texts that only it needs to match."""

import random
import re
from re import _parser

import pytest

from lectern.llm import licenses


def spelt(parsed, rng):
    """A random text that the parsed expression matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, inner = arg
            out += "".join(spelt(inner, rng) for _ in range(rng.randint(lo, min(int(hi), lo + 1))))
        elif name == "SUBPATTERN":
            out += spelt(arg[3], rng)
        elif name == "BRANCH":
            out += spelt(rng.choice(arg[1]), rng)
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else rng.choice("0123456789") if "DIGIT" in str(value) else "a"
        elif name != "ASSERT":
            raise ValueError(name)
    return out


def test_every_rule_passes_its_gates(spark):
    rng = random.Random(6)
    said = [(n, spelt(_parser.parse(rule[4]), rng).strip()) for n, rule in enumerate(licenses.rules()) for _ in range(12)]
    for n, text in said:
        label, *_, keys, pattern = licenses.rules()[n]
        assert re.search(pattern, f" {text} ", re.A), (pattern, text)
        assert any(k in f" {text} " for k in keys.split("|")), (label, keys, text)
    rows = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(said)], "doc_id long, text string").repartition(4)
    lost = [said[r["doc_id"]][1] for r in licenses.scan(rows).collect() if r["n_found"] == 0]
    assert not lost, lost[:10]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Creative Commons Attribution 4.0", "cc-by-4.0"), ("Creative Commons Zero 1.0", "cc0-1.0"), ("creative commons by-nc 4.0", "cc-by-nc-4.0"),
        ("distributed under MIT", "mit"), ("released under CeCILL 2.1", "cecill-2.1"), ("released under PHP 3.01", "php-3.01"),
        ("released under Berkeley Software Distribution", "bsd"), ("placed in the public-domain", "public-domain"),
        ("is in the public\ndomain", "public-domain"), ("may not be copied", "no-derivatives"),
    ],
)
def test_texts_without_the_old_fragments(spark, text, label):
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert label in row["labels"].split(",")
