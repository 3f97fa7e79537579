"""Every rule on a text where it fires and on one where it doesn't."""

import pytest
from cases import CASES

from treeloom.analysis import rules
from treeloom.parse import tables


@pytest.fixture(scope="module")
def found(spark):
    files = [(f"{k}/{side}.{ext}", body) for k, (_, ext, *both) in enumerate(CASES) for side, body in zip(("yes", "no"), both, strict=True)]
    files.append(("empty.rs", ""))
    nodes = tables.nodes(spark.createDataFrame(files, "path string, text string")).cache()
    hits = rules.analyse(nodes, rules.enabled([])).collect()
    nodes.unpersist()
    return {(r["path"], r["rule_id"]) for r in hits}


@pytest.mark.parametrize("k", range(len(CASES)), ids=lambda k: f"{CASES[k][0]}-{CASES[k][1]}")
def test_rule(found, k):
    id_, ext, *_ = CASES[k]
    assert (f"{k}/yes.{ext}", id_) in found
    assert (f"{k}/no.{ext}", id_) not in found


def test_all_rules_have_cases(found):
    assert len(rules.RULES) == 30
    assert {c[0] for c in CASES} == set(rules.RULES)
    assert not any(p == "empty.rs" for p, _ in found)


def test_enablement():
    assert len(rules.enabled()) == 24
    assert len(rules.enabled([])) == 30
    assert [r.id for r in rules.enabled(["god-struct"])] == ["god-struct"]
    with pytest.raises(ValueError, match="unknown"):
        rules.enabled(["no-such-rule"])
