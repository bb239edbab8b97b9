from __future__ import annotations

import pytest

from mirrorkit.functions.settings import rule_fingerprint
from mirrorkit.spec import MirrorSpec, specs_frame


@pytest.mark.parametrize("rules,problem", [
    ({"mirror": ""}, "name must be"),
    ({"mirror": "a b"}, "name must be"),
    ({"seed": "sometimes"}, "seed must be"),
    ({"propagate": True}, "propagate requires"),
    ({"keyword_replacement": ""}, "keyword_replacement"),
    ({"keyword_replacement": "__"}, "keyword_replacement"),
    ({"keyword_replacement": "$"}, "keyword_replacement"),
    ({"archive_on": True, "archive_folder": "INBOX"}, "bucket names"),
    ({"sent_on": True, "sent_folder": "INBOX"}, "bucket names"),
    ({"sent_on": True, "archive_on": True, "sent_folder": "X", "archive_folder": "X"}, "bucket names"),
    ({"uid_batch": 0}, "uid_batch"),
    ({"poll_seconds": 0}, "intervals"),
])
def test_refused(rules, problem):
    with pytest.raises(ValueError, match=problem):
        MirrorSpec(**{"mirror": "m", **rules})


def test_defaults():
    spec = MirrorSpec("m")
    assert (spec.uid_batch, spec.seed, spec.dest_guard, spec.carry_seen) == (2000, "empty", True, True)
    assert spec.poll_seconds == 900 and spec.trigger_seconds() == 900
    assert spec.buckets() == ["INBOX"]
    both = MirrorSpec("m", archive_on=True, sent_on=True)
    assert both.buckets() == ["INBOX", "Sent", "Archive"]
    # A bucket that is switched off may have any name.
    MirrorSpec("m", archive_folder="INBOX")


def test_frame(spark):
    with pytest.raises(ValueError, match="duplicate"):
        specs_frame(spark, [MirrorSpec("m"), MirrorSpec("m")])
    with pytest.raises(ValueError, match="at least one"):
        specs_frame(spark, [])
    df = specs_frame(spark, [MirrorSpec("m", label_exclude=("a", "b"))])
    assert df.first()["label_exclude"] == ["a", "b"]


def test_fingerprint_follows_placement_settings_only(spark):
    def of(**rules):
        return specs_frame(spark, [MirrorSpec("m", **rules)]).select(rule_fingerprint()).first()[0]

    base = of(labels_on=True)
    for changed in ({"archive_on": True}, {"keyword_prefix": "$"}, {"propagate": True}, {"inbox": "x"}, {"dest_folder": "x"}):
        assert of(**{"labels_on": True, **changed}) != base
    for kept in ({"uid_batch": 5}, {"poll_seconds": 5}, {"dest_guard": False}):
        assert of(**{"labels_on": True, **kept}) == base
