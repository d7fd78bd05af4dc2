"""Item builders with canned replies."""

import json

import pytest

from quern.operators import builders
from quern.operators.generation import Reply

TEXT = "The buoy waits 30 seconds before a retry. Leases are stored in the ledger file. See Fig. 2."
OTHER = "The quay keeps 5 replicas of every record. Pilots sign the manifest."
CANDIDATES = "candidate_id string, document_id string, content string, title string, section string, start_char int, end_char int, document_id_b string, content_b string, title_b string, section_b string, start_char_b int, end_char_b int, term string"


def canned(reply):
    def call(system, user):
        if reply is None:
            raise RuntimeError("down")
        return Reply(json.dumps(reply), "m", 1, 1)

    return call


CASES = [
    ("simple_factual", {"question": "Where are the leases kept then?", "answer": "Leases are stored in the ledger file.", "sentence_ids": [2]}, None),
    ("simple_factual", {"question": "Where?", "answer": "x", "sentence_ids": [2]}, "question_length"),
    ("simple_factual", {"question": "Where are the leases kept then?", "answer": "ledger", "sentence_ids": [9]}, "invalid_sentence_ids"),
    ("simple_factual", None, "no_reply"),
    ("numerical", {"question": "How long is the pause of a marker?", "answer": "It waits 30 seconds.", "sentence_ids": [1]}, None),
    ("numerical", {"question": "How long is the pause of a marker?", "answer": "It waits long before a retry.", "sentence_ids": [1]}, "answer_has_no_number"),
    ("keyword_heavy", {"question": "What does the lease option do here?", "answer": "Leases are stored.", "sentence_ids": [2]}, "missing_required_term"),
    ("ambiguous", {"question": "How long does the buoy wait there?", "answer": "30 seconds before a retry", "sentence_ids": [1], "subject_terms": ["buoy"], "specific": "x"}, "ambiguous_question_names_subject"),
    ("adversarial", {"statement": "The buoy waits 30 seconds before a retry.", "sentence_ids": [1]}, None),
    ("adversarial", {"statement": "The buoy waits before a retry.", "sentence_ids": [1]}, "nothing_to_perturb"),
    ("multi_hop", {"question": "How do the two of them differ at all?", "answer": "The buoy waits seconds before a retry, the quay keeps replicas of a record.", "sentence_ids": [1], "sentence_ids_b": [1]}, None),
    ("multi_hop", {"question": "How do the two of them differ at all?", "answer": "The buoy waits seconds before a retry.", "sentence_ids": [1], "sentence_ids_b": [1]}, "answer_does_not_use_both_sources"),
    ("nonexistent_feature", {"question": "How do I use the warp drive here?"}, None),
    ("out_of_domain", {"question": "How do I bake bread at home today?"}, "missing_required_term"),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_build(spark, n):
    kind, reply, reason = CASES[n]
    row = ("c1", "d", TEXT, "T", None, 0, len(TEXT), "e", OTHER, "U", None, 0, len(OTHER), "warp drive")
    built = builders.build(spark.createDataFrame([row], CANDIDATES), kind, canned(reply))
    got = built.first()
    assert got["reason"] == reason
    if reason is None:
        for e in got["evidence"]:
            assert e["quote"] == {"d": TEXT, "e": OTHER}[e["document_id"]][e["start_char"] : e["end_char"]]
        assert builders.accepted(built).count() == 1
        if kind == "adversarial":
            assert "60 seconds" in got["question"] and got["notes"] == {"original": "30", "replacement": "60"}
    else:
        assert builders.accepted(built).count() == 0 and builders.rejections(built).first()["n"] == 1
