"""Judges with injected transports."""
import json

import pytest

from tesserae import judges as J
from tesserae.errors import JudgeError
from tesserae.functions.gates import REASONS

FINE = {"durable": True, "transient": False, "duplicate": False, "appropriateAudience": True, "sensitive": False, "category": "fact", "importance": 3.6, "supersedes": [1, 7, True]}
ASKED = {"fact": "The depot opens at six.", "reason": None, "audience": "organization", "related": [{"id": "a", "content": "x"}, {"id": "b", "content": "y"}]}


def gate(answer, status=200, seen=None):
    def send(url, body, headers, timeout):
        if seen is not None:
            seen.append((url, body, headers, timeout))
        return status, json.dumps({"choices": [{"message": {"content": answer if isinstance(answer, str) else json.dumps(answer)}}]}).encode()

    return J.ChatGate("http://h/v1/", "m", api_key="k", send=send)


def test_chat_gate():
    seen = []
    assert gate(FINE, seen=seen)(ASKED) == {"accept": True, "reasons": [], "category": "fact", "importance": 4, "supersedes": ["b"]}
    url, body, headers, timeout = seen[0]
    assert url == "http://h/v1/chat/completions" and headers["authorization"] == "Bearer k" and timeout == 30
    assert body["response_format"]["json_schema"]["strict"] and json.loads(body["messages"][1]["content"])["related"] == ["x", "y"]
    assert gate(FINE | {"durable": False, "sensitive": True})(ASKED) == {"accept": False, "reasons": ["durable", "sensitive"]}
    assert gate(FINE | {"category": "none", "importance": 99, "supersedes": None})(ASKED) == {"accept": True, "reasons": [], "importance": 5}
    for bad in ("no json", "[]", "null", {k: v for k, v in FINE.items() if k != "durable"}, FINE | {"transient": "false"}, FINE | {"duplicate": 0}):
        assert gate(bad)(ASKED) == {"accept": False, "reasons": ["invalid-evaluation"]}
    assert J.ChatGate.read(b"<html>", ASKED)["reasons"] == ["invalid-evaluation"]
    with pytest.raises(JudgeError, match="HTTP 500") as e:
        gate(FINE, status=500)(ASKED)
    assert ASKED["fact"] not in str(e.value)

    def broken(*a):
        raise OSError("The depot opens at six.")

    with pytest.raises(JudgeError) as e:
        J.ChatGate("http://h", "m", send=broken)(ASKED)
    assert ASKED["fact"] not in str(e.value)


def test_scored_gate():
    likely = dict(zip(REASONS, (0.5, 0.49, 0.0, 0.9, 0.1)))
    assert J.ScoredGate(lambda p: likely | {"supersedes": {"a": 0.8, "b": 0.79, "z": 1.0}, "importance": 0})(ASKED) == {"accept": True, "reasons": [], "importance": 1, "supersedes": ["a"]}
    assert J.ScoredGate(lambda p: likely | {"transient": 0.5})(ASKED)["reasons"] == ["transient"]
    for bad in (float("nan"), float("inf"), None, "0.9", True):
        assert J.ScoredGate(lambda p, bad=bad: likely | {"sensitive": bad})(ASKED)["reasons"] == ["invalid-evaluation"]


def test_pair_judges():
    assert J.diff_judge(lambda new, old: {"x": "refines", "y": "whatever"}[old])("n", ASKED["related"]) == {"a": "refines"}
    got = J.causal_judge(lambda new, old: ("existing_causes_new", None if old == "x" else 0.25))("n", ASKED["related"])
    assert got == {"a": {"relation": "existing_causes_new", "weight": 1.0}, "b": {"relation": "existing_causes_new", "weight": 0.25}}


def test_with_memory():
    class Memory:
        propose = forget = turn_recall = staticmethod(lambda *a: "done")

    agent = J.with_memory({"name": "x", "instructions": "Be brief.", "tools": {"sum": sum}}, Memory())
    assert set(agent["tools"]) == {"sum", "remember", "forget", "recall"} and agent["instructions"].startswith("Be brief.\n\n")
    with pytest.raises(ValueError, match="forget"):
        J.with_memory({"tools": {"forget": None}}, Memory())
