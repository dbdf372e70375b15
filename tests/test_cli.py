import io
import json

import pytest

from factloom.__main__ import main


def test_documents_to_answers(spark, tmp_path, capsys):
    def run(*arguments):
        main([str(a) for a in arguments], spark)
        return [x for x in capsys.readouterr().out.splitlines() if x]

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("Marie Curie discovered Radium. Radium is a metal. The thing was odd.")
    (docs / "b.md").write_text("# Notes\n\nRobert Putnam wrote Bowling Alone. Marie Curie discovered Radium.")
    store = f"file://{tmp_path}/store"
    made = [json.loads(x) for x in run("drop", docs, store, "--reliability", "LIKELY_TRUE")]
    assert sorted((d["source"], d["num_facts"]) for d in made) == [("a", 2), ("b", 2)]
    assert run("drop", docs, store, "--reliability", "LIKELY_TRUE") == []
    assert json.loads(run("catalog", store)[0])["total_facts"] == 4
    assert {json.loads(x)["subject"] for x in run("catalog", store, "--source", "b")} == {"Robert Putnam", "Marie Curie"}
    assert json.loads(run("audit-store", store)[0])["duplicates"] == 1
    assert [json.loads(x)["proposed"] for x in run("lifecycle", "promote", store)] == ["VERIFIED"]
    assert run("lifecycle", "contradictions", store) == []
    assert len(run("graph-reason", "link", store)) == 1
    assert any("**Radium** is_a **metal**" in x for x in run("query-graph", store, "Marie Curie"))
    assert run("compile", store, f"file://{tmp_path}/c", "--format", "alpaca") == ["4"]
    assert run("distill", docs, f"file://{tmp_path}/o") == ["3"]
    assert json.loads(run("model-prep", f"file://{tmp_path}/o", f"file://{tmp_path}/p")[0]) == {"verdict": "kept", "count": 3}
    with pytest.raises(SystemExit):
        main(["odd"], spark)


def ask(prompt):
    """A back end for tests: one fact, whatever is asked."""
    return {"facts": [{"subject": "Cells", "predicate": "hold", "object": "DNA", "confidence": 0.9}]}


def tell(prompt):
    return ("Cells contain Mitochondria.", -0.1) if "'Cells'" in prompt else ("", 0.0)


def grid(model, domain):
    if domain == "bad":
        raise ValueError("no such domain")
    return 2


def deny(statement):
    return "Radium" not in statement


def test_other_commands(spark, tmp_path, capsys, monkeypatch):
    code = {}

    def run(*arguments):
        code["last"] = main([str(a) for a in arguments], spark)
        return [x for x in capsys.readouterr().out.splitlines() if x]

    here, docs, store = __name__, tmp_path / "docs", f"file://{tmp_path}/store"
    docs.mkdir()
    (docs / "a.txt").write_text("Marie Curie discovered Radium. Radium is a metal.")
    (docs / "b.txt").write_text("Marie Curie discovered Radium. Marie S. Curie won prizes.")
    gold = tmp_path / "gold.json"
    gold.write_text(json.dumps([{"text": "Marie Curie discovered Radium.", "facts": [{"subject": "Marie Curie", "predicate": "discovered", "object": "Radium"}]}]))
    assert any(x.startswith("f1") and x.endswith("1.0000") for x in run("eval", gold))
    made = [json.loads(x) for x in run("batch", docs, store)]
    assert made[-1]["items"] == 2 and made[-1]["dropped"] == 2 and made[-1]["errors"] == 0
    assert json.loads(run("batch", docs, store)[-1])["skipped"] == 2
    store = f"file://{tmp_path}/second"
    run("drop", docs, store)
    assert {json.loads(x)["source"].rsplit("-", 2)[1] for x in run("lifecycle", "reextract", store)} == {"reextract"}
    probes = f"file://{tmp_path}/probes"
    assert run("model-probe", "bio", probes, "--backend", f"{here}:ask", "--model", "m1", "--number", "2") == ["2"]
    assert run("model-probe", "bio", probes, "--backend", f"{here}:ask", "--model", "m2", "--number", "2") == ["4"]
    rows = [json.loads(x) for x in run("graveyard", f"file://{tmp_path}/grid", "--backend", f"{here}:grid", "--models", "m", "x-embed", "--domains", "good", "bad")]
    assert [r["status"] for r in rows[:-1]] == ["error: no such domain", "ok"] and rows[-1]["facts"] == 2
    rows = [json.loads(x) for x in run("graveyard", f"file://{tmp_path}/grid", "--backend", f"{here}:grid", "--models", "m", "--domains", "good")]
    assert rows[0]["status"] == "skipped"
    out = run("model-distill", probes, f"file://{tmp_path}/records", "--min-agreement", "2")
    assert out[0] == "1" and json.loads(out[1])["models"] == "m1,m2" and json.loads(out[2])["selected_facts"] == 1
    (tmp_path / "facts.json").write_text(json.dumps({"facts": [{"subject": "cells", "object": "dna"}, {"subject": "atoms", "object": "nuclei"}], "negative": []}))
    assert any("gates: passed" in x for x in run("model-eval", probes, tmp_path / "facts.json", "--ci")) and code["last"] == 0
    (tmp_path / "facts.json").write_text(json.dumps({"facts": [{"subject": "atoms", "object": "nuclei"}], "negative": []}))
    run("model-eval", probes, tmp_path / "facts.json", "--ci")
    assert code["last"] == 1
    assert run("graph-ingest", probes, f"file://{tmp_path}/graph") == ["1"]
    seen = [json.loads(x) for x in run("watch-daemon", docs, f"file://{tmp_path}/watch", "--once")]
    assert {r["state"] for r in seen} == {"PROCESSED"} and run("watch-daemon", docs, f"file://{tmp_path}/watch", "--once") == []
    assert json.loads(run("consensus", docs)[0])["agreement"] == 2
    assert {json.loads(x)["source"] for x in run("crawl", "Cells", f"file://{tmp_path}/crawl", "--backend", f"{here}:tell")} == {"crawler-cells"}
    assert len(run("critique", store, "--backend", f"{here}:deny")) >= 2
    assert int(run("compile-sft", store, f"file://{tmp_path}/sft", "--format", "sharegpt")[0]) >= 4
    monkeypatch.setattr("sys.stdin", io.StringIO('{"name": "list_tools"}\n\nnot json\n{"name": "graph_find_by_subject", "arguments": {"subject": "marie"}}\n'))
    answers = [json.loads(x) for x in run("serve-mcp", store)]
    assert [a["ok"] for a in answers] == [True, False, True] and answers[2]["result"]
    assert "canonical" in json.loads(run("resolve-entities", store)[0])
    assert int(run("compile-graph-instructions", store, f"file://{tmp_path}/ins")[0]) >= 0
    assert any("parent" in json.loads(x) for x in run("distill-ontology", store))
