"""Commands of the whole path: sync, evaluation, benchmark, profile files."""

import json

import pytest

from tessera import cli
from tessera.operators import acquisition, evaluation_run
from tests.test_sync_run import item, put

RESOURCES = "id long, title string, subtitle string, description string, tags array<string>, resource_type string, status string"


def said(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_sync_and_benchmark(spark, tmp_path, capsys):
    put(tmp_path, "tag:nlp", [[item(f"o/r{k}") for k in range(3)] + [item("o/x", "")]])
    (tmp_path / "details").mkdir()
    (tmp_path / "details" / "o__r0.json").write_text(json.dumps(item("o/r0", description="whole", license="MIT")))
    assert cli.main(["smoke", "--pages", str(tmp_path), "--source", "tag:nlp"]) == 0
    assert said(capsys) == [{"source": "tag:nlp", "count": 4, "valid": 3}]
    assert cli.main(["sync", "incremental", "--pages", str(tmp_path), "--source", "tag:nlp", "--state", f"{tmp_path}/s"]) == 0
    *events, totals = said(capsys)
    assert (totals["candidates"], totals["detail_requested"], totals["detail_failed"], totals["dry_run"]) == (3, 3, 2, False)
    assert "pass_stopped" in {e["event"] for e in events}
    assert cli.main(["acquisition-benchmark", "--pages", str(tmp_path), "--source", "tag:nlp", "--sample-size", "2", "--output", f"{tmp_path}/b.json"]) == 0
    told = json.loads((tmp_path / "b.json").read_text())
    assert [(s["method"], s["ref"], s["status"]) for s in told["samples"]][:2] == [("rest-concurrent", "o/r0", "ok"), ("rest-concurrent", "o/r1", "error")]
    assert told["recommended"] is None and {m["failed"] for m in told["methods"]} == {1}
    for bad in (["acquisition-benchmark", "--pages", "x", "--source", "tag:"], ["sync", "incremental", "--pages", "x", "--source", "tag:none", "--state", "y"]):
        with pytest.raises(SystemExit):
            cli.main(bad)
    for call in (lambda: acquisition.checked(["a"], ["other"], 1), lambda: acquisition.checked([" "], [], 1), lambda: acquisition.checked(["a"], [], 0), lambda: evaluation_run.checked_semantic(" -- ")):
        with pytest.raises(ValueError):
            call()


def test_evaluation(spark, tmp_path, capsys):
    docs = [(k, f"solar power {k}" if k % 2 else f"wind of {k}", None, "energy data", ["a"], "dataset", "active") for k in range(12)]
    spark.createDataFrame(docs, RESOURCES).write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([], "resource_id long, content_hash string, embedding array<float>, model_name string, model_revision string, embedding_dimension int").write.parquet(f"{tmp_path}/e0")
    cli.main(["backfill", "--resources", f"{tmp_path}/r", "--embeddings", f"{tmp_path}/e0", "--output", f"{tmp_path}/e"])
    queries = [{"query_id": f"q{k:02d}", "category": f"c{k % 6}", "raw_query": "x", "lexical_queries": ["solar", "wind"] if k % 2 else ["energy -solar"], "semantic_query": "solar power"} for k in range(24)]
    (tmp_path / "q.json").write_text(json.dumps(queries))
    run = ["hybrid-evaluate", "--queries", f"{tmp_path}/q.json", "--resources", f"{tmp_path}/r", "--embeddings", f"{tmp_path}/e", "--output", f"{tmp_path}/out.json"]
    assert cli.main(run) == 0
    told = json.loads((tmp_path / "out.json").read_text())
    assert len(told["rows"]) == 24 * 3 * 5 and set(told["timings"]) == {"keyword_ms", "semantic_ms", "fusion_ms", "total_ms"}
    told["rows"][0] |= {"relevance_label": "Relevant", "notes": "seen"}
    (tmp_path / "out.json").write_text(json.dumps(told))
    assert cli.main(run) == 0
    again = json.loads((tmp_path / "out.json").read_text())
    assert (again["rows"][0]["relevance_label"], again["rows"][0]["notes"]) == ("Relevant", "seen")
    capsys.readouterr()
    cli.main(["search-hybrid", "--resources", f"{tmp_path}/r", "--embeddings", f"{tmp_path}/e", "--lexical-query", "solar", "--semantic-query", "wind", "--limit", "2", "--include-timing"])
    assert "total_ms" in said(capsys)[-1]["timing"]


def test_profile_files(spark, tmp_path):
    spark.createDataFrame([("r", "T", "u", "# D")], "source_id string, title string, url string, description string").write.parquet(f"{tmp_path}/r")
    spark.createDataFrame([("r", 0, "a.csv", 4, b"a,b\n")], "ref string, position int, path string, size long, content binary").write.parquet(f"{tmp_path}/f")
    cli.main(["profile", "--resources", f"{tmp_path}/r", "--files", f"{tmp_path}/f", "--output", f"{tmp_path}/r.md", "--inspection-json", f"{tmp_path}/i"])
    assert (tmp_path / "r.md").read_text().startswith("---\nschema_version") and spark.read.json(f"{tmp_path}/i").count() == 1
