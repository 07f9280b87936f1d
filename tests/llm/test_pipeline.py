import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_simhash import brute_fingerprint, groups_of

D = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against what is true of its own input."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, D)
        docs = spark.createDataFrame(out.collect(), out.schema)
        after = docs.collect()
        seen[name] = (before, after)
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < len(after) <= len(before)
    before, after = seen["simhash_near_dedup"]
    rows = sorted(before)
    root = groups_of([brute_fingerprint(before[d].text) for d in rows])
    assert sorted(r.doc_id for r in after) == sorted({rows[g] for g in root})
    before, after = seen["decontamination"]
    bad = {r[0] for r in leaks([(d, r.text) for d, r in before.items()], items) if r[2]}  # every item has a window
    assert {r.doc_id for r in after} == set(before) - bad and not any(r[2] for r in leaks([(r.doc_id, r.text) for r in after], items))
    before, after = seen["pii_surrogates"]
    assert {r.doc_id for r in after} == set(before) and any(r.text != before[r.doc_id].text for r in after)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after} == set(before)


def test_run(spark):
    assert corpus_pipeline.run(spark, D).count() > 0


def test_a_passage_in_a_long_document(spark, tmp_path, prose):
    """The share of hit words is small, yet the passage must not stay; a short item found by chance removes nothing."""
    passage = prose(30, 900)
    spark.createDataFrame([(1, passage), (2, "alone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [prose(3000, 901) + " " + passage + " " + prose(3000, 902), prose(3000, 903) + " alone " + prose(3000, 904), prose(50, 905), "alone", None]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline._decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_input(spark, odd_docs, no_docs, tmp_path, prose, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns, and tables without rows."""
    run = dict(corpus_pipeline.STAGES)[stage]
    spark.createDataFrame([(1, prose(30, 2)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = run(spark, odd_docs, str(tmp_path))
    rows, before = out.collect(), odd_docs.collect()
    if stage == "best_fit_packing":
        assert {r.doc_id for r in rows} == {r.doc_id for r in before} and len(rows) >= len(before)
    else:
        assert out.columns == odd_docs.columns and 0 < len(rows) <= len(before)
        extra = [c for c in out.columns if c not in ("text", "n_chars")]
        assert {tuple(r[c] for c in extra) for r in rows} <= {tuple(r[c] for c in extra) for r in before}
    assert run(spark, no_docs, str(tmp_path)).count() == 0
    if stage == "quality_rules":
        assert all(r.text and len(r.text.split()) >= 10 for r in rows)
    if stage == "simhash_near_dedup":
        assert len(rows) == len({r.doc_id for r in rows}) and sum(not (r.text or "").split() for r in rows) == 1
    if stage == "decontamination":
        assert not any(prose(30, 2) in (r.text or "") for r in rows) and any(r.text is None for r in rows)
    if stage == "pii_surrogates":
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in before)
