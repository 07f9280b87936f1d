"""Worked cases of single operators."""

import time
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocks, evaluation, fusion, keyword, stats, sync, sync_run, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- text


def test_normalize(spark):
    assert one(spark, T.normalize(F.lit("Ａ  \n　 B\x1f"))) == "A B"
    doc = T.semantic_document(F.lit("Ａ  \n B"), F.lit(" "), F.array(F.lit(" x "), F.lit(None), F.lit("ﬁ")), F.lit("d " * 1250))
    lines = one(spark, doc).split("\n")
    assert lines[:2] == ["title: A B", "tags: x, fi"] and len(lines[2]) == len("description: ") + 1200


@pytest.mark.parametrize(
    ("path", "fmt"),
    [("a.CSV", "csv"), ("a/b.db", "sqlite"), ("x.tar.gz", "archive"), (".csv", "unknown"), ("dir.csv/x", "unknown"), ("x.", "unknown"), ("a b.txt", "txt"), ("", "unknown"), (None, "unknown"), ("a..zip", "archive")],
)
def test_file_format(spark, path, fmt):
    assert one(spark, T.file_format(F.lit(path).cast("string"))) == fmt


def test_display(spark):
    assert one(spark, T.display(F.lit("a|b\\c\nd" + "x" * 10), 8)) == "a\\|b\\\\c↵dx…"
    assert one(spark, T.display(F.lit(""), 8)) == "(empty)"


# -- keyword search

DOCS = [
    (1, "solar power", "", "wind too", ["energy"], "dataset", "active"),
    (2, "wind", "solar", "solar solar", None, "dataset", "active"),
    (3, "other", None, "power of the sun and solar things", ["solar"], "notebook", "active"),
    (4, "solar power", None, None, [], "dataset", "deleted"),
]
SCHEMA = "id long, title string, subtitle string, description string, tags array<string>, resource_type string, status string"


@pytest.fixture(scope="module")
def resources(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def found(resources, query, rank="weights"):
    terms = keyword.query_terms(resources.sparkSession, [(0, query)])
    return {r.id: round(r.score, 6) for r in keyword.matches(keyword.Index.of(resources), terms, rank).collect()}


def test_weights(resources):
    assert found(resources, "solar") == {1: 1.0, 2: 0.8, 3: 0.6} == found(resources, "solar", "cover")
    assert found(resources, "SOLAR power") == {1: 2.0, 3: 0.8}
    assert found(resources, '"solar power"') == {1: 2.0, 3: 0.6}  # positions go on from tags to description
    assert found(resources, "solar -power") == {2: 0.8}
    assert found(resources, "energy or other") == {1: 0.4, 3: 1.0}
    assert found(resources, "-power") == {2: 0.0}
    assert found(resources, "nothing '; drop table") == {}


def test_cover_density(resources):
    # neighbours of weight 1; in the third, neighbours of weights 0.4 and 0.2, and two of 0.2 with four words between
    got = found(resources, "solar power", "cover")
    assert got == {1: 1.0, 3: round(2 / 7.5 + 0.2 / 5, 6)}


def test_keyword_search(resources):
    rows = keyword.keyword_search(resources, [" wind ", "solar", "wind"]).collect()
    assert [(r.id, r.matched_queries) for r in rows] == [(1, ["wind", "solar"]), (2, ["wind", "solar"]), (3, ["solar"])]
    assert [r.id for r in keyword.keyword_search(resources, ["solar"], "dataset", 1, 1).collect()] == [2]


@pytest.mark.parametrize("bad", [dict(queries=[]), dict(queries=["--"]), dict(queries=["a"], limit=0), dict(queries=["a"], limit=101), dict(queries=["a"], offset=-1), dict(queries=["a"], resource_type="")])
def test_bad_requests(resources, bad):
    with pytest.raises(ValueError):
        keyword.keyword_search(resources, **bad)


# -- vectors


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<float>")
    rows = vectors.semantic_top_k(v, q, 4).orderBy("rank").collect()
    assert [r.id for r in rows] == [1, 3, 2, 4] and rows[0].score == 1.0 and rows[3].score is None
    assert vectors.vector_literal([1 / 3, 2.0], 2) == "[0.333333333,2]"
    with pytest.raises(vectors.DimensionError):
        vectors.check_vector([1.0], 2)
    with pytest.raises(ValueError):
        vectors.check_vector([float("nan")], 1)


def test_backfill_is_incremental(spark, resources):
    backend = vectors.HashingBackend(8)
    empty = spark.createDataFrame([], "resource_id long, content_hash string, embedding array<float>, model_name string, model_revision string, embedding_dimension int")
    first = vectors.backfill(resources, empty, backend)
    assert {r.resource_id for r in first.collect()} == {1, 2}
    assert vectors.pending(resources, first).count() == 0
    changed = resources.withColumn("title", F.when(F.col("id") == 1, "new").otherwise(F.col("title")))
    assert [r.id for r in vectors.pending(changed, first).collect()] == [1]
    with pytest.raises(ValueError):
        vectors.ensure_model(first, ("other", "1", 8))


class Counting(vectors.HashingBackend):
    """Tells each document that it embeds in a file of a folder."""

    def __init__(self, folder):
        super().__init__(8)
        self.folder = folder

    def embed(self, documents):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text("\n".join(d.replace("\n", "|") for d in documents))
        return super().embed(documents)


def test_backfill_embeds_once(spark, resources, tmp_path):
    """Each changed document is embedded once, whatever is done with the table and its figures."""
    empty = spark.createDataFrame([], "resource_id long, content_hash string, embedding array<float>, model_name string, model_revision string, embedding_dimension int")
    before = sync_run.kept(vectors.backfill(resources, empty, vectors.HashingBackend(8)))
    changed = resources.withColumn("title", F.when(F.col("id") == 1, "new").otherwise(F.col("title")))
    done = vectors.run_backfill(changed, before, Counting(tmp_path), batch_size=1)
    assert done.table.count() == 2 and {r.resource_id for r in done.table.collect()} == {1, 2}
    told = done.stats().first()
    assert (told.total, told.embedded, told.skipped) == (2, 1, 1) and told.average_ms > 0
    assert len([*tmp_path.iterdir()]) == 1
    assert vectors.run_backfill(changed, done.table, Counting(tmp_path)).stats().first()[1:] == (0, 2, 0.0)
    assert vectors.run_backfill(changed, done.table, Counting(tmp_path), rebuild=True).stats().first()[:3] == (2, 2, 0)


def test_lsh_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = v.where("id % 100 = 0").selectExpr("id AS query_id", "embedding AS vector")
    exact = {(r.query_id, r.id) for r in vectors.semantic_top_k(v, q, 10).collect()}
    near = {(r.query_id, r.id) for r in vectors.approximate_top_k(v, q, 10, 64).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


# -- fusion


def ranked(spark, ids, score):
    return spark.createDataFrame([(0, i, k, 1.0) for k, i in enumerate(ids, 1)], f"query_id int, id long, rank int, {score} double")


@pytest.mark.parametrize(
    ("kw", "sem", "k", "order", "first"),
    [([2, 1], [3, 4], 60, [2, 3, 1, 4], 1 / 61), ([1, 2], [2], 60, [2, 1], 1 / 62 + 1 / 61), ([1, 1], [1, 1], 60, [1], 2 / 61), ([1], [], 10, [1], 1 / 11), ([1], [], 100, [1], 1 / 101)],
)
def test_fusion(spark, kw, sem, k, order, first):
    fused = fusion.reciprocal_rank_fusion(ranked(spark, kw, "keyword_score"), ranked(spark, sem, "semantic_score"), k)
    rows = fused.orderBy(*fusion.fused_order()).collect()
    assert [r.id for r in rows] == order and rows[0].hybrid_score == pytest.approx(first)


def test_fusion_bounds():
    for bad in ((0,), (60, 0), (60, 101)):
        with pytest.raises(ValueError):
            fusion.check_fusion(*bad)


# -- evaluation and statistics


def test_metrics(spark):
    rows = [("q", "keyword", 1, "a", None, 0), ("q", "keyword", 2, "b", "Relevant", 1), ("q", "semantic", 1, "c", "Relevant", 2), ("q", "hybrid", 1, "b", "Relevant", 3), ("q", "hybrid", 2, "c", "Relevant", 4)]
    df = spark.createDataFrame(rows, "query_id string, method string, rank int, resource_id string, relevance_label string, seq int")
    by = {r.method: r for r in evaluation.method_metrics(df.where("method <> 'semantic'")).collect()}
    assert by["keyword"].top_1_relevant_rate == 1.0 and by["hybrid"].top_5_relevant == 2 and by["semantic"].labelled_queries == 0
    assert tuple(evaluation.overlaps(df).first()) == (0, 1, 1, 1, 1)


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "v int")
    assert tuple(df.agg(stats.nearest_rank("v", 0.5), stats.nearest_rank("v", 0.95)).first()) == (20, 40)
    assert df.limit(0).agg(stats.nearest_rank("v", 0.5)).first()[0] is None


# -- sync

FIELDS = [("f", "string"), ("tags", "array<string>"), ("n", "bigint"), ("last_updated", "bigint")]


def folded(spark, rows):
    df = spark.createDataFrame([("r", i, *x) for i, x in enumerate(rows)], "ref string, seq int, f string, tags array<string>, n long, last_updated long")
    return tuple(sync.fold(df, "ref", "seq", FIELDS).first().record)


def test_fold_is_in_order(spark):
    assert folded(spark, [("old", [], 1, 1), ("", None, None, 3), ("mid", ["x"], 0, 2)]) == ("old", ["x"], 1, 3)
    assert folded(spark, [("a", ["t"], 5, None), ("b", [], 0, 1)]) == ("b", ["t"], 0, 1)


@pytest.mark.parametrize(("title", "term"), [("DATA-SCIENCE: Cheat—Sheets", "cheat sheets"), ("Rare Book Sales", None), ("jobless", None), ("My ＪＯＢ!", "job"), (None, None)])
def test_negative_terms(spark, title, term):
    assert one(spark, sync.negative_term(F.lit(title).cast("string"), F.lit(None).cast("string"))) == term


def test_retry_delay():
    assert sync.retry_delay(3, None) == 8 and sync.retry_delay(1, None, rate_limited=True) == 180 and sync.retry_delay(9, 1.5, rate_limited=True) == 1.5
    assert sync.retry_delay(1, -1.0) == 0


def day(n):
    return datetime(2024, 1, n)


RECORD = "source string, sort string, page int, seq int, ref string, title string, url string, subtitle string, tags array<string>, last_updated timestamp_ntz, current_version_number long, is_private boolean"


def page_rows(source, page, refs, when, sort="updated", tag=None):
    value = tag or source.split(":")[1]
    return [(source, sort, page, 1000 * page + k, ref, f"t {ref}", f"u/{ref}", None, [value], when, 1, False) for k, ref in enumerate(refs)]


def planned(spark, rows, mode, states=(), marks=(), limit=20):
    df = spark.createDataFrame(rows, RECORD)
    s = spark.createDataFrame(list(states), "ref string, last_updated timestamp_ntz, current_version_number long, detail_pending boolean")
    c = spark.createDataFrame(list(marks), "source string, sort string, status string, watermark timestamp_ntz")
    fields = [("title", "string"), ("tags", "array<string>"), ("last_updated", "timestamp_ntz"), ("current_version_number", "bigint")]
    found, passes = sync.plan_sync(df, s, c, mode, fields, limit)
    return {r.ref: r.hit_sources for r in found.collect()}, {(r.source, r.sort): (r.last_page, r.stop_reason, r.status, r.watermark) for r in passes.collect()}


def test_two_stale_pages_stop_a_pass(spark):
    known = [f"k{i}" for i in range(20)]
    rows = page_rows("tag:nlp", 1, known, day(2)) + page_rows("tag:nlp", 2, known, day(2)) + page_rows("tag:nlp", 3, ["new"] * 20, day(2))
    states = [(k, day(2), 1, True) for k in known]  # pending rows are no news
    found, passes = planned(spark, rows, "incremental", states, [("tag:nlp", "updated", "complete", day(3))])
    assert passes == {("tag:nlp", "updated"): (2, "two_stale_pages", "complete", day(3))} and "new" not in found
    _, passes = planned(spark, rows, "incremental", states, [("tag:nlp", "updated", "partial", day(3))])
    assert passes == {}  # no complete run, no watermark, no stale page, and no short one


def test_page_limit(spark):
    rows = page_rows("tag:nlp", 1, map(str, range(20)), day(1)) + page_rows("tag:nlp", 2, ["x"], day(1))
    rows += page_rows("tag:nlp", 1, map(str, range(20)), day(1), "votes")
    found, passes = planned(spark, rows, "bootstrap", limit=1)
    assert {p[2] for p in passes.values()} == {"partial"} and len(passes) == 2 and "x" not in found


def test_invalid_tag_page_keeps_what_was_before(spark):
    rows = page_rows("tag:nlp", 1, map(str, range(20)), day(1)) + page_rows("tag:nlp", 2, ["a", "b"], day(1), tag="nlp data")
    found, passes = planned(spark, rows, "incremental")
    assert len(found) == 20 and passes[("tag:nlp", "updated")][:3] == (1, "tag_exact_validation_failed", "invalid_source")


def test_suppressed_source_keeps_other_hits(spark):
    rows = page_rows("tag:nlp", 1, ["r"], day(1)) + page_rows(sync.FILTERED_SOURCE, 1, ["r", "s"], day(1))
    rows = [(*r[:5], "Salary data" if r[0] == sync.FILTERED_SOURCE and r[4] == "r" else r[5], *r[6:]) for r in rows]
    found, _ = planned(spark, rows, "incremental")
    assert found == {"r": ["tag:nlp"], "s": [sync.FILTERED_SOURCE]}


def test_details(spark):
    fields = [("title", "string"), ("last_updated", "bigint"), ("current_version_number", "bigint")]
    rec = "struct<title:string,last_updated:bigint,current_version_number:bigint>"
    found = spark.createDataFrame([("a", ("A", 1, 1)), ("b", ("B", 1, 1)), ("c", ("C", 1, 1)), ("d", ("D", 1, 1))], f"ref string, record {rec}")
    states = spark.createDataFrame([("a", 1, 1, False), ("b", 1, 1, True)], "ref string, last_updated long, current_version_number long, detail_pending boolean")
    details = spark.createDataFrame([("a", ("no", 2, 2), None), ("b", ("full", None, 2), None), ("c", None, "E: " + "x" * 2000)], f"ref string, detail {rec}, error string")
    got = {r.ref: (r.merged.title, r.requested, r.pending, r.detail_error and len(r.detail_error)) for r in sync.with_details(found, details, states, fields).collect()}
    assert got["a"] == ("A", False, False, None) and got["b"] == ("full", True, False, None)
    assert got["c"] == ("C", True, True, 1000) and got["d"][:3] == ("D", True, True)


@pytest.mark.parametrize("call", [lambda: sync.sorts_of("other"), lambda: sync.select_sources("tag:none")])
def test_bad_modes(call):
    with pytest.raises(ValueError):
        call()


def test_top_k_of_more_queries_than_a_block(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(20)], "id long, embedding array<float>")
    q = v.where("id < 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    expected = sorted(map(tuple, vectors.semantic_top_k(v, q, 3).collect()))
    assert len(expected) == 21 and sorted(map(tuple, vectors.semantic_top_k(v, q, 3, block=2).collect())) == expected


def test_cover_of_long_documents(spark):
    """Time in proportion to the words, and not to their square."""
    long = spark.createDataFrame([(1, "", None, "solar x power " * 20_000, None, "dataset", "active")], SCHEMA)
    began = time.perf_counter()
    assert found(long, "solar power", "cover") == {1: round(20_000 * 0.2 / 2 + 19_999 * 0.2, 6)}
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("query", ["solar power", '"solar power"', '"solar power of the"', "solar -power"])
def test_no_pair_is_shuffled(resources, query):
    """Matching deals postings out by document, and neither joins candidates to words nor gathers pairs by query."""
    terms = keyword.query_terms(resources.sparkSession, [(0, query)])
    plan = keyword.matches(keyword.Index.of(resources), terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "HashAggregate" not in plan and "clause" not in plan


def test_postings_stay_in_their_task(spark):
    """Nothing is shuffled to invert documents, and no stored index is sorted as a whole; tasks may cut batches anywhere."""
    docs = spark.createDataFrame([(k, "a b", "", f"w{k % 7} b b " * (k % 5), ["c"], "dataset", "active") for k in range(60)], SCHEMA)
    assert "Exchange" not in keyword.postings(docs)._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.lexeme): (r.places, r.score) for r in keyword.postings(docs).collect()}
    assert len(got) == 60 * 3 + 48 and got[1, "b"][0] == [1, 4, 5] and abs(got[1, "b"][1] - 1.4) < 1e-9 and got[1, "w1"][0] == [3]
    before = keyword.WORDS_AT_ONCE
    keyword.WORDS_AT_ONCE = 10
    try:
        batches = docs.selectExpr("id", "status", "resource_type", "split(title, ' ') AS title", "array('') AS subtitle", "tags", "split(description, ' ') AS description").toArrow().to_batches()
        small = {(r["id"], r["lexeme"]): (r["places"], r["score"]) for b in keyword._inverted(iter(batches)) for r in b.to_pylist()}
    finally:
        keyword.WORDS_AT_ONCE = before
    assert {k: len(v[0]) for k, v in small.items()} == {k: len(v[0]) for k, v in got.items()}


def test_few_postings_are_shuffled_for_words_matched(spark, resources):
    index = keyword.Index.of(resources)
    words = spark.createDataFrame([(0, 0, "wind"), (0, 1, "solar")], "query_id long, at int, lexeme string")
    out = keyword.words_matched(index, keyword.best_of_any(index, words, 2), words)
    assert {r.id: r.matched_queries for r in out.collect()} == {1: ["wind", "solar"], 2: ["wind", "solar"]}
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_parts_of_bounded_size(spark, monkeypatch):
    """A task's best are the same however small the parts are that it looks at at once, and a task tells k at most."""
    r = np.random.default_rng(2)
    ids = pa.array(r.permutation(500))
    scores = np.round(r.normal(size=(500, 9)), 1)
    scores[r.random(scores.shape) < 0.1] = np.nan
    told = r.random(scores.shape) < 0.5
    whole = pa.RecordBatch.from_arrays([ids, pa.array(np.arange(500))], ["id", "row"])
    got = {}
    for cells in (9, 90, 10_000):
        monkeypatch.setattr(blocks, "CELLS", cells)
        parts = [(scores[b["row"].to_numpy()], b["id"], told[b["row"].to_numpy()]) for b in blocks.slices(whole, 9)]
        assert max(x[0].size for x in parts) <= cells
        [out] = blocks.best_of_task(iter(parts), list("abcdefghi"), 7)
        got[cells] = out.to_pylist()
    rank = lambda q: sorted((i for i in range(500) if told[i, q]), key=lambda i: (np.inf if np.isnan(scores[i, q]) else -scores[i, q], ids[i].as_py()))[:7]
    assert [(x["query_id"], x["id"]) for x in got[9]] == [("abcdefghi"[q], ids[i].as_py()) for q in range(9) for i in rank(q)]
    assert str(got[9]) == str(got[90]) == str(got[10_000])


def test_approximate_pairs_are_not_shuffled(spark):
    """Buckets as they are joined give the same rows; the plan joins nothing."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8))
    v = spark.createDataFrame(list(enumerate(x.tolist())), "id long, embedding array<double>")
    q = v.where("id % 50 = 0").selectExpr("id AS query_id", "embedding AS vector")
    out = vectors.approximate_top_k(v, q, 5, 8, bits=6, tables=4)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    planes = np.random.default_rng(7).normal(size=(24, 8))
    own = ((x @ planes.T > 0).reshape(300, 4, 6) * (1 << np.arange(6))).sum(axis=2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = set()
    for k in range(0, 300, 50):
        near = [i for i in range(300) if (own[i] == own[k]).any()]
        expected |= {(k, i) for i in sorted(near, key=lambda i: -unit[i] @ unit[k])[:5]}
    assert {(r.query_id, r.id) for r in out.collect()} == expected


def test_python_normalises_what_is_not_ascii_alone(spark):
    """Python is sent null for ASCII texts."""
    rows = spark.createDataFrame([("plain",), ("ﬁ",), (None,)], "t string")
    plan = rows.select(T.nfkc(F.col("t")).alias("x"))
    assert [r.x for r in plan.collect()] == ["plain", "fi", None]
    assert "_nfkc(CASE WHEN" in plan._jdf.queryExecution().analyzed().toString()
