"""The pipeline, stage by stage, against brute force."""

import brute
import pytest
from corpus_fixtures import edges, nothing, small, workers  # noqa: F401

import corpus_pipeline as P
from seqlens.llm import queries, quality_rules, secret_scan

SF001 = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_stages_and_registration():
    assert [name for name, _ in P.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "source_mixing"]
    assert queries.QUERIES["pipeline"] is P.run and P.ORACLE_SQL is None


def test_every_stage_by_brute_force(spark, small, tmp_path):
    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns

    def step(name, df):
        stages[name](spark, df, SF001).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "source_mixing" or out.columns == columns
        return out

    one = step("quality_rules", docs)
    measured = {r.doc_id: r.kept for r in quality_rules.op3_quality_rules(spark, SF001).collect()}
    assert all(measured[d] is False for d, t in small[0] if brute.quality_base(t)[-1])
    assert rows(one) == sorted((r for r in rows(docs) if measured[r[0]]), key=repr)

    two = step("ngram_jaccard_join", one)
    groups = brute.jaccard_components(rows(one, "doc_id", "text"), 5, 4, 5)
    assert rows(two) == sorted((r for r in rows(one) if r[0] in {c for _, _, c in groups}), key=repr)

    three = step("benchmark_decontamination", two)
    dirty = {r[0] for r in brute.contamination(rows(two, "doc_id", "text"), small[1]) if r[-1]}
    assert dirty and rows(three) == sorted((r for r in rows(two) if r[0] not in dirty), key=repr)

    four = step("secret_scan", three)
    spans = {r.doc_id: [(s.start, s.end) for s in r.secrets] for r in secret_scan.secret_spans(three).collect()}
    for before, after in zip(three.orderBy("doc_id").collect(), four.orderBy("doc_id").collect()):
        want, at = "", 0
        assert {(a, b) for a, _, b in brute.secret_base(before.text)} <= set(spans[before.doc_id])
        for a, b in spans[before.doc_id]:
            if a >= at:
                want += before.text[at:a] + "<secret>"
            at = max(at, b)
        want += before.text[at:]
        assert after.text == want and after.n_chars == len(want)
        assert (after.doc_id, after.lang, after.source) == (before.doc_id, before.lang, before.source)

    five = step("source_mixing", four)
    assert set(columns) < set(five.columns)
    assert set(rows(five, *columns)) <= set(rows(four))
    assert rows(P.run(spark, SF001)) == rows(five)


def test_edge_cases_pass_through_every_stage(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(1, "river stone"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES:
        out, none = stage(spark, edges, str(tmp_path)), stage(spark, nothing, str(tmp_path))
        assert none.collect() == [] and set(edges.columns) <= set(out.columns)
        got = out.count()
        assert 0 < got <= (edges.count() if name != "source_mixing" else 5 * edges.count())
    kept = rows(P.ngram_jaccard_join(spark, edges, str(tmp_path)), "doc_id", "text")
    assert len(kept) == len(set(kept))  # repeated rows once
    ids = [d for d, _ in kept]
    assert 6 in ids and not {7, 8, 21} & set(ids)  # copies, near copies, another case
    assert {1, 2, 3, 13} <= set(ids)  # without words, or alone


def test_near_duplicates_with_text_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([("doc-b", text), ("doc-a", text + " more"), (None, text), ("x", "alone here"), (None, None)], "doc_id string, text string")
    assert rows(P.ngram_jaccard_join(spark, docs, "")) == sorted([("doc-a", text + " more"), ("x", "alone here"), (None, None)], key=repr)


@pytest.mark.parametrize("name", ["quality_rules", "benchmark_decontamination", "secret_scan"])
def test_stages_do_not_shuffle_texts_without_need(spark, name):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = dict(P.STAGES)[name](spark, docs, SF001)._jdf.queryExecution().executedPlan().toString()
    assert name == "secret_scan" or "Exchange" not in plan
