"""Registered queries against brute force: on the smallest tables, on a table of
edge cases, and on an empty table."""

import random

import brute
import pytest
from corpus_fixtures import edges, nothing, small, workers  # noqa: F401
from edge_cases import TURNS, edge_rows, edge_turns, prose

from seqlens.llm import queries

SF001 = "/root/testdata/sf0.001"
ITEMS = [(1, "one"), (2, None), (3, ""), (3, "river stone"), (None, "garden window"),
         (4, " ".join(prose(random.Random(5), 300).split()[40:60]))]
LABELS = [(6, 1, 0), (7, 1, 0), (10, 1, 1), (11, 0, 0), (None, 1, 0), (12, None, 0), (6, 0, 0)]


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture()
def folder(spark, edges, nothing, tmp_path):
    """Folders like the test tables: edge cases, and no rows."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    talks = spark.createDataFrame(edge_turns(), TURNS)

    def make(kind):
        for name, df in (("documents", edges if kind == "edges" else nothing), ("benchmark", items), ("labels", labels), ("conversations", talks)):
            df.where("true" if kind == "edges" else "false").coalesce(2).write.parquet(f"{tmp_path}/{kind}/{name}.parquet")
        return f"{tmp_path}/{kind}"

    return make


EDGES = [(r[0], r[1]) for r in edge_rows()]
#: query -> columns of the contract and their brute-force rows
WANT = {
    "op1_ngram_jaccard_join": (("doc_id", "n_shingles", "component_id"), lambda d, i: brute.jaccard_components(d)),
    "op2_benchmark_decontamination": ((), brute.contamination),
    "op3_quality_rules": (("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
                          lambda d, i: sorted(((k, *brute.quality_base(t)) for k, t in d), key=repr)),
    "op6_secret_scan": (("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), lambda d, i: secrets(d)),
    "op8_repeated_substrings": ((), lambda d, i: brute.repeated_bytes(d)),
}


def secrets(docs):
    out = []
    for d, t in docs:
        s = brute.secret_base(t)
        out.append((d, *(sum(x[1] == k for x in s) for k in range(3)), brute.sha(brute.joined(s, ["assign", "access", "hex"]))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(WANT))
def test_smallest_tables(spark, small, name):
    cols, want = WANT[name]
    assert rows(queries.QUERIES[name](spark, SF001), *cols) == want(*small)


@pytest.mark.parametrize("name", sorted(WANT))
def test_edge_cases(spark, folder, name):
    cols, want = WANT[name]
    assert rows(queries.QUERIES[name](spark, folder("edges")), *cols) == want(EDGES, ITEMS)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, folder("none")).collect() == []


@pytest.mark.parametrize("name", ["op4_source_mixing", "op5_token_counts", "op7_licence_scan", "op9_language_id", "op10_quality_classifier"])
def test_edge_cases_run(spark, folder, name):
    out = queries.QUERIES[name](spark, folder("edges")).collect()
    if name in ("op7_licence_scan", "op9_language_id", "op10_quality_classifier"):
        assert sorted((r.doc_id for r in out), key=repr) == sorted((d for d, _ in EDGES), key=repr)
    if name == "op7_licence_scan":
        assert {r.doc_id: r.licences for r in out if r.n_licences} == {19: "Apache-2.0"}
    if name == "op9_language_id":
        none = {d for d, t in EDGES if not any(c.isalpha() for c in t or "")}
        assert all((r.lang_pred == "und") == (r.doc_id in none) and 0 <= r.score <= 1 for r in out)
        assert all(r.score == 0 for r in out if r.lang_pred == "und")
    if name == "op10_quality_classifier":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_ops_carry_a_query_each():
    names = sorted(queries.QUERIES)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
