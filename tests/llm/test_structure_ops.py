"""Conversation repair, BPE encoding and Merkle manifests against brute force."""

import random

import brute
import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from corpus_fixtures import workers  # noqa: F401
from edge_cases import EDGE_TEXTS, SCHEMA, TURNS, edge_rows, edge_turns
from pyspark.sql import functions as F

from seqlens.llm import bpe_codec, conversation_repair, merkle_manifest

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


# --- conversation repair ----------------------------------------------------------------

REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_repair_equals_search(spark, sf):
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    assert rows(conversation_repair.op11_conversation_repair(spark, sf), *REPAIR) == brute.conversation_repair(turns)


def test_repair_edge_cases(spark, tmp_path):
    spark.createDataFrame(edge_turns(), TURNS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows(conversation_repair.op11_conversation_repair(spark, str(tmp_path)), *REPAIR)
    assert got == brute.conversation_repair([r[:4] for r in edge_turns()])
    assert any(r[0] is None for r in got) and any(r[7] == "" for r in got) and any("R" in r[7] for r in got)


def test_repair_random_role_strings(spark, tmp_path):
    rnd = random.Random(8)
    turns = [(c, k, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool"]), f"{k} text" + rnd.choice([".", "!", "", "."]))
             for c in range(400) for k in range(rnd.randrange(1, 14))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(conversation_repair.op11_conversation_repair(spark, str(tmp_path)), *REPAIR) == brute.conversation_repair(turns)


def test_repair_text_ids_without_damage(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), ("b", 2, "assistant", "So.")],
                               "conv_id string, turn long, role string, text string")
    out = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in conversation_repair.repair(df).collect()}
    assert out == {"a": (0, "KK", brute.sha("user:Hi.\nassistant:Yes.")), "b": (2, "D", brute.sha(""))}


def test_state_crosses_batches_and_pointers_spill(monkeypatch):
    """A long conversation in batches of a few rows, with spilled pointers, gives
    the same audit as in one batch with none."""
    rnd = random.Random(3)
    line = [("=1", False, rnd.choice(["user", "assistant", "tool"]), f"{k}.", rnd.choice([0, 0, 0, 1, 3]), str(k)) for k in range(3000)]
    whole = pd.DataFrame(line, columns=["conv", "gone", "role", "text", "fault", "turn"])
    once = pd.concat(conversation_repair.repair_stream(iter([whole])))
    monkeypatch.setattr(conversation_repair, "SPILL_BYTES", 64)
    again = pd.concat(conversation_repair.repair_stream(iter([whole.iloc[a:a + 7] for a in range(0, 3000, 7)])))
    assert once.equals(again) and once.audit[0].count("D") > 100
    assert len(once.audit[0].replace("I", "")) == 3000


# --- BPE ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe_codec.vocabulary_path())


def of_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_codec_equals_library(spark, library, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert rows(bpe_codec.op12_bpe_codec(spark, sf)) == sorted(((d, *of_library(library, t)) for d, t in docs), key=repr)


def test_codec_edge_cases(spark, library, tmp_path):
    spark.createDataFrame(edge_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(((r[0], *of_library(library, r[1])) for r in edge_rows()), key=repr)
    assert rows(bpe_codec.op12_bpe_codec(spark, str(tmp_path))) == want


#: Letters with case and composition rules of their own, marks, controls, spaces.
ODD = "aaabbcdeeiiiioossttrrhhlln  '''..!?0123éßÆΣσς漢İıǅ́̇🙂\x00\x1c\x85\xa0 -"
PARTS = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "endoftext", " ", "<|ENDOFTEXT|>", "'s", "it's", "'re", "''ll", "x'Ve"]


def made_texts():
    rnd = random.Random(1)

    def made(alphabet, n):
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(n)))

    out = [made(ODD, 40) for _ in range(4000)] + [made("aeinrst", 60) for _ in range(3000)] + [made("ah", 90) for _ in range(1000)]
    out += [made(PARTS, 9) for _ in range(2000)] + [f"a{chr(x)}b {chr(x)}'s" for x in range(0x3000)]
    return out + [None, "", "x" * 5000, "ab" * 3000, *EDGE_TEXTS]


def test_codec_on_made_texts(library):
    codec, texts = bpe_codec.Codec(bpe_codec.vocabulary_path()), made_texts()
    ids = codec.encode(texts)
    back = codec.decode(ids).to_pylist()
    for text, got, decoded in zip(texts, ids.to_pylist(), back):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got == want and decoded == library.decode(want, skip_special_tokens=False)


def test_verified_words_are_merged_words():
    """A cut is verified exactly if it is what merging gives; short and long merging
    agree."""
    codec, rnd = bpe_codec.Codec(bpe_codec.vocabulary_path()), random.Random(2)
    words = [bytes(rnd.choice(b"abcdefghinorst") for _ in range(rnd.randrange(1, 16))) for _ in range(5000)]
    cuts, good = codec.speculate(words)
    exact = [codec.merged(w) for w in words]
    assert [c == e for c, e in zip(cuts, exact)] == good.tolist() and 0 < good.sum() < len(words)
    assert exact == [codec._merged_by_heap(w) for w in words]


def test_codec_pieces_and_table_bounds(monkeypatch):
    """Neither the size of a piece nor a table that starts anew changes a token."""
    texts = [t for t in EDGE_TEXTS if t is None or len(t) < 20_000]
    want = bpe_codec.Codec(bpe_codec.vocabulary_path()).encode(texts).to_pylist()
    monkeypatch.setattr(bpe_codec, "PIECE_CHARS", 50)
    monkeypatch.setattr(bpe_codec, "TABLE_WORDS", 20)
    assert bpe_codec.Codec(bpe_codec.vocabulary_path()).encode(texts).to_pylist() == want


def test_encoded_and_decoded_columns(spark, library):
    df = spark.createDataFrame([(t,) for t in ["It's a test", None, "", "<|endoftext|> x"]], "text string")
    out = df.select("text", bpe_codec.encoded(F.col("text")).alias("ids")).withColumn("back", bpe_codec.decoded(F.col("ids"))).collect()
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.back == library.decode(ids, skip_special_tokens=False)
    part = bpe_codec._flat(pa.array([[1], [2, 3], [], None]).slice(1, 3))
    assert part.to_pylist() == [[2, 3], [], []]


# --- Merkle manifest -----------------------------------------------------------------------

@pytest.mark.parametrize("sf", [SF001, SF01])
def test_manifest_equals_brute_force(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{sf}/documents.parquet'").fetchall()
    got = rows(merkle_manifest.op13_merkle_manifest(spark, sf))
    assert got == brute.merkle_manifest(docs)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_edge_cases(spark, tmp_path):
    spark.createDataFrame(edge_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r[0], r[3], r[2], r[4], r[1]) for r in edge_rows()]
    assert rows(merkle_manifest.op13_merkle_manifest(spark, str(tmp_path))) == brute.merkle_manifest(docs)


@pytest.mark.parametrize("n", [1, 16, 17, 32, 257])
def test_manifest_sizes(spark, tmp_path, n):
    """Runs of one node, full runs, and several levels; one source and many."""
    docs = [(i, "one" if n % 2 else f"s{i}", "en", 1, f"Text {i}") for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(merkle_manifest.op13_merkle_manifest(spark, str(tmp_path))) == brute.merkle_manifest(docs)
