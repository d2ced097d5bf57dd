"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables and clashing extra columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, common, decontaminate, htmltext, langid, neardup, pii, shards, topk, toxicity

LONG = "the quick brown fox " * 20_000
ROWS = [
    (1, "the cat sat on the mat and the dog ran far away over the hill", "en", "a", 61),
    (1, "the cat sat on the mat and the dog ran far away over the hill", "en", "a", 61),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (None, "le chat est sur la table et le chien court dans le jardin", "fr", "b", 57),
    (5, "mail me at joe@example.com or +1 (319) 555-5132, you idiot", "en", "c", 58),
    (6, "1234 é中\U0001f600 !!", None, "c", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with the names that operators give to theirs."""
    extra = "score predicted held_out lang_pred margin fp id key component_id spans items n_words text_ row_ ids n_tokens pii_base pii_spans pairs_x base label n".split()
    return docs.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(extra)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, None, None), (1, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "dog ran far away over the hill"), (2, None), (None, "cat"), (3, ""), (1, "dog ran far away over the hill")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<article><p>a &amp; b<p>c</article>"), (3, "w", "<p>" + "word " * 50_000)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(0, [0.5, 0.5]), (50, [0.5, 0.5]), (1, None), (2, [0.1, None]), (3, [float("nan"), 1.0]), (4, [0.9, 0.9]), (4, [0.9, 0.9]), (5, []), (6, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in "documents labels benchmark conversations pages embeddings".split():
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def queries():
    return [langid.op1, toxicity.op2, htmltext.op3, shards.op4, chat.op5, decontaminate.op6, pii.op7, neardup.op8, bpe.op9, topk.op10]


@pytest.mark.parametrize("query", queries())
def test_every_row_comes_back(spark, folder, query):
    rows = query(spark, folder).collect()
    of = {htmltext.op3: 4, chat.op5: 3, topk.op10: None}.get(query, len(ROWS))
    assert of is None or len(rows) == of


@pytest.mark.parametrize("query", queries())
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == (1 if query is chat.op5 else 0)


@pytest.mark.parametrize("stage", [toxicity.stage, neardup.stage, decontaminate.stage, pii.stage])
def test_stages_keep_columns(spark, folder, clashing, stage):
    out = stage(spark, clashing, folder)
    assert out.columns == clashing.columns
    got = out.collect()
    assert 0 < len(got) <= len(ROWS) and all(r.score == "x0" and r.row_ == "x13" for r in got)
    assert stage(spark, clashing.limit(0), folder).count() == 0


def test_null_and_empty_text(spark, folder):
    one = lambda q: {r.doc_id: r for r in q(spark, folder).collect()}
    assert {one(langid.op1)[i].lang_pred for i in (2, 3)} == {"und"}
    assert one(toxicity.op2)[2].score == one(toxicity.op2)[3].score
    d = one(decontaminate.op6)
    assert d[1].n_hit == 7 and d[1].n_items == 1 and d[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not d[2].contaminated
    p = one(pii.op7)
    assert (p[5].n_email, p[5].n_phone, p[2].spans) == (1, 1, "")
    n = one(neardup.op8)
    assert n[2].fingerprint == n[3].fingerprint == "0" * 16 and n[3].component_id == 2
    b = one(bpe.op9)
    assert b[2].n_tokens == 0 and b[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert b[6].decoded_sha256 == hashlib.sha256(ROWS[-1][1].encode()).hexdigest()


def test_pages_and_conversations(spark, folder):
    pages = {r.page_id: r.text for r in htmltext.op3(spark, folder).collect()}
    assert pages[1] == pages[2] == "" and pages[None] == "a & b\nc" and len(pages[3].split()) == 50_000
    convs = {r.conv_id: r for r in chat.op5(spark, folder).collect()}
    assert convs[1].n_turns == 3 and convs[-7].loss_chars == len(chat.TRICKY)
    assert convs[-7].turns_sha256 == hashlib.sha256(f"user\n{chat.TRICKY}\nassistant\n{chat.TRICKY}\n".encode()).hexdigest()


def test_vectors_that_take_no_part(spark, folder):
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op10(spark, folder).collect()]
    assert sorted(got) == [(0, 1, 4, 128 * 230 * 2), (0, 2, 4, 128 * 230 * 2), (0, 3, 50, 2 * 128 * 128), (50, 1, 4, 128 * 230 * 2), (50, 2, 4, 128 * 230 * 2), (50, 3, 0, 2 * 128 * 128)]


def test_one_copy_stays_of_repeated_ids(spark, docs, folder):
    got = [r.doc_id for r in neardup.stage(spark, docs, folder).collect()]
    assert got.count(1) == 1 and got.count(None) == 1 and (2 in got) and (3 not in got)


def test_redaction(spark, docs):
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[5] == "mail me at <EMAIL> or <PHONE>, you idiot" and text[2] is None and text[4] == LONG


def test_numpy_and_shared_folder(spark):
    assert common.shared_dir(spark) and np.bitwise_count(np.uint64(7)) == 3
