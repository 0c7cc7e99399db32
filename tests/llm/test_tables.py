"""The corpus queries on the test tables: against SQL, and by held-out accuracy or round trip."""

import re

import pytest

from ferrule.llm import queries

from ..compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(database(SF), queries.ORACLES[name])


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op6_ngram_bayes"](spark, sf).where("held_out")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100


def test_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op3_url_differencing"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())


def test_private_data_is_gone(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op10_keyed_surrogates"](spark, "/root/testdata/sf0.01").collect()}
    mail = re.compile(r"[\w.]+@[\w.]+\.\w+")
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        new = got[r.doc_id].text
        old = set(mail.findall(r.text)) | set(re.findall(r"(?<!\d)\d{16}(?!\d)|\(\d{3}\) \d{3}-\d{4}", r.text))
        assert not any(x in new for x in old)
        if not re.search("[@0-9]", r.text):
            assert new == r.text


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in packed.where("start = 0").collect())


def test_everything_else_stands_alone():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
