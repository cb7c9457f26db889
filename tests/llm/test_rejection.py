"""Rejection by the language model: strangers go, documents of its own languages stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import langid

STRANGERS = {
    "sv": "Det var en gång en liten flicka som bodde i en stuga långt inne i skogen med sin mormor och sina tre syskon, och varje morgon gick hon ner till sjön.",
    "pl": "Dawno temu za siedmioma górami i siedmioma rzekami żył sobie król, który miał trzy córki i żadnego syna.",
    "ru": "Жила-была маленькая девочка, которая каждый день ходила в лес за грибами и ягодами.",
    "ja": "むかしむかし、あるところに、おじいさんとおばあさんがありました。おじいさんは山へしばかりに行きました。",
    "code": 'int main(int argc, char **argv) { for (int i = 0; i < argc; i++) printf("%s\\n", argv[i]); return EXIT_SUCCESS; } static void free_list(struct node *head);',
    "letters": "qzxv kjwq pfghz mxcvb wqrtz plkjh zxcvq bnmqw rtyui vbnmz qazwsx edcrfv tgbyhn ujmikol",
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(table):
    return langid.train(table)


def test_strangers_are_rejected(spark, model):
    rows = [(i, t) for i, t in enumerate([*STRANGERS.values(), None, "", "12 + 34"])]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(r.rejected for r in got.values())
    assert [got[i].lang_pred for i in (6, 7, 8)] == ["und"] * 3 and all(got[i].lang_pred in model.langs for i in range(6))
    assert model.false_reject <= 0.01 and model.false_accept <= 0.1


def test_known_languages_stay(table, model):
    held = langid.predict(table, model).filter("held_out").join(table.select("doc_id", "lang", "text"), "doc_id")
    wrong, rejected, n = held.filter("lang is not null").agg(F.sum((F.col("lang") != F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int")), F.count("*")).first()
    assert n > 150 and rejected <= 0.01 * n and wrong <= 0.01 * n


def test_one_language_and_short_texts(spark, table):
    """With a single language there are no others to stand for strangers; scrambled letters still do."""
    model = langid.train(table.filter("lang = 'en'"))
    rows = [(1, "The"), (2, "In the house of the"), (3, STRANGERS["letters"]), (4, STRANGERS["ja"])]
    got = {r.doc_id: r.rejected for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert model.langs == ("en",) and not got[1] and got[3] and got[4]
