from unittest.mock import MagicMock

import pytest
from conftest import rows
from py4j.protocol import Py4JError

from lodestack.llm import lookalikes as L
from lodestack.llm.lookalikes import lookalike_pairs, normalised, skeleton, skeleton_classes


@pytest.mark.parametrize(("a", "b"), [("ＡＢＣ １２", "ABC 12"), ("café", "café"), ("ﬁnal oﬃce", "final office"), ("Ⅳ. part", "IV. part"), ("a b c", "a b c"), ("co‑op", "co-op"), ("Вот", "Boт"), ("ab​c﻿", "abc"), ("soft­ware", "software"), ("ΑΒ", "AB"), ("a\r\nb", "a\nb")])
def test_prints_the_same(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("Case", "case"), ("cafe", "café"), ("x²", "x2"), ("a!", "a."), ("a\nb", "a b"), ("word", "world"), ("I", "l"), ("O", "0"), ("a–b", "a-b"), ("№", "No")])
def test_prints_otherwise(a, b):
    assert skeleton(a) != skeleton(b)


def test_skeleton_of_a_skeleton():
    for x in ("Вот ﬁ Ⅳ ＡＢ é", "", "​", "plain"):
        assert skeleton(skeleton(x)) == skeleton(x)


def test_pairs_and_classes(spark):
    d = spark.createDataFrame([(1, "abc", 0), (2, "abc", 0), (3, "ａbc", 0), (4, None, 0), (5, " ​", 0), (6, " ", 0), (None, "abс", 0), (8, "x" * 200_000, 0), (9, "", 0)], "doc_id long, text string, skeleton int")
    assert rows(lookalike_pairs(d)) == [(1, 3), (2, 3)]
    assert rows(skeleton_classes(d).where("doc_id IS NOT NULL")) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (8, 8, 1)]
    assert normalised(d).where("doc_id = 3").first().skeleton == "abc"
    assert rows(lookalike_pairs(d.limit(0))) == rows(skeleton_classes(d.limit(0))) == []


def test_many_copies_make_no_pairs(spark):
    d = spark.range(20_000).selectExpr("id AS doc_id", "'same text' AS text")
    assert lookalike_pairs(d).count() == 0
    assert skeleton_classes(d).agg({"class_id": "max"}).first()[0] == 0


def test_letters_of_every_script(spark):
    table = L._table(spark)
    for a, b in (("Ꭺ", "A"), ("ס", "o"), ("ӏ", "l"), ("ᏞᎪᎷᏴ", "LAMB"), ("о", "o")):
        assert skeleton(a, table) == skeleton(b, table)
    for a, b in (("З", "3"), ("г", "r"), ("б", "6"), ("ж", "x"), ("ш", "w")):
        assert skeleton(a, table) != skeleton(b, table)
    d = spark.createDataFrame([(1, "ᎪB"), (2, "AB")], "doc_id long, text string")
    assert rows(lookalike_pairs(d)) == [(1, 2)]


@pytest.mark.parametrize("letters", [TypeError("'JavaPackage' object is not callable"), Py4JError("no such class"), lambda text: text])
def test_without_the_public_letters_it_fails(letters):
    """A session whose ICU library is missing, fails or knows no look-alikes gives no table, rather than one of fewer letters."""
    spark = MagicMock()
    builder = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder
    if isinstance(letters, Exception):
        builder.side_effect = letters
    else:
        builder.return_value.build.return_value.getSkeleton.side_effect = letters
    with pytest.raises(RuntimeError, match="ICU"):
        L._table(spark)
