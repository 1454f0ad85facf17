"""One form for texts that print the same: skeletons over a table of look-alikes.

The letters of Greek, Cyrillic and Armenian are stated here, as a reader takes them; the public table is looser there (it has 3 for Ze). Those of all
other scripts come from the public confusables data that Spark's own ICU library carries, by rule: one letter for one ASCII letter of the same case.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from lodestack.runtime import cut

# Letters of other scripts that print as a Latin letter.
LETTERS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "Ӏ": "I", "ӏ": "l", "Ա": "U", "Օ": "O", "օ": "o", "ո": "n", "ս": "u",
}
# Hyphens that print as the ASCII one, and characters that print nothing though they are not of category Cf.
HYPHENS = "‐‑"
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
#: Kinds of compatibility decomposition that print as what they decompose to, for any character, and for letters and numerals only.
SAME = ("<wide>", "<narrow>", "<noBreak>")
SAME_LETTERS = ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
LONG_S = "ſ"
_BLANKS = re.compile(r"[\t\r\x0b\x0c]|  ")


#: Scripts whose letters are stated above, or are no look-alikes of other scripts; the last ones have no letters that could be.
STATED = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CJK", "HANGUL", "TANGUT", "NUSHU", "KHITAN", "MODIFIER")


def public_letters(spark: SparkSession) -> dict[int, str]:
    """Letters of the scripts not stated above that print as an ASCII letter, from the ICU library's confusables data. A session without the data raises: a table without them would miss pairs silently.

    The data have one prototype for I, l, 1 and |; capitals that have it are I here, all other letters l.
    """
    letters = [ch for ch in map(chr, range(0x250, sys.maxunicode + 1)) if unicodedata.category(ch) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(ch) and not unicodedata.name(ch, "LATIN").startswith(STATED)]
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton("\n".join(letters)).split("\n")
    except (TypeError, Py4JError) as missing:
        raise RuntimeError("the look-alikes of other scripts need the confusables data of the ICU library (icu4j) among Spark's jars") from missing
    out = {}
    for ch, to in zip(letters, found, strict=True):
        if ch != to and len(to) == 1 and to.isascii() and to.isalpha():
            kind = unicodedata.category(ch)
            to = "I" if to == "l" and kind == "Lu" else to
            if kind == "Lo" or to.isupper() == (kind == "Lu"):
                out[ord(ch)] = to
    if not out:
        raise RuntimeError("the ICU library (icu4j) among Spark's jars has no look-alikes of other scripts")
    return out


def _table(spark: SparkSession) -> dict[int, str | None]:
    return public_letters(spark) | prototypes()


@cache
def prototypes() -> dict[int, str | None]:
    """Every character that isn't its own prototype, from the Unicode data by rule; None: it prints nothing."""
    out: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        kind = unicodedata.category(ch)
        tag = unicodedata.decomposition(ch).split(" ")[0]
        if kind == "Zs" or ch == "\t":
            out[code] = " "
        elif kind == "Cf" or ch in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out[code] = None
        elif ch in HYPHENS or 0xFF0D == code or 0xFE63 == code:
            out[code] = "-"
        elif kind in ("Zl", "Zp") or ch in "\r\x85\x0b\x0c":
            out[code] = "\n"
        elif (tag in SAME or (tag in SAME_LETTERS and kind[0] in "LN")) and ch != LONG_S:
            out[code] = unicodedata.normalize("NFKD", ch)
        if ch in LETTERS:
            out[code] = LETTERS[ch]
    for code, to in out.items():
        if to:
            out[code] = "".join(LETTERS.get(x, x) for x in to)
    return out


def skeleton(text: str, table: dict[int, str | None] | None = None) -> str:
    """Decomposed, every character replaced by its prototype, decomposed again; runs of blanks are one, line breaks are \\n."""
    if text.isascii() and not _BLANKS.search(text):
        return text
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(prototypes() if table is None else table)
    return re.sub(" {2,}", " ", unicodedata.normalize("NFD", text))


def _udf(function, kind, table: dict[int, str | None]):  # noqa: ANN001, ANN202
    """A pandas UDF of the function of a skeleton; NULL for NULL."""

    @pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else function(skeleton(x, table)) for x in text], dtype=object)

    return run


def _digest(skeleton: str) -> bytes | None:
    """128 bits of the skeleton; NULL for one that prints nothing."""
    return xxhash.xxh3_128_digest(skeleton.encode("utf-8", "surrogatepass")) if skeleton.strip() else None


def _digested(documents: DataFrame) -> DataFrame:
    """Both digests of every text, worked out once; 60 bytes a row go to the checkpoint folder."""
    digest = _udf(_digest, BinaryType(), _table(documents.sparkSession))
    d = documents.where(F.col("text").isNotNull()).select("doc_id", digest("text").alias("skeleton"), F.md5("text").alias("written"))
    return cut(d).where(F.col("skeleton").isNotNull())


def skeleton_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id that prints the same) and variants (how many ways of writing the class has).

    NULL texts and those that print nothing are in no class. A class of any size is one aggregate, never a list.
    """
    d = _digested(documents)
    # Each way of writing first, so that copies are combined before the shuffle.
    ways = d.groupBy("skeleton", "written").agg(F.min("doc_id").alias("least"))
    classes = ways.groupBy("skeleton").agg(F.min("least").alias("class_id"), F.count("*").alias("variants"))
    return d.join(classes, "skeleton").select("doc_id", "class_id", "variants")


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: all pairs of non-blank documents whose texts differ but print the same, each once.

    Exact copies make no pairs: classes with one way of writing fall out by an aggregate before any join, and the others are
    paired by their ways of writing, then by documents. NULL doc_ids make no pairs.
    """
    d = _digested(documents)
    mixed = d.groupBy("skeleton").agg(F.min("written").alias("lo"), F.max("written").alias("hi")).where("lo < hi").select("skeleton")
    d = d.join(mixed, "skeleton", "left_semi")
    ways = d.select("skeleton", "written").distinct()
    two = ways.select("skeleton", F.col("written").alias("wa")).join(ways.select("skeleton", F.col("written").alias("wb")), "skeleton").where("wa < wb")
    a = d.select("skeleton", F.col("written").alias("wa"), F.col("doc_id").alias("a"))
    b = d.select("skeleton", F.col("written").alias("wb"), F.col("doc_id").alias("b"))
    pairs = two.join(a, ["skeleton", "wa"]).join(b, ["skeleton", "wb"]).where(F.col("a") != F.col("b"))
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def normalised(documents: DataFrame) -> DataFrame:
    """doc_id and the skeleton of its text; NULL stays NULL."""
    same = _udf(str, StringType(), _table(documents.sparkSession))
    return documents.select("doc_id", same("text").alias("skeleton"))
