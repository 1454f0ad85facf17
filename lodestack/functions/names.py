"""Names: normal forms, key tokens, trigrams, similarity and identifiers. All built of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell names apart.
GENERIC = ["model", "framework", "process", "approach", "strategy", "initiative", "programme", "program", "system", "platform", "capability", "team"]
MERGE, REVIEW, LEAST_CONFIDENCE, CONTAINED = 0.88, 0.72, 0.30, 0.88


def normalize_name(c: Column) -> Column:
    """Lower case, punctuation as blanks, blanks collapsed and trimmed. NULL is ''."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]+", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def key_tokens(norm: Column) -> Column:
    """Distinct words of a normal form without the generic ones, or all when nothing else is left."""
    words = F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))
    rest = F.array_except(words, F.array(*[F.lit(g) for g in GENERIC]))
    return F.when(F.size(rest) > 0, rest).otherwise(words)


def trigrams(norm: Column) -> Column:
    """Distinct runs of three characters of the padded form."""
    padded = F.concat(F.lit("  "), norm, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def similarity(na: Column, nb: Column, ta: Column, tb: Column, ga: Column, gb: Column) -> Column:
    """0 to 1 from normal forms, key tokens and trigrams of two names.

    Half the Jaccard likeness of the tokens and half the Dice likeness of the trigrams; at least .88 + .12 Jaccard when one token
    set of two or more lies within the other; 1 for equal normal forms, 0 when one is empty.
    """
    both = F.size(F.array_intersect(ta, tb))
    jaccard = both / F.greatest(F.lit(1), F.size(ta) + F.size(tb) - both)
    dice = 2 * F.size(F.array_intersect(ga, gb)) / (F.size(ga) + F.size(gb))
    base = 0.5 * jaccard + 0.5 * dice
    smaller = F.least(F.size(ta), F.size(tb))
    lifted = F.when((smaller >= 2) & (both == smaller), F.greatest(base, CONTAINED + 0.12 * jaccard)).otherwise(base)
    return F.when((na == "") | (nb == ""), F.lit(0.0)).when(na == nb, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lifted)))


def slugify(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by _; 'unnamed' for what has none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def object_id(kind: Column, name: Column) -> Column:
    return F.concat_ws("_", slugify(kind), slugify(name))


def content_id(sha: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.lower(sha), 1, 12))


def display_name(*choices: tuple[Column, ...], otherwise: str) -> Column:
    """The first choice whose parts are all non-blank, its trimmed parts joined by a blank; else the constant."""
    out = None
    for parts in choices:
        ok = F.lit(True)
        for p in parts:
            ok = ok & (F.trim(F.coalesce(p, F.lit(""))) != "")
        text = F.concat_ws(" ", *[F.trim(p) for p in parts])
        out = F.when(ok, text) if out is None else out.when(ok, text)
    return out.otherwise(F.lit(otherwise))


def derived_title(text: Column, words: int = 8) -> Column:
    """The first clause of a text, up to a number of words."""
    clause = F.trim(F.regexp_extract(F.trim(text), r"^[^.;:\n]*", 0))
    return F.array_join(F.slice(F.split(F.regexp_replace(clause, r"\s+", " "), " "), 1, words), " ")


def id_to_uri(c: Column) -> Column:
    """capability_release_x -> kg/capability/release_x: only the first _ parts the type."""
    return F.concat(F.lit("kg/"), F.regexp_replace(c, "^([^_]*)_", "$1/"))


def uri_to_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^kg/", ""), "^([^/]*)/", "$1_")


def local_name(c: Column) -> Column:
    return F.regexp_extract(c, "[^/#]*$", 0)


#: Where the graph's addresses begin.
BASE = "https://kg.example/"


def camel(predicate: Column) -> Column:
    """depends_on -> dependsOn."""
    words = F.split(predicate, "_")
    return F.concat(F.element_at(words, 1), F.array_join(F.transform(F.slice(words, 2, F.size(words)), F.initcap), ""))


def predicate_label(uri: Column) -> Column:
    """The stored form of a predicate's address: …/dependsOn -> depends_on."""
    return F.lower(F.regexp_replace(local_name(uri), "([a-z0-9])([A-Z])", "$1_$2"))


def predicate_uri(predicate: Column) -> Column:
    return F.concat(F.lit(BASE), camel(predicate))


def class_uri(kind: Column) -> Column:
    return F.concat(F.lit(BASE), kind)


def object_local_name(kind: Column, object_id: Column) -> Column:
    """The id without its type's prefix."""
    prefix = F.concat(slugify(kind), F.lit("_"))
    return F.when(F.startswith(object_id, prefix), F.substring(object_id, F.length(prefix) + 1, F.length(object_id))).otherwise(object_id)


def object_uri(kind: Column, object_id: Column) -> Column:
    return F.concat(F.lit(BASE), slugify(kind), F.lit("/"), object_local_name(kind, object_id))


def evidence_uri(evidence_id: Column) -> Column:
    return F.concat(F.lit(BASE + "evidence/"), evidence_id.cast("string"))


def says_yes(answer: Column) -> Column:
    """Whether an answer affirms, what the model thought aloud left out; false for NULL and for answers that say neither."""
    said = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?is)<think>.*?</think>", "")
    return said.rlike(r"(?i)\byes\b")
