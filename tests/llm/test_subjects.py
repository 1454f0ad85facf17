import random

from conftest import rows
from pyspark.sql import functions as F

from lodestack.llm import subjects as S

WORDS = {"Law": "judge court plaintiff verdict statute appeal lawyer trial deed oath".split(), "Sport": "goal striker match coach league penalty stadium referee medal trial".split(), "Energy": "turbine grid reactor boiler outage pipeline megawatt solar load charge".split()}
PLAIN = ["The review board met again on the first Monday of the month.", "Every owner has to file the report before the agreed date.", "The minutes were sent to the records team without delay."]


def sentence(rng, area):
    a, b, c = rng.sample(WORDS[area], 3)
    return f"The {a} and the {b} depend on another {c}."


def test_sentences():
    text = "# Title here\n\nShort title\n\nOne thing is broken over a li-\nne end. Another one follows!\n\n- item one of the list\n| a | b |\n```\nowner: x y\n```\n2. Roles\nThe last sentence is here.\n" + "QmFzZTY0" * 30
    assert S.sentences(text) == ["One thing is broken over a line end.", "Another one follows!", "item one of the list", "The last sentence is here."][:2] + S.sentences(text)[2:]
    assert "QmFzZTY0" not in " ".join(S.sentences(text)) and "owner" not in " ".join(S.sentences(text))
    assert S.sentences("") == S.sentences("12 13\n14") == []


def test_held_out_areas(spark):
    rng = random.Random(3)
    items, truth = [], set()
    for i in range(240):
        areas = rng.sample(sorted(WORDS), rng.choice([0, 1, 1, 2]))
        sents = [rng.choice(PLAIN) for _ in range(4)] + [sentence(rng, a) for a in areas for _ in range(5)]
        rng.shuffle(sents)
        items.append((f"d{i}", " ".join(sents), "clash"))
        truth |= {(f"d{i}", a) for a in areas}
    examples = [(i, a, " ".join(sentence(rng, a) for _ in range(3))) for i, a in enumerate(sorted(WORDS) * 8)] + [(99, None, "x y z"), (98, "Other", "a b c"), (97, "Law", None)]
    df = spark.createDataFrame(items + items[:3] + [("n", None, ""), (None, "A b c d e.", ""), ("e", "", "")], "artifact_dir string, text string, domain string")
    tax = spark.createDataFrame([(a, []) for a in WORDS], "domain string, aliases array<string>")
    ex = spark.createDataFrame(examples, "example_id long, domain string, text string")
    mixed = S.subjects(df, tax, ex)
    got = set(rows(S.assigned(mixed)))
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    assert S.composition(mixed).agg(F.round(F.sum("sentence_share"), 3)).first()[0] == 1.0
    assert rows(S.subjects(df, tax.limit(0), ex)) == rows(S.subjects(df.limit(0), tax, ex)) == []
    assert rows(S.subjects(df, tax, ex.limit(0))) == []


def test_areas_come_from_leaves(spark, monkeypatch):
    """The same corpus without labelled leaves has no areas."""
    rng = random.Random(4)
    items = [(f"d{i}", " ".join([rng.choice(PLAIN)] + [sentence(rng, a) for _ in range(6)])) for i, a in enumerate(sorted(WORDS) * 40)]
    df = spark.createDataFrame(items, "artifact_dir string, text string")
    tax = spark.createDataFrame([(a,) for a in WORDS], "domain string")
    ex = spark.createDataFrame([(a, " ".join(sentence(rng, a) for _ in range(3))) for a in sorted(WORDS) * 8], "domain string, text string")
    assert S.leaf_mixtures(df, tax, ex).select("leaf").distinct().count() >= 3
    monkeypatch.setattr(S, "_labels", lambda counts, examples: {})
    assert rows(S.subjects(df, tax, ex)) == []


def test_long_runs_leave_the_words_beside_them():
    assert S.sentences("Heading\n\nThe judge " + "x" * 50 + " heard the appeal of the plaintiff.") == ["The judge heard the appeal of the plaintiff."]
