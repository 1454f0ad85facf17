import numpy as np
import pandas as pd
import pytest
from conftest import rows

from lodestack.llm import scan_text as T
from lodestack.llm import scans as S

BODY = "the registry staff must update the control library before the annual review and the board may report every gap in the evidence log"


@pytest.fixture(scope="module")
def counts():
    text = "\n".join([BODY + " with the off-peak charge of the internal audit"] * 60)
    return {r.word: int(r.n) for r in next(S._counted(iter([pd.DataFrame({"text": [text]})]))).itertuples()}


def reader_for(text, counts, running=()):
    """Knows of the text only what it asks for."""
    words = T.asked(set(T.tokens_of(text)), *T.outline(text), {})
    found = {w: [{"right": to, "vector": None} for to, clear in T.edits(w).items() if counts.get(to, 0) >= (2 if clear else 20)] for w in words if w not in counts}
    facts = [{"word": w, "n": counts.get(w, 0), "readings": found.get(w)} for w in words] + [{"word": "\n" + T.form_of(x), "n": 2, "readings": None} for x in running]
    return T.Reader({}, {}).of(facts)


def repair(text, counts, running=()):
    return T.repair(text, reader_for(text, counts, running))


@pytest.mark.parametrize(
    ("text", "noise", "clean"),
    [
        ("the registry staff must upd-\nate the control library", {"hyphen"}, "the registry staff must update the control library"),
        ("the registry staff must upd\nate the control library", {"hyphen"}, "the registry staff must update the control library"),
        ("with the off-\npeak charge of the internal audit", set(), None),
        ("the reg1stry staff must updaté the c0ntrol library", {"glyph"}, "the registry staff must update the control library"),
        ("the registry staff must update the\nNordkist / Findings\ncontrol library before the annual", {"header"}, "the registry staff must update the control library before the annual"),
        ("the registry staff must update the\n\n- 12 -\n\ncontrol library before the annual", {"page_no"}, "the registry staff must update the control library before the annual"),
        ("the registry staff must con-\nAUDIT GROUP – REVIEW | Page 3 of 9\ntrol the evidence", {"header", "page_no", "hyphen"}, "the registry staff must control the evidence"),
        ("the registry staff must update the control library\nQuantity\n12\n13\n14", set(), None),
        ("| library | 12 | May |\n| board | 13 | June |", set(), None),
        ("A copy in CO2 format and A4 and v1.0", set(), None),
        ("", set(), None),
        ("  \n ", set(), None),
    ],
)
def test_repair(counts, text, noise, clean):
    found, out = repair(text, counts, ["Nordkist / Findings", "AUDIT GROUP – REVIEW"])
    assert found == noise
    assert out == (text if clean is None else clean)


def test_repair_of_a_repair(counts):
    text = "the reg1stry staff must upd-\nate the\nNordkist / Findings\ncontrol library"
    once = repair(text, counts, ["Nordkist / Findings"])[1]
    assert repair(once, counts, ["Nordkist / Findings"]) == (set(), once)


def test_a_line_of_capitals_is_text_unless_its_form_repeats(counts):
    text = "the board may report every gap in the name of the\nUnited Nations Security Council\nbefore the annual review of the control library"
    assert repair(text, counts) == (set(), text)
    assert repair(text, counts, ["united nations security council"])[0] == {"header"}
    assert repair(text.replace("\nUnited", "\n- 7 -\nUnited"), counts)[0] == {"header", "page_no"}


def test_forms_fold_numbers_and_glyphs():
    assert T.form_of("Chapter 3  Risk register") == T.form_of("CHAPFER 12  Rlsk rcgister")
    assert T.form_of("Nordkist / Roles") != T.form_of("Nordkist / Scope")
    page = "one line of text runs to here and\nNordkist / Roles\n{} goes on there to the end of it all"
    assert {a for _, a in T.header_forms(*T.outline(page.format("this")))} != {a for _, a in T.header_forms(*T.outline(page.format("that")))}


def test_neighbours_tell_words_apart(monkeypatch):
    """Words 0 and 1 share their neighbours, word 2 has others; a rare word lies by whom it shares them with."""
    monkeypatch.setattr(S, "CONTEXTS", 4)
    n = np.zeros((3, 16), np.float32)
    n[0, [0, 5]] = n[1, [0, 5]] = n[2, [2, 7]] = 50
    basis, share = S.skipgram_basis(n, 2)
    told = next(S._vectors(basis, share)(iter([pd.DataFrame({"word": ["a", "b", "rare"], "codes": [[0, 5], [2, 7], [0, 5]], "ns": [[50.0, 50.0], [50.0, 50.0], [1.0, 1.0]]})])))
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert cos(told.near[2], told.vector[0]) > 0.9 and abs(cos(told.near[2], told.vector[1])) < 0.1


def test_own_sightings_leave_copies_out():
    at, n = [0, 1, 2 * S.CONTEXTS, 2 * S.CONTEXTS + 1], [1000.0, 1.0, 999.0, 2.0]
    flat = [0, 1, 2, 3], [5.0, 5.0, 5.0, 5.0]
    told = next(S._vectors(np.ones((4 * S.CONTEXTS, 2)), np.full(4 * S.CONTEXTS, 1e-4))(iter([pd.DataFrame({"word": ["copied", "free"], "codes": [at, flat[0]], "ns": [n, flat[1]]})])))
    assert told.own.tolist() == [3, 16]


def corpus(spark):
    """A word of its own that looks like a misreading of a frequent one, and a misreading, each seen as often."""
    lines = [f"the registry staff of unit {i} must cross the water under the bridge and swim the water near the shore" for i in range(300)]
    lines += [f"the registry staff of unit {i} must cross the wafer under the bridge and swim far" for i in range(2)] + [f"clerks eat one sweet wafer with ice for {i} coins every day" for i in range(40)]
    return spark.createDataFrame([(f"w{i}", x) for i, x in enumerate(lines)], "artifact_dir string, text string"), spark.createDataFrame([("e", 1)], "quote string, id long").limit(0)


def test_a_word_with_neighbours_of_its_own_is_no_misreading(spark):
    w, e = corpus(spark)
    assert rows(S.found_noise(S.records(w, e))) == []
    few = w.where("text NOT LIKE 'clerks%'")
    assert rows(S.found_noise(S.records(few, e)).select("noise").distinct()) == [("glyph",)]


def test_the_lexicon_changes_no_result(spark):
    w, e = corpus(spark)
    scan = spark.createDataFrame([(f"s{i}", f"the regi-\nstry staff of unit {i} must cr0ss the wa-\nter undcr the bridge") for i in range(9)], "artifact_dir string, text string")
    recs = S.records(w.unionByName(scan), e)
    few = S.repaired(recs, lexicon_size=8)
    assert rows(few) == rows(S.repaired(recs))
    assert rows(few.where("rec_key LIKE 's%'").select("noise", "text").distinct())[0] == (["glyph", "hyphen"], "the registry staff of unit 0 must cross the water under the bridge")


def test_records(spark):
    w = spark.createDataFrame([("a", BODY, 1)] * 40 + [("b", BODY.replace("registry", "reg!stry"), 1), ("c", None, 1), (None, BODY, 1), ("d", "", 1), ("e", (BODY + " ") * 3000, 1)], "artifact_dir string, text string, noise int")
    e = spark.createDataFrame([(1, BODY.replace("control", "contr0l"), 1), (1, BODY.replace("control", "contr0l"), 1), (2, None, 1), (None, BODY, 1)], "id long, quote string, text int")
    recs = S.records(w, e)
    assert rows(S.found_noise(recs)) == [("compliance_assessment_evidence", "1", "glyph"), ("work_items", "b", "glyph")]
    assert S.repaired(recs).where("rec_key = 'a' AND text <> '" + BODY + "'").count() == 0
    assert rows(S.found_noise(S.records(w.limit(0), e.limit(0)))) == []


def test_copies_do_not_vouch_for_their_misreadings(spark):
    """A scanned text in 30 near copies and 30 copies: its misread words are still ones, and a word of 30 unlike texts is none."""
    lines = " ".join(f"the registry staff of unit {i} must update the control library and may report every gap in the evidence log from the annual review" for i in range(60))
    scan = "on monday the reg1stry staff fr0m the harbour office sent all boxes of old paper files to the eontrol room where two clerks sorted them by year and owner"
    near = [f"{scan} batch {i}" for i in range(30)] + [scan] * 30
    apart = [f"{chr(97 + i % 26) * 3}{i} bought item{i} and left form{i} beside vi{i} then the hnd went home to place{i} with guest{i}" for i in range(30)]
    w = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(near)] + [(f"a{i}", x) for i, x in enumerate(apart)] + [("body", lines)], "artifact_dir string, text string")
    e = spark.createDataFrame([], "id long, quote string")
    out = {r.rec_key: r for r in S.repaired(S.records(w, e)).collect()}
    assert all(out[f"c{i}"].noise == ["glyph"] for i in range(60))
    assert all("registry staff from the harbour" in out[f"c{i}"].text and "the control room" in out[f"c{i}"].text for i in range(60))
    assert all(not out[f"a{i}"].noise for i in range(30))
