from collections import Counter

import numpy as np
import pytest

from filigree.llm import personal
from filigree.llm.boosting import Boosted
from filigree.llm.personal_training import labelled
from tests.llm.personal_sentences import NOTHING, sentences


@pytest.fixture(scope="module")
def trained():
    return personal.models()


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.1)).astype(float)
    model = Boosted(rounds=30).fit(x[:2000], y[:2000]).calibrate(x[2000:2500], y[2000:2500])
    assert (((model.predict(x[2500:]) >= model.cut) == y[2500:]).mean()) > 0.97
    assert Boosted(rounds=2).fit(np.zeros((5, 2)), np.zeros(5)).predict(np.zeros((1, 2)))[0] < 0.5


def test_held_out_accuracy(trained):
    hit, wrong, lost = Counter(), Counter(), Counter()
    texts = labelled(600, 4711, personal.plain_words(trained.words.known))
    for (text, spans), found in zip(texts, personal.find([t for t, _ in texts], trained)):
        got = {f[:3] for f in found}
        for s in got | spans:
            (hit if s in got & spans else wrong if s in got else lost)[s[2]] += 1
    for kind in personal.KINDS:
        assert hit[kind] / (hit[kind] + wrong[kind]) > 0.9, kind
        assert hit[kind] / (hit[kind] + lost[kind]) > 0.88, kind


def test_sentences_written_apart(trained):
    """Sentences and mentions that the training's grammar knows nothing of."""
    cases = list(sentences())
    assert len(cases) >= 200
    found, total, wrong = Counter(), Counter(), 0
    for (_, kind, start, end), got in zip(cases, personal.find([c[0] for c in cases], trained)):
        total[kind] += 1
        found[kind] += (start, end, kind) in {g[:3] for g in got}
        wrong += sum(g[:3] != (start, end, kind) for g in got)
    for kind in personal.KINDS:
        assert found[kind] / total[kind] >= 0.9, (kind, found[kind], total[kind])
    assert wrong <= 8 and sum(map(len, personal.find(NOTHING, trained))) <= 2


def test_words_of_a_name_without_vocabularies(tmp_path):
    words = personal.Words(personal.vocabulary(str(tmp_path)))
    assert words.known == {} and len(words.of("Anna")) == len(personal._NOTHING) and words.of("Anna")[0] == 1.0


def mentions(text, trained):
    return [(k, text[a:b]) for a, b, k, _ in personal.find([text], trained)[0]]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Ask anna.berquist@mills.example.org about the lamp.", [("email", "anna.berquist@mills.example.org")]),
        ("printer@desk hums, foo@foo too, @foo and #bar99 trend.", []),
        ("Contact: hugo [at] mills-lab [dot] test\nPhone: (555) 555-0123", [("email", "hugo [at] mills-lab [dot] test"), ("phone", "(555) 555-0123")]),
        ("Invoice 76 58 783 is settled. Release 4.12.3-456 shipped. Batch 7731 holds soap.", []),
        ("Flight 2024-06-16 19:24 boards. Host 10.4.59.7 sleeps.", []),
        ("Somebody wrote identity number QQ 31 92 23 C on the wall.", [("idno", "QQ 31 92 23 C")]),
        ("Bring the cake to Flat 3, 12 Elmford Road, Oakley QX4 8ZZ.", [("address", "Flat 3, 12 Elmford Road, Oakley QX4 8ZZ")]),
        ("Room 66 shows the Green Valley Map. Read chapter 46 about Lake Fishing.", []),
        ("Yesterday Dr. Clara M. Bergstad opened the clinic.", [("name", "Clara M. Bergstad")]),
        ("Le dossier de Mme Delmoquist, Karin reste fermé.", [("name", "Delmoquist, Karin")]),
        ("Golden Lion and Green Garden are tea houses.", []),
    ],
)
def test_examples(text, expected, trained):
    assert mentions(text, trained) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Somebody wrote identity number AB 12 34 56 C on the wall.", [("idno", "AB 12 34 56 C")]),
        ("Identity number JG103759A expires.", [("idno", "JG103759A")]),
        ("SSN 219-09-9371", [("idno", "219-09-9371")]),
        ("Personalausweis C01X0006H", [("idno", "C01X0006H")]),
        ("Meine Nummer ist 089/63528174.", [("phone", "089/63528174")]),
        ("You may ring 07412 638159 on Sundays.", [("phone", "07412 638159")]),
        ("Bring the cake to Flat 3, 12 Elmford Road, Oakley SW1A 2BB.", [("address", "Flat 3, 12 Elmford Road, Oakley SW1A 2BB")]),
    ],
)
def test_ordinary_prefixes(text, expected, trained):
    assert mentions(text, trained) == expected


def test_no_feature_knows_fictional_prefixes():
    for kind, a, b in (("phone", "(202) 555-0123", "(202) 347-0123"), ("idno", "666-12-3456", "523-12-3456"), ("idno", "QQ 12 34 56 C", "AB 12 34 56 C")):
        assert personal.features(a, (0, len(a), kind)) == personal.features(b, (0, len(b), kind))


# Given names that neither the recognizer nor its training knows.
@pytest.mark.parametrize("given", ["Damian", "Ottilie", "Gwendolyn", "Anatole"])
def test_unlisted_given_names(given, trained):
    assert given.lower() not in personal.GIVEN
    assert (0, len(given) + 11, "name") in personal.candidates(f"{given} Dornvimark wartet.")
    for text in (f"{given} Dornvimark vendió la casa.", f"Nachtrag. {given} Dornvimark vendió la casa.", f"Bearbeiter: {given} Dornvimark"):
        assert mentions(text, trained) == [("name", f"{given} Dornvimark")]


def test_capitalized_words_are_no_names(trained):
    for text in ("Golden Lion sells 3 sorts of tea.", "Der Schreiner Thuulist hobelt jede Platte Arzo.", "LAUT PLAN BACKT DIE KÜCHE GARKAMI DREI KUCHEN."):
        assert mentions(text, trained) == []


def test_redaction_keeps_the_rest(spark):
    text = "Kontakt: vera.dornstad@kelan.example\r\n  Tél. 01 99 00 32 58 – Ende"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "a 1 " * 20_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, redacted string")
    got = {}
    for r in personal.recognize(df, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.redacted for r in got[1]] == ["Kontakt: [EMAIL]\r\n  Tél. [PHONE] – Ende"] * 2
    assert [(r.redacted, r.mentions) for r in got[2] + got[3]] == [(None, []), ("", [])]
    assert got[4][0].redacted == "a 1 " * 20_000
    for r in got[1]:
        assert all(text[m.start : m.end] == m.mention for m in r.mentions)
    assert personal.recognize(df.limit(0), "doc_id", "text").count() == 0
