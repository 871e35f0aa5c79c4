import numpy as np
import pytest
from pyspark.sql import functions as F

from oakloom.llm.quality import FORMS, LineProfiles, jensen_shannon, not_prose, text_quality

DOCS, COMMON = "doc_id bigint, text string", "lang string, word string, freq_rank int"
FREQUENT = "the of and to in a is was that for on with as it at by from or be der die und von que de la le les et el los en".split()
PROSE = "The kettle in the old station was left on by one of the guards, so the room was warm when we came. Nobody was to be seen on the stairs, and the door of the office was open."


def rows_of(n, make):
    return "\n".join(make(k) for k in range(n))


TEXTS = {
    "prose": [PROSE, PROSE.replace(". ", ".\n"), PROSE.replace("of the guards, ", "of the guards,\n").replace("seen on ", "seen on\n"), "火车进站的时候，我们看见车厢的门开着，里面没有人。车站里的旧水壶一直开着。"],
    "list": [rows_of(9, lambda k: f"- cold kettle {k}"), rows_of(9, lambda k: f"{k + 1}. Tolvane ({k}17)"), rows_of(9, lambda k: ["warm room", "open the doors", "old station, Melvia"][k % 3]), rows_of(7, lambda k: f"[x] sweep floor {k}")],
    "table": [rows_of(9, lambda k: f"| {k} | warm | {k * 7} |"), rows_of(9, lambda k: f"{k},warm,{k * 7}"), rows_of(9, lambda k: f"seat={k} state=warm price={k * 7}"), rows_of(9, lambda k: f"{k}\twarm\t{k * 7}"), rows_of(9, lambda k: f"{k:<12}{'warm':<12}{k * 7:<12}")],
    "junk": ["@#$%^&*(<>{}[]|~" * 8, "�□▪▒ �□▪▒�� □▪▒" * 9, rows_of(5, lambda k: "kettle warm kettle kettle warm kettle warm warm kettle kettle warm kettle"), "xkrtwq zvbnlp gfdhjkw qrtplmsn vcxbzn wqrtk bnmtrwq plkjhg", "aaaaaaaaaaaaaaaaaaaa zzzzzzzzzzzzzzzzzzzzzzz"],
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_of_known_texts(spark, form):
    rows = list(enumerate(TEXTS[form]))
    got = text_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("x", w, 1) for w in FREQUENT], COMMON)).collect()
    assert {r.doc_id: r.form for r in got} == {k: form for k, _ in rows}


def test_statistics(spark):
    rows = [(1, "Ab cd, the x!\n\nplain line\n"), (2, None), (3, " \n​"), (4, "..."), (1, "a"), (5, (PROSE + " ") * 2000)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("words", "form", "lang", "word", "prose_share")})
    got = {(r.doc_id, r.words): r for r in text_quality(df.coalesce(1), spark.createDataFrame([("en", "the", 1), (None, None, None)], COMMON)).collect()}
    assert len(got) == 6
    one = got[1, 6]
    assert one.mean_word_length == 17 / 6 and one.symbol_ratio == 2 / 26 and one.ended_lines == 0.5 and one.common_share == 1 / 6
    assert (got[2, 0].form, got[2, 0].symbol_ratio, got[2, 0].ended_lines, got[2, 0].mean_word_length) == (None,) * 4
    assert got[4, 0].symbol_ratio == 1.0 and got[4, 0].form == "junk" or got[4, 0].form is not None
    assert got[5, 2000 * 38].form == "prose"


def test_mixed_texts_take_the_larger_form(spark):
    table = rows_of(30, lambda k: f"| {k} | warm | {k * 7} | open |")
    rows = [(1, PROSE + "\n\n" + table), (2, (PROSE + "\n\n") * 8 + table)]
    got = {tuple(r) for r in not_prose(text_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("x", w, 1) for w in FREQUENT], COMMON))).collect()}
    assert got == {(1, "table")}


def test_empty_tables(spark):
    common = spark.createDataFrame([], COMMON)
    assert text_quality(spark.createDataFrame([], DOCS), common).count() == 0
    assert text_quality(spark.createDataFrame([(1, PROSE)], DOCS), common).count() == 1


def test_divergence():
    import numpy as np

    x = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]])
    assert jensen_shannon(x, np.array([0.0, 0.0, 1.0])).tolist() == [1.0, 1.0] and jensen_shannon(x, x[0])[0] == 0
    assert len(LineProfiles(frozenset()).forms) == len(LineProfiles(frozenset()).profiles["chars"])


def shares(texts, common=frozenset("a o e de do da em que não um uma os as the of and to in was by we that".split())):
    profiles = LineProfiles(common)
    lines = [x for t in texts for x in t.split("\n") if x.strip()]
    owner = np.repeat(np.arange(len(texts)), [sum(bool(x.strip()) for x in t.split("\n")) for t in texts])
    described = profiles.describe(lines)
    size = np.zeros((len(texts), 4))
    np.add.at(size, (owner, profiles.line_forms(described, owner)), described.size)
    return [FORMS[k] for k in size.argmax(axis=1)]


def test_capitals_with_accents_are_no_junk():
    text = "A ADMINISTRAÇÃO DE SÃO PAULO NÃO PUBLICOU A DECISÃO, E A POPULAÇÃO DA REGIÃO NÃO FOI OUVIDA EM UMA AUDIÊNCIA."
    assert shares([text, "L'âne a mangé des pâtes près du château, et la fête de la forêt a été très belle."]) == ["prose", "prose"]
    assert shares([text.encode().decode("cp1252", "replace"), ("Die Übung war für die Schüler schön. " * 3).encode().decode("latin-1")])[0] == "junk"


def test_forms_without_layout_patterns():
    wrapped = "When the train came in we saw that the doors of\ncarriage 14 were open and nobody was in it, so we\nasked the guard for the reason and went to the\nold station again."
    entries = "\n".join(["warm kettle", "Tolvane (4417)", "open doors", "quiet platform brown-fox-2211", "guard room, Melvia", "seat cover"])
    assert shares([wrapped, entries, "\n".join(f"{k}. {x}" for k, x in enumerate(entries.split("\n"), 1)), "seat | price\n14 | 7.30\n22 | 6.10"]) == ["prose", "list", "list", "table"]


def test_blank_lines_cost_nothing(spark):
    text = "\n" * 1_000_000
    profiles = LineProfiles(frozenset())
    assert [x for x in text.split("\n") if x and not x.isspace()] == [] and profiles.describe([]).size.shape == (0,)
