import pytest

from palisade.llm.sentences import sentences

CASES = [
    "Dr. Varro came at 9 a.m. He left.|Nothing changed.",
    "It took 3.14 s (avg. over 9 runs).|Call /a.do?id=9 now!",
    'The banner read: "Slow down. Not alone."|The end.',
    '"Is it down?" asked a crawler.',
    "They saw it (why? nobody knows) twice.|(See a.toml.)|Ok.",
    "N. L. Berg wrote it.|It is in the U.S. region.",
    "Siehe Abb. 3 und Nr. 5, z. B. hier.|Am 3. März fiel er aus.",
    "Rien n’a changé !|« Est-ce en panne ? » demanda l’équipe.",
    "他问：“坏了吗？”|真的吗？！|等等……好了。",
    "「止まれ。待て。」と出た。|遅延は1.5秒だ。",
    "Почему?|Куки и т. д. не менялись.",
    "हमने गिने।|डॉ. तरवी ने देखी।",
    "لماذا ظهرت؟|لم يتغير شيء!",
    "# Head. One\n|\n- Item one. Two\n|- Item three\n|\nHard\nwrapped line.|Next",
    "1. First item\n|2. Second item",
    "Wait... it came back.|Really?!",
]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(spark, case):
    # the first of these has no boundary before its last sentence's start but one
    parts = case.split("|")
    text = " ".join(p if p.endswith("\n") else p for p in parts).replace("\n ", "\n")
    want = [p.strip() for p in parts]
    if case.startswith("Dr."):
        want = ["Dr. Varro came at 9 a.m.", "He left.", "Nothing changed."]
    got = sentences(spark.createDataFrame([(1, text, "x")], "doc_id bigint, text string, sentence string"), "doc_id", "text", keep_text=True).orderBy("start_pos").collect()
    assert [r.sentence for r in got] == want
    assert all(text[r.start_pos : r.end_pos] == r.sentence for r in got)


def test_edges(spark):
    long = "One two three. " * 5000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "no end"), (5, long), (6, "own marks. Stay. 👩‍💻 ok.")]
    got = {}
    for r in sentences(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    assert set(got) == {4, 5, 6} and got[4] == [(0, 6)] and len(got[5]) == 5000
    assert sorted(got[5])[-1] == (len(long) - 15, len(long) - 1)
    assert sorted(got[6])[-1][1] == len(rows[5][1])


@pytest.mark.parametrize(("a", "b"), ["“”", "«»", "()", "[]", '""', "''"])
def test_long_quotes_and_brackets(spark, a, b):
    inner = "One is here. " * 500
    text = f"They read {a}{inner}Two{b} aloud. The end.\n\nA stray {a}mark. It ends nothing. Really."
    got = sentences(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id", "text", keep_text=True).orderBy("start_pos").collect()
    assert [r.sentence for r in got] == [f"They read {a}{inner}Two{b} aloud.", "The end.", f"A stray {a}mark.", "It ends nothing.", "Really."]


def test_long_quote_after_a_colon(spark):
    said = "He said: “" + "One is here. " * 80 + "Two.”"
    got = sentences(spark.createDataFrame([(1, said + " Then he left.")], "doc_id bigint, text string"), "doc_id", "text", keep_text=True).orderBy("start_pos").collect()
    assert [r.sentence for r in got] == [said, "Then he left."]


def cut(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return [r.sentence for r in sentences(df, "doc_id", "text", True).orderBy("start_pos").collect()]


def test_quotes_and_brackets_of_any_length(spark):
    long = "Stop here. Go on! " * 300
    for a, b in (("“", "”"), ('"', '"'), ("(", ")"), ("'", "'")):
        got = cut(spark, f"He said {a}{long.strip()}{b} and left. Then came more.")
        assert len(got) == 2 and got[1] == "Then came more.", (a, len(got))
    assert len(cut(spark, "He said 'I don't know. You can't tell. " + "We won't ask. " * 90 + "Never' and left. Done.")) == 2
    thai = "เขาพูดว่า “" + "ไปที่นี่ แล้วกลับ " * 90 + "จบ” แล้วไป"
    assert len(cut(spark, thai)) == 1 or cut(spark, thai)[0].count("”") == 1


def test_scripts_with_marks_of_their_own(spark):
    for text, n in (("မင်္ဂလာပါ။ နေကောင်းလား။", 2), ("សួស្តី។ អ្នកសុខសប្បាយទេ។", 2), ("བཀྲ་ཤིས། བདེ་ལེགས།", 2)):
        assert len(cut(spark, text)) == n, text
