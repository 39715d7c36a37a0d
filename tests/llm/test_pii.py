import pytest

from palisade.llm.pii import normalised, personal_data, redacted, spans


def found(text):
    return [(text[a:b], k) for a, b, k in spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail me: anna.berg+x@mail.example.org.", [("anna.berg+x@mail.example.org", "email")]),
        ("reach anna at mail dot example dot org now", [("anna at mail dot example dot org", "email")]),
        ("<anna[at]example[dot]net>", [("anna[at]example[dot]net", "email")]),
        ("mail anna[@]example.net now", [("anna[@]example.net", "email")]),
        ("anna@example[.]net", [("anna@example[.]net", "email")]),
        ("anna (@) example (.) net", [("anna (@) example (.) net", "email")]),
        ("anna {@} mail.example <.> net or call", [("anna {@} mail.example <.> net", "email")]),
        ("match f(.) or [@] here, a[.]b", []),
        ("ａｎｎａ＠ｅｘａｍｐｌｅ．ｎｅｔ", [("ａｎｎａ＠ｅｘａｍｐｌｅ．ｎｅｔ", "email")]),
        ("an​na@exаmple.net", [("an​na@exаmple.net", "email")]),
        ("call +44 (0)7700 900123, ext 12", [("+44 (0)7700 900123, ext 12", "phone")]),
        ("call (212) 555‑0142 x9", [("(212) 555‑0142 x9", "phone")]),
        ("ring zero seven seven zero zero nine zero zero one two three today", [("zero seven seven zero zero nine zero zero one two three", "phone")]),
        ("ticket 400 685 1740 is a copy, the batch 202460687834", []),
        ("My SSN is 944 23 6101, ok", [("944 23 6101", "id_number")]),
        ("passport no. XR4883662 belongs to D. Berg.", [("XR4883662", "id_number"), ("D. Berg", "name")]),
        ("Vivo en Calle Mayor, n.º 12, 3.º B, 00123 Robledal, dijo", [("Calle Mayor, n.º 12, 3.º B, 00123 Robledal", "address")]),
        ("at 12 Oak Street, Unit 4, Newtown, QX 12345.", [("12 Oak Street, Unit 4, Newtown, QX 12345", "address")]),
        ("Meine Adresse ist Hauptstraße 5.", [("Hauptstraße 5", "address")]),
        ("Vivo en Calle Mayor, 7, gracias", [("Calle Mayor, 7", "address")]),
        ("I live at 5B Oak Street, thanks", [("5B Oak Street", "address")]),
        ("au 5, rue Pasteur, merci", [("5, rue Pasteur", "address")]),
        ("5th Street is closed, see Road 7", []),
        ("8830 Retry Road map items are open", []),
        ("Dear Mr. N. O'Berg, we moved", [("N. O'Berg", "name")]),
        ("Ask ANNA BERG about it", [("ANNA BERG", "name")]),
        ("Contact: Berg, Anna; Tel: 030 23125 241", [("Berg, Anna", "name"), ("030 23125 241", "phone")]),
        ("use the Clara Release, Felix Mode is off, cache@1.2.3", []),
        ("", []),
    ],
)
def test_spans(text, want):
    assert found(text) == want


def test_tape_maps_back():
    t = "x​ＡＢ at c"
    tape = normalised(t)
    assert tape.text == "xAB at c" and tape.source(1, 3) == (2, 4)


def test_tables(spark):
    rows = [("t", 1, "mail a@b.example now"), ("t", 2, "mail a@b.example now"), ("t", 3, None), ("t", 4, ""), ("u", 1, "hi " * 50_000 + "a@b.example"), ("t", 1, "mail a@b.example now")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "space string, id bigint, text string, spans string")
    got = {tuple(r) for r in personal_data(df, "space", "id", "text").collect()}
    assert got == {("t", 1, 5, 16, "email"), ("t", 2, 5, 16, "email"), ("u", 1, 150_000, 150_011, "email")}
    clean = {(r.space, r.id): r.text for r in redacted(df, "space", "id", "text").collect()}
    assert clean[("t", 2)] == "mail [EMAIL] now" and clean[("t", 3)] is None and clean[("t", 4)] == "" and clean[("u", 1)].endswith("hi [EMAIL]")
    assert personal_data(df.limit(0), "space", "id", "text").count() == 0


#: Wordings that no rule was written on: text, the piece, its type.
UNSEEN = [
    ("The parcel was signed for by Laura Bennett at noon", "Laura Bennett", "name"), ("Please forward this to my colleague Omar Haddad today", "Omar Haddad", "name"), ("Hello Priya Raman, your slot is confirmed", "Priya Raman", "name"),
    ("Yours faithfully\nGeorge A. Whitmore", "George A. Whitmore", "name"), ("Reporter: Nadia Kowalska", "Nadia Kowalska", "name"), ("Yesterday Lucas Moreau complained about the delay", "Lucas Moreau", "name"),
    ("Ich bin Karin Vogel und brauche Hilfe", "Karin Vogel", "name"), ("Sehr geehrter Herr Jonas Weber, danke", "Jonas Weber", "name"), ("Soy Elena Vargas de Sevilla", "Elena Vargas", "name"),
    ("Bonjour Camille Durand, merci", "Camille Durand", "name"), ("С уважением, Ольга Смирнова", "Ольга Смирнова", "name"), ("Invite Sofia Lindqvist to the review", "Sofia Lindqvist", "name"),
    ("Deliver to 48 Maple Street, Springfield, IL 62704 please", "48 Maple Street, Springfield, IL 62704", "address"), ("Er wohnt in der Bahnhofstraße 77, 50667 Köln", "Bahnhofstraße 77, 50667 Köln", "address"),
    ("Rendez-vous au 9 avenue Victor Hugo, 69002 Lyon", "9 avenue Victor Hugo, 69002 Lyon", "address"), ("Mi casa: Calle Serrano 21, 28001 Madrid", "Calle Serrano 21, 28001 Madrid", "address"), ("Адрес: ул. Гагарина, д. 14, кв. 3", "ул. Гагарина, д. 14, кв. 3", "address"),
    ("Fax: 0221 4567890", "0221 4567890", "phone"), ("ring me on 020 7946 0958 tonight", "020 7946 0958", "phone"), ("my mobile is (415) 555-0134", "(415) 555-0134", "phone"), ("+49 30 901820 ist die Nummer", "+49 30 901820", "phone"), ("手机：138 1234 5678", "138 1234 5678", "phone"),
    ("mail an k.vogel [at] firma [dot] de bitte", "k.vogel [at] firma [dot] de", "email"), ("write me: lucas_m@post.example", "lucas_m@post.example", "email"), ("ana (at) correo (dot) es", "ana (at) correo (dot) es", "email"),
    ("SSN 219-09-9999 on file", "219-09-9999", "id_number"), ("My passport number is X1234567", "X1234567", "id_number"), ("DNI: 12345678Z", "12345678Z", "id_number"),
]


def test_recall_on_unseen_wording():
    hit, n = {}, {}
    for text, piece, kind in UNSEEN:
        n[kind] = n.get(kind, 0) + 1
        hit[kind] = hit.get(kind, 0) + ((text.index(piece), text.index(piece) + len(piece), kind) in spans(text))
    missed = [(t, p) for t, p, k in UNSEEN if (t.index(p), t.index(p) + len(p), k) not in spans(t)]
    assert all(hit[k] / n[k] >= 0.9 for k in n), (hit, n, missed)


def test_what_only_looks_like_a_name_or_a_number():
    for text in ("Contact Support Team", "Call Harbor Street Station", "Hello Dear Customer", "see Release Notes from Monday", "IBAN DE89 3704 0044 0532 0130 00", "Tell Me Which One", "Dear Mr Johnson", "order 5144-3328-73 shipped"):
        assert spans(text) == [], text
