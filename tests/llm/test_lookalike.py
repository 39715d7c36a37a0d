from palisade.llm.lookalike import SCRIPTS, UNSEEN, look_classes, plain, read_looks, reader, same_looks


def test_plain():
    assert plain("Ｗｉｄｅ：ｘ") == "Wide:x"
    assert plain("re​port") == "report" and plain("a b　c") == "a b c"
    assert plain("ﬁle liﬆ") == "file list"
    assert plain("n.º 5") == "n.º 5", "a superscript looks different"
    assert plain("👩‍💻") == "👩‍💻", "a joiner between pictures shows"
    assert plain("café") == plain("café")


def test_words_of_one_look_read_alike():
    model = {s: {("", "#"): -1.0 if s == "latin" else -3.0} for s in SCRIPTS}
    read = reader(model)
    assert UNSEEN < 0
    for w in ("paypal", "сор", "МВ", "рrоmрts", "4МВ7"):
        assert read(w) == read(w.translate(str.maketrans("аорсеМВ", "aopceMB")))
    assert read("слово") == "слово"


def test_pairs(spark):
    rows = [("t", 1, "stop the limit"), ("t", 2, "stоp thе limit"), ("t", 3, "ｓtop the limit"), ("t", 4, "stop the limit"), ("t", 5, "Stop the limit"), ("t", 6, "stop the  limit"), ("u", 7, "stоp the limit"), ("t", 8, None), ("t", 1, "stop the limit"), ("t", 9, "")]
    forms, pairs = same_looks(spark.createDataFrame([(*r, 1) for r in rows], "space string, id bigint, text string, form int"), "space", "id", "text")
    assert {tuple(r) for r in pairs.collect()} == {("t", 1, 2), ("t", 1, 3), ("t", 2, 3), ("t", 2, 4), ("t", 3, 4)}
    form = {r.id: r.form for r in forms.collect()}
    assert form[1] == form[2] == form[3] == "stop the limit" and form[9] == "" and 8 not in form


def test_empty(spark):
    forms, pairs = same_looks(spark.createDataFrame([], "space string, id bigint, text string"), "space", "id", "text")
    assert forms.count() == pairs.count() == 0


def test_classes_count_links_between_different_writings(spark):
    rows = [("t", 1, "stop the limit"), ("t", 2, "stоp thе limit"), ("t", 3, "stop the limit"), ("t", 4, "else"), ("t", 5, "Ꭺpple ɡo"), ("t", 6, "Apple go")]
    got = {(r.id, r.class_id, r.n_links) for r in look_classes(*read_looks(spark.createDataFrame(rows, "space string, id bigint, text string"), "space", "id", "text")).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 1), (5, 5, 1), (6, 5, 1)}
