import unicodedata

from pyspark.sql import functions as F

from lectern.llm.lookalike import CYRILLIC, GREEK, block, composed, decomposed, lookalike_classes, lookalike_pairs, plain_form, skeleton

TEXTS = {
    1: "A café at 5 o'clock", 2: "A café at 5 o'clock", 3: "Ａ café at ５ o'clock", 4: "А café at 5 o'clock", 5: "A ca​fé at 5 o'clock", 6: "A cafe at 5 o'clock",
    7: "a café at 5 o'clock", 8: "A café at 6 o'clock", 9: "A café at 5 o'clock", 10: "ﬁne oﬀer", 11: "fine offer", 12: None, 13: "", 14: "​", 15: "Привет всем", 16: "Привет всeм", 17: "x" * 100_000, 18: "х" + "x" * 99_999,
}


def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, t string").withColumns({"s": F.lit(1), "b": F.lit(2), "text_id": F.lit("z")})


def test_classes_and_pairs(spark):
    m = lookalike_classes(frame(spark).repartition(6), "id", "t")
    groups = {}
    for r in m.collect():
        groups.setdefault(r.class_id, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 5, 9], [10, 11], [13, 14], [15, 16], [17, 18]]
    assert {r.canonical_key for r in m.filter("id = 2").collect()} == {1} and {r.canonical_key for r in m.filter("id = 10").collect()} == {11}
    pairs = {(r.id_a, r.id_b) for r in lookalike_pairs(m, "id").collect()}
    assert (1, 9) not in pairs and {(1, 2), (2, 9), (10, 11), (13, 14), (15, 16), (17, 18)} <= pairs and all(a < b for a, b in pairs)


def test_exact_copies_alone_are_no_case_and_empty(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (None, "sаme")], "id long, t string")
    assert lookalike_classes(df, "id", "t").count() == 0
    assert lookalike_classes(df.filter(F.lit(False)), "id", "t").count() == 0


def test_readable_form_keeps_other_scripts(spark):
    df = spark.createDataFrame([("Привет, мир",), ("pаypal",), ("ﬁ x​y",)], "t string")
    assert [r.f for r in df.select(plain_form("t").alias("f")).collect()] == ["Привет, мир", "paypal", "fi xy"]
    assert [r.f for r in df.select(skeleton("t").alias("f")).collect()][1:] == ["paypal", "fi xy"]


def test_canonically_equal_texts_are_one_class(spark):
    greek = "Ο λόγος του ανθρώπου, Ὅμηρος ᾠδή ὁδός"
    texts = [greek, unicodedata.normalize("NFD", greek), "5 \u212a\u037e", "5 K;", "λογος", "λόγος", "λὸγος", "o\u0323\u0301", "ο\u0301\u0323"]
    letters = [c for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0] in CYRILLIC | GREEK]
    texts += [f"a{i} {c} b" for i, c in enumerate(letters)] + [f"a{i} {unicodedata.normalize('NFD', c)} b" for i, c in enumerate(letters)]
    of = {r.id: r.class_id for r in lookalike_classes(spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3), "id", "t").collect()}
    first = texts.index(f"a0 {letters[0]} b")
    equal = [(0, 1), (2, 3), (7, 8)] + [(first + i, first + len(letters) + i) for i, c in enumerate(letters) if unicodedata.normalize("NFD", c) != c]
    assert len(letters) > 90 and [(texts[i], texts[j]) for i, j in equal if of.get(i) is None or of.get(i) != of.get(j)] == []
    assert len({of[i] for i, _ in equal}) == len(equal) and not {4, 5, 6} & set(of)


def test_readable_form_of_composed_letters(spark):
    df = spark.createDataFrame([("cόat",), ("cο\u0301at",), ("λόγος abc",), ("\u044f\u0301\u044f abc\u043e",)], "t string")
    assert [r.f for r in df.select(composed(plain_form(decomposed("t"))).alias("f")).collect()] == ["cóat", "cóat", "λόγος abc", "\u044f\u0301\u044f abc\u043e"]


def test_width_forms_and_joined_letters_by_rule(spark):
    texts = ["\uff76\uff9e\uff92 a", "\u30ac\u30e1 a", "\u0133 x", "ij x", "\ufb13 y", "\u0574\u0576 y", "\uffe6 5", "\u20a9 5"]
    of = {r.id: r.class_id for r in lookalike_classes(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()}
    assert len(of) == len(texts) and all(of[i] == of[i + 1] for i in range(0, len(texts), 2)) and len(set(of.values())) == 4


def test_blocks_part_texts_of_other_scripts_and_keep_equal_ones_together(spark):
    words = ["\u043c\u0438\u0440", "\u043c\u0438\u0440\u044b", "\u03bb\u03cc\u03b3\u03bf\u03c2", "\u4f60\u597d", "\ud55c\uae00 a", "\u0915\u093c \u0958", "caf\u00e9", "\u1e69\u0323"]
    forms = [(i, unicodedata.normalize(f, w)) for i, w in enumerate(words) for f in ("NFC", "NFD")]
    got = {}
    for r in spark.createDataFrame(forms, "i int, t string").select("i", block("t").alias("b")).collect():
        got.setdefault(r.i, set()).add(r.b)
    assert all(len(b) == 1 for b in got.values()) and len({min(b) for b in got.values()}) == len(words)


def test_a_text_of_very_many_copies_is_compared_once(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 2 == 0, "same text").otherwise("same t\u0435xt").alias("t"))
    m = lookalike_classes(df, "id", "t")
    assert m.count() == 30_000 and m.select("text_id").distinct().count() == 2 and {r.canonical_key for r in m.select("canonical_key").distinct().collect()} == {0}


def test_ascii_texts_share_blocks_with_their_look_alikes(spark):
    rows = [(0, " \tplain text 5;K "), (1, "plain text 5\u037e\u212a"), (2, "\u200bplain\u00a0text 5;K"), (3, "plain text 5;k"), (4, ""), (5, "\u200b \t")]
    b = {r.i: r.b for r in spark.createDataFrame(rows, "i int, t string").select("i", block("t").alias("b")).collect()}
    assert b[0] == b[1] == b[2] != b[3] and b[4] == b[5] != b[3]
