import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.columns import bare_id, clean, first_nonblank, slug
from lectern.functions.labels import normalize_label


def one(spark, value, c, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(c.alias("x")).first().x


def test_words_sentences_syllables(spark):
    t = "Naïve Bayesian models can't fail. Really?! They may (e.g. now)."
    ws = one(spark, t, X.tokens("t"))
    assert ws == ["naïve", "bayesian", "models", "can't", "fail", "really", "they", "may", "e", "g", "now"]
    assert one(spark, t, X.sentence_count("t")) == 4
    assert [one(spark, w, X.syllable_count(F.array("t"))) for w in ("table", "create", "the", "naïve", "rhythm", "eye")] == [2, 1, 1, 1, 1, 1]


def test_phrases_overlap(spark):
    assert one(spark, "a b a b a", X.phrase_count(F.split("t", " "), "a b a")) == 2
    assert one(spark, "a", X.phrase_count(F.split("t", " "), "a b")) == 0


def test_markup(spark):
    cases = {"<p>A &amp; B</p>": "A & B", "x < 5 and y > 3": "x < 5 and y > 3", "cost $5 and $10": "cost $5 and $10", r"${H_\infty}$ norm": "norm", r"a \alpha b": "a b", None: None, "": ""}
    for k, v in cases.items():
        assert one(spark, k, X.strip_markup("t")) == v


def test_inverted_index(spark):
    assert one(spark, "to be or not to be", X.text_of_index(X.inverted_index("t"))) == "to be or not to be"
    kind = "map<string, array<int>>"
    assert one(spark, {}, X.text_of_index("t"), kind) == "" and one(spark, None, X.text_of_index("t"), kind) is None
    for bad in ({"a": [0], "b": [0]}, {"a": [-1]}):
        with pytest.raises(Exception, match="positions"):
            one(spark, bad, X.text_of_index("t"), kind)


def test_scrubbing_takes_longest_names_first(spark):
    df = spark.createDataFrame([("Ann Lee's work; ann lee, Annabel and Lee.", ["Lee", "Ann Lee", "A.(x"])], "t string, n array<string>")
    assert df.select(X.scrub(F.col("t"), F.col("n"), "_").alias("x")).first().x == "_ work; _, Annabel and _."


def test_normalisers(spark):
    assert one(spark, " https://doi.org/10.1/ABC ", X.doi("t")) == "10.1/abc" and one(spark, "doi: 10.1/X", X.doi("t")) == "10.1/x" and one(spark, " ", X.doi("t")) is None
    assert one(spark, "The  <b>Ötzi</b>!", X.title_key("t")) == "the b ötzi b"
    assert one(spark, "https://x.invalid/W12/", bare_id("t")) == "W12" and one(spark, "  ", bare_id("t")) is None and one(spark, "W1", bare_id("t")) == "W1"
    assert one(spark, "  x ", clean("t")) == "x" and one(spark, " ", first_nonblank("t", F.lit("z"))) == "z"
    assert one(spark, " Lab-Page ", slug("t")) == "lab_page" and one(spark, " Partially supported", normalize_label("t")) == "partially_supported" and one(spark, "odd", normalize_label("t")) is None
    assert one(spark, "Straße Ⅳ", X.fold("t")) == unicodedata.normalize("NFKC", "Straße Ⅳ").casefold()
    assert one(spark, "a b c", X.word_count("t")) == 3 and one(spark, " ", X.word_count("t")) == 0


def test_json_in_replies_and_secrets(spark):
    assert one(spark, 'Sure:\n```json\n{"a": {"b": 2}}\n``` done', F.try_variant_get(X.json_object("t"), "$.a.b", "int")) == 2
    assert one(spark, "no json", X.json_object("t")) is None
    assert one(spark, "key sk-abcdefghij0123456789", X.any_secret("t")) and not one(spark, None, X.any_secret("t"))


def test_syllables_of_a_text_are_those_of_its_words(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["agree tree le ye be the co-operate can't rhythm — café-crème b--c 'tis e é naïve style bye apple", "", "Ωμέγα straße  hme"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(X.text_syllable_count("t") != X.syllable_count(X.tokens("t"))).count() == 0
