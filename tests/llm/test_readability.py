from pyspark.sql import functions as F

from lectern.llm import readability as R

EASY = "The cat sat on the mat. We ran in the sun. It was fun for all of us."
HARD = "Methodological considerations necessitate longitudinal characterisation of heterogeneous institutional interventions notwithstanding incomparable documentation."


def frame(spark, n=30):
    rows = [(i, EASY if i % 3 else HARD, 1.0 if i % 3 else 30.0) for i in range(n)]
    return spark.createDataFrame(rows, "k long, t string, g double")


def test_lines_words_and_sentences(spark):
    df = spark.createDataFrame([(1, "<p>One two.</p><p>Three</p>\n- four five!\n\n"), (2, "e.g. x < 5 and y > 3"), (3, None), (4, ""), (5, "<br>")], "k int, t string")
    got = {r.k: (list(r.words), r.sentences) for r in R.text_shape(df, "t").collect()}
    assert got[1] == (["one", "two", "three", "four", "five"], 3)
    assert set(got) == {1, 2}


def test_formula_orders_texts_and_survives_wrong_grades(spark):
    df = frame(spark).withColumn("g", F.when(F.col("k") == 4, 55.0).when(F.col("k") == 5, None).when(F.col("k") == 7, float("nan")).otherwise(F.col("g")))
    shaped = R.text_shape(df, "t").drop("t")
    familiar = R.familiar_words(shaped, "g")
    assert "cat" in familiar and "longitudinal" not in familiar
    f = R.formula_features(shaped, familiar, ["k", "g"])
    beta, _ = R.fit_formula(f, "g", "k")
    grade = {r.k: r.x for r in f.select("k", R.formula_grade(beta).alias("x")).collect()}
    assert all(grade[k] < 8 for k in grade if k % 3) and all(grade[k] > 20 for k in grade if k % 3 == 0)


def test_without_grades_and_empty(spark):
    df = frame(spark).withColumn("g", F.lit(None).cast("double"))
    shaped = R.text_shape(df, "t")
    assert R.fit_formula(R.formula_features(shaped, R.familiar_words(shaped, "g"), ["k", "g"]), "g", "k")[0] == R.DEFAULT_FORMULA
    empty = R.text_shape(df.filter(F.lit(False)), "t")
    assert R.familiar_words(empty, "g") == frozenset() and R.formula_features(empty, frozenset(), ["k"]).count() == 0


def test_very_long_text_and_empty_words_of_none(spark):
    df = spark.createDataFrame([(1, "word " * 200_000 + "."), (2, "The cat sat."), (3, ""), (4, None)], "k int, t string").repartition(1)
    f = R.formula_features(R.text_shape(df, "t"), frozenset({"cat", "word"}), ["k"])
    got = {r.k: (r.n_words, r.unfamiliar, r.sentence_length) for r in f.collect()}
    assert got == {1: (200_000, 0.0, 200_000.0), 2: (3, 2 / 3, 3.0)}
