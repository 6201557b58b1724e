"""Rows that share an id, repeated rows and null ids in the near-duplicate search."""
import corpus_pipeline
from flowlens.llm import embedup, langid, neardup

from .test_dedup import near_by_hand, near_rows, vectors_by_hand

X = [f"x{i}" for i in range(40)]
Y = [f"y{i}" for i in range(40)]
X2, Y2 = " ".join([*X[:-1], "other"]), " ".join([*Y[:-1], "other"])
X, Y = " ".join(X), " ".join(Y)
#: id 1 bears two texts and is the smallest id of both sets; each text has a near copy of its own.
ROWS = [(1, X), (1, Y), (5, X2), (6, Y2), (7, X2), (7, X2), (8, "alone " + "in its words " * 3), (None, Y), (None, X2)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, rep string").repartition(3)


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    assert near_rows(neardup.near_duplicates(docs_of(spark, ROWS), 5, 80)) == near_by_hand(ROWS, 5, 80)


def test_pipeline_stage_keeps_one_row_of_each_group(spark):
    nulls = [(None, "only without an id " * 5)] * 3
    repeated = [(20, "row that repeats itself " * 6)] * 40
    docs = docs_of(spark, ROWS + nulls + repeated)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, X), (1, Y), ROWS[6], nulls[0], repeated[0]], key=str)


def test_a_vector_id_with_several_vectors_and_labels(spark):
    """Each row has the links of its own vector and label; a row's id only joins components."""
    a, b, c = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.1], [0.0, 0.0, 1.0, 0.1]
    near = [[x + d for x in v] for v, d in ((a, 0.01), (b, 0.02), (c, 0.03))]
    rows = [(1, a, 0), (1, b, 0), (1, a, 1), (2, near[0], 0), (3, near[0], 1), (4, near[1], 0), (2, c, 0), (5, near[2], 0),
            (5, near[2], 0), (6, a, 0), (7, c, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedup.near_vectors(df, 0.9).collect())
    assert got == vectors_by_hand(rows, 0.9)


def test_training_rows_of_one_id_keep_their_own_language(spark):
    one, two = "the cat and the dog of the house", "el gato y el perro de la casa"
    rows = [(i % 3, (one if i % 2 else two) + f" {i}", "en" if i % 2 else "es") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    assert langid.judge(model, [one, two])[0] == ["en", "es"]


def test_numerals_are_no_letters(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "el gato y el perro", "es")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    lang, score, _ = langid.judge(model, ["½ ² 12", "① ②", "Ⅷ ٣ 12", "_ - !", "", None, "ª", "日", "a1"])
    assert lang[:6] == ["und"] * 6 and "und" not in lang[6:] and not score[:6].any()
