import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import with_extra
from millrace.llm.prose import paragraphs, sentences
from millrace.llm.reading import LanguageModel, boilerplate_of, choose_penalty, cross_entropy, features, fit, fit_sentences, language_model, levels_of, parsed, reading_levels
from millrace.sources.tables import table

HARD = "Notwithstanding the considerable provenance of the underlying orthogonality, the concomitant serialization of indexed declarations necessitates precisely that counterfactual idempotence, cf. the preceding section of version 2.4."


def test_prose_in_any_dress():
    want = sentences(HARD)
    assert len(want) == 1
    wrapped = HARD.replace(" the underlying", "\nthe underlying")
    for dress in (wrapped, "\n".join("> " + x for x in wrapped.split("\n")), "\n".join("// " + x for x in wrapped.split("\n")), f"<p>{HARD}</p>", "# Title\n\n" + HARD, HARD.replace("serialization", "seriali-\nzation"), "- a list\n- of terms\n\n" + HARD):
        assert sentences(dress) == want, dress


def test_what_is_no_prose():
    for text in ("", "# A heading. Of words", "```\nIf this is code. Then it is not prose.\n```", "2025-01-16T00:12:26Z ERROR store: the record was lost. a=1", "\tif x == y {\n\t\treturn. x\n\t}", "- one\n- two", "Der Index zählt den alten Stand nach jeder Änderung, und das Fenster ordnet die Liste."):
        assert sentences(text) == [], text
    assert paragraphs("Der Index zählt den alten Stand.") != []


def test_features_are_of_their_own_sentence():
    batch = ["a first one.", "another, longer sentence of words.", "x y z", "a first one."]
    number, starts, words = features(batch)
    parts = np.split(number, starts[1:])
    assert words.tolist() == [3, 5, 3, 3]
    for s, own in zip(batch, parts):
        alone, _, _ = features([s])
        assert sorted(alone) == sorted(own)


def test_held_out_accuracy(spark, sf):
    where = sf.replace("0.001", "0.1")
    labels = table(spark, where, "level_labels").where("doc_id IS NOT NULL AND level_no IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = reading_levels(table(spark, where, "documents"), labels.where(~held))
    truth = labels.where(held).groupBy("doc_id").agg(F.round(F.avg("level_no")).cast("int").alias("want"), F.min("level_no").alias("low"), F.max("level_no").alias("high")).where("low = high")
    met = truth.join(got.where("level_no IS NOT NULL"), "doc_id").select("want", "level_no").collect()
    assert len(met) > 100
    assert np.mean([r.want == r.level_no for r in met]) > 0.9
    assert np.mean([(r.want == 3) == (r.level_no == 3) for r in met]) > 0.98


def test_edges(spark):
    docs = with_extra(spark.createDataFrame([(1, HARD), (1, HARD), (2, None), (None, HARD), (3, ""), (4, "word " * 100_000)], "doc_id long, text string"), "TEXT", "p0")
    none = spark.createDataFrame([], "doc_id long, level_no int, rater string, labelled_at timestamp")
    got = {r.doc_id: r.level_no for r in reading_levels(docs, none).collect()}
    assert got == {1: None, 3: None, 4: None}
    assert reading_levels(docs.limit(0), none).count() == 0


def test_model_is_deterministic():
    samples = [([f"the cat has {i} lines."], np.eye(4)[0]) for i in range(6)] + [([f"number {i} of the requisite heterogeneity underdetermines it."], np.eye(4)[3]) for i in range(6)]
    a, b = fit(samples), fit(samples)
    assert np.array_equal(a.weights, b.weights)
    assert levels_of(a, [["number 9 of the requisite heterogeneity underdetermines it."], ["the cat has 3 lines."], []])[0][0] == 3


NOUNS = "provenance orthogonality idempotence serialization concomitance heterogeneity normalization determinacy".split()
NOTICE = "see the notes in the store package for the details of this flag."


def hard(i):
    a, b, c = NOUNS[i % 8], NOUNS[i // 8 % 8], NOUNS[i // 64 % 8]
    return f"Notwithstanding the considerable {a} of the underlying {b}, the concomitant {c} of declaration {i} necessitates precisely that requisite counterfactual which the antecedent formalism of the {a} had presupposed."


def plain(i):
    return f"The cat has {i} lines. We read it and it is good. You can run it {i % 7} times."


def test_copies_are_no_boilerplate(spark):
    text = " ".join(hard(i) for i in range(500, 506))
    near = [text.replace(f"declaration {500 + i % 6}", f"clause {i}") for i in range(30)]
    others = [hard(i) if i % 2 else plain(i) for i in range(160)]
    docs = [(i, t + (" See the notes in the store package for the details of this flag." if i % 8 < 2 else "")) for i, t in enumerate(others)]
    docs += [(1000 + i, text) for i in range(80)] + [(2000 + i, t) for i, t in enumerate(near)]
    labels = [(i, 3 if i % 2 else 0, "a", None) for i in range(160)] + [(1000 + i, 3, "a", None) for i in range(80)]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    assert boilerplate_of(parsed(documents)) == {NOTICE}
    got = {r.doc_id: r.level_no for r in reading_levels(documents, spark.createDataFrame(labels, "doc_id long, level_no int, rater string, labelled_at timestamp")).collect()}
    assert all(got[i] == 3 for i, _ in docs[160:])
    assert all(got[i] == (3 if i % 2 else 0) for i in range(160))


def test_no_running_text_is_emptied():
    samples = [([f"the cat has {i} lines."], np.eye(4)[0]) for i in range(6)] + [([f"number {i} of the requisite heterogeneity underdetermines it."], np.eye(4)[3]) for i in range(6)]
    own = [f"number {i} of the requisite heterogeneity underdetermines it." for i in range(20, 24)]
    text, notice = levels_of(fit(samples, frozenset([*own, NOTICE])), [own, [NOTICE]])
    assert text[0] == 3 and notice is None


def test_penalty_is_chosen_on_held_out_sentences(spark, sf):
    from millrace.llm.reading import PENALTIES, _flat, labelled_sample

    where = sf.replace("0.001", "0.1")
    sample = labelled_sample(parsed(table(spark, where, "documents").where("doc_id % 3 = 0")), table(spark, where, "level_labels"))
    first, held = [x for i, x in enumerate(sample) if i % 3], [x for i, x in enumerate(sample) if not i % 3]
    batch, targets = _flat(first, 8)
    error = {p: cross_entropy(fit_sentences(batch, targets, p), held) for p in (0.0, *PENALTIES, 1e-1)}
    chosen = choose_penalty(first, held)
    assert error[chosen] < error[0.0] - 0.01 and error[chosen] < error[1e-1] - 0.2 and chosen == min(PENALTIES, key=error.get)


GERMAN = "Der Index zählt den alten Stand nach jeder Änderung, und das Fenster {} ordnet die Liste der Zeilen ohne Rückfrage."


def test_language_is_learnt_from_labels(spark):
    texts = [[f"the index counts the old state after each change, and window {i} sorts the list of lines."] for i in range(20)] + [[GERMAN.format(i).lower()] for i in range(20)]
    labels = ["en"] * 19 + ["de"] * 20 + ["en"]  # one label is wrong
    model = LanguageModel(texts, labels)
    assert model.english([texts[3][0], texts[39][0], texts[25][0]]).tolist() == [True, False, False]
    docs = spark.createDataFrame([(i, t[0].capitalize(), a + ("-XX" if i % 2 else "")) for i, (t, a) in enumerate(zip(texts, labels))] + [(90, GERMAN.format(90), None), (91, "The index counts all lines.", "und"), (92, None, "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in parsed(docs).where("size(sentences) > 0").collect()} == {*range(20), 91}
    assert language_model(docs.where("lang LIKE 'en%'")) is None and language_model(docs.drop("lang")) is None and language_model(docs.limit(0)) is None


def test_licences_are_boilerplate(spark):
    licence = "This work is provided as it stands, without warranty of any kind, and no holder of the copyright is liable."
    docs = [(i, f"{hard(i)} {hard(i + 200)}\n\n{licence}") for i in range(30)] + [(30 + i, plain(i)) for i in range(60)] + [(99, f"one, two, three {licence}")]
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    assert boilerplate_of(parsed(documents)) == {licence.lower()}
    labels = spark.createDataFrame([(i, 3 if i < 30 else 0, "a", None) for i in range(90)], "doc_id long, level_no int, rater string, labelled_at timestamp")
    got = {r.doc_id: (r.level_no, r.sentences) for r in reading_levels(documents, labels).collect()}
    assert all(got[i] == (3, 2) for i in range(30)) and got[99] == (None, 0)
