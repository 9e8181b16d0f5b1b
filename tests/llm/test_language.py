import itertools

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm import catalog, language

SF = "/root/testdata/sf0.001"


def value(scores, path):
    return scores[np.arange(len(path)), path].sum() - language.PENALTY * (np.diff(path) != 0).sum()


def test_path_is_the_best_of_all_paths():
    dice = np.random.default_rng(0)
    for _ in range(60):
        scores = -dice.exponential(6, (dice.integers(1, 7), 3))
        best = max(value(scores, np.array(p)) for p in itertools.product(range(3), repeat=len(scores)))
        assert np.isclose(value(scores, language.best_path(scores)), best)


def test_shortcut_never_loses_to_the_full_search():
    dice = np.random.default_rng(1)
    for _ in range(500):
        scores = -dice.exponential(3, (dice.integers(1, 40), 3))
        if (constant := language.constant_path(scores)) >= 0:
            assert value(scores, np.full(len(scores), constant)) >= value(scores, language.best_path(scores)) - 1e-6


def test_held_out_accuracy(spark):
    found = catalog.op2_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    both = found.join(docs, "doc_id")
    assert both.count() == docs.count()
    assert both.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert both.where(~F.col("score").between(0, 1)).count() == 0


def test_mixed_text_and_odd_rows(spark):
    english, german = "the cat and the dog were on the street with them ", "der Hund und die Katze waren auf der Straße "
    model = language.learn(spark.createDataFrame([(english * 5, "en"), (german * 5, "de"), ("Привет мир это текст", "ru"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model[0] == ["de", "en", "ru"]
    texts = [english * 3 + german * 2, None, "", "123 !!", "мир", "漢字", english * 20000, "the"]
    docs = spark.createDataFrame([(i, t, "de", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    rows = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(8)][:5] == ["en", "und", "und", "und", "ru"]
    assert [(s.start, s.end, s.lang) for s in rows[0].spans] == [(0, len(english * 3) - 1, "en"), (len(english * 3), len(texts[0]) - 1, "de")]
    assert 0.5 < rows[0].score < 0.8 and rows[5].lang_pred in model[0] and rows[6].lang_pred == "en" and rows[7].lang_pred == "en"
    assert language.identify(docs.withColumn("lang", F.lit("en")).limit(0)).count() == 0
    kept = language.identified(docs.withColumn("lang", F.lit("en")).union(docs.withColumn("lang", F.lit("en"))))
    assert kept.columns == [*docs.columns, "lang"]


def test_even_mixtures_stay(spark):
    """A text in three languages, none with half of its letters, is kept; one in a script that wasn't learned isn't."""
    parts = {"en": "the cat and the dog were on the street with them ", "de": "der Hund und die Katze waren auf der Strasse ", "ru": "Привет мир это простой текст "}
    rows = [(i, t * 5, lang) for i, (lang, t) in enumerate([*parts.items()] * 6)]
    docs = spark.createDataFrame([*rows, (100, "".join(t * 3 for t in parts.values()), "en"), (None, "漢字" * 9, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.identified(docs).collect()) == [*range(18), 100]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(None, "some text", "en")], "doc_id long, text string, lang string")
    assert [(r.held_out, r.lang_pred, r.score) for r in language.identify(docs).collect()] == [(True, "und", 0.0)]


def slot_of(*points):
    """The slot of a trigram of lower-case letters (0: none)."""
    mixed = 0
    for p, factor in zip(points, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True):
        mixed ^= p * factor
    return (mixed & 0xFFFFFFFF) * 0x27D4EB2F % (1 << 32) >> (32 - language.SLOT_BITS)


def short_slot(word):
    code = 7
    for c in word:
        code = (code * 0x01000193 + ord(c)) % (1 << 32)
    return code * 0x9E3779B1 % (1 << 32) >> (32 - language.SLOT_BITS)


def features(word):
    padded = [0, *map(ord, word), 0]
    slots = [slot_of(*padded[i : i + 3]) for i in range(len(word))]
    return slots + ([short_slot(word)] if len(word) <= language.SHORT_WORD else [])


def test_scores_against_plain_counts(spark):
    """Learned counts, script narrowing and word scores, by dictionaries."""
    rows = [("Der Hund und die Katze", "de"), ("the cat and the dog", "en"), ("Привет мир", "ru"), ("le chat et le chien", "fr"), ("ο σκύλος the", "el")]
    langs, logs, scripts = language.learn(spark.createDataFrame(rows * 2, "text string, lang string"))
    assert langs == ["de", "el", "en", "fr", "ru"]
    counts = {lang: {} for lang in langs}
    for text, lang in rows * 2:
        for word in text.lower().split():
            for slot in features(word):
                counts[lang][slot] = counts[lang].get(slot, 0) + 1
    used = len({s for c in counts.values() for s in c})
    text = "the katze мир σκύλος dog"
    found = language.word_scores(language.Words([text]), logs, scripts)
    open_to = {"L": ["de", "el", "en", "fr"], "C": ["ru"], "G": ["el"]}
    for i, (word, script) in enumerate(zip(text.split(), "LLCGL", strict=True)):
        own = {lang: sum(np.log((counts[lang].get(s, 0) + language.SMOOTHING) / (sum(counts[lang].values()) + language.SMOOTHING * used)) for s in features(word)) for lang in open_to[script]}
        best = max(own.values())
        expected = [max(own[lang] - best, -language.WORD_BOUND) if lang in own else -language.FOREIGN for lang in langs]
        assert np.allclose(found[i], expected, atol=1e-3)


def test_many_languages(spark):
    """Hundreds of labels, each with a word of its own, are told apart."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 2
    docs = spark.createDataFrame([(2 * i + k, f"{name(i)} {name(i)}", f"l{i:03}") for i in range(600) for k in range(2)], "doc_id long, text string, lang string")
    found = language.predict(docs, language.learn(docs)).join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 1190 and found.count() == 1200
