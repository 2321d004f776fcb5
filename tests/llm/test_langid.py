import pytest

from weftline.llm import langid as L

TEXT = {
    "en": "The old man walks slowly to the harbour. Nobody knows what he is looking for there. He has always been like this.",
    "de": "Der alte Mann geht langsam zum Hafen. Niemand weiß, was er dort eigentlich sucht. Er war schon immer so.",
    "fr": "Le vieil homme marche lentement vers le port. Personne ne sait ce qu'il y cherche. Il a toujours été comme ça.",
    "es": "El viejo camina despacio hacia el puerto. Nadie sabe lo que está buscando allí. Siempre ha sido así.",
    "ru": "Старик медленно идёт к гавани. Никто не знает, что он там ищет. Он всегда был таким.",
    "zh": "老人慢慢地走向港口。没有人知道他在那里找什么。他一直是这样的。",
}


@pytest.fixture(scope="module")
def model():
    rows, labels = [], []
    for lang, text in TEXT.items():
        for s in L.sentences(text):
            rows.append(s)
            labels.append(lang)
    return L.train(rows * 12, labels * 12, epochs=8)


def test_labels():
    for text, code in [("EN", "en"), ("en_GB", "en"), ("zh-Hans", "zh"), ("ger", "de"), ("Spanish", "es"), (" pt-BR ", "pt"), ("xx", None), ("", None), (None, None), ("und", None), ("-", None)]:
        assert L.label_language(text) == code, text


def test_what_is_no_sentence():
    for line in ["", "   ", "2024-02-11T21:31:42Z worker=dabri lease=3085", "[2024-10-26T01:09:18Z] WARN PROXY=X CODE=301", "https://a.example/b?c=d", '{"sku": "KEL", "qty": 22, "name": "a b c"}', "5.37 | 10.14", "🇪🇺 🇺🇳", "<|end|> <s> [PAD]", "a b", "935e891c0c51e2c0efdb8a03e1c374aa3be3fbb4"]:
        assert L.sentences(line) == [], line
    assert len(L.sentences("1. One two three. Four five six! (Seven eight nine?)")) == 3
    assert len(L.sentences("我们用冷水、热水和醋都试过了。感谢你把船借给我们！")) == 2
    assert L.sentences("He said “bonjour tout le monde” and walked away again.")[0] == ["he", "said", "and", "walked", "away", "again"]


def test_judge_and_temperature(model):
    main, conf, parts = L.judge(model, [TEXT["fr"], f"{TEXT['en']}\n{TEXT['ru']}", None, "", "12:30", TEXT["de"].upper()])
    assert main[0] == "fr" and main[2:5] == [None] * 3 and main[5] == "de"
    assert {p[1] for p in parts[1]} == {"en", "ru"} and {p[0] for p in parts[1] if p[1] == "ru"} == {2}
    assert 0 < conf[0] <= 1 and model.temperature > 0
    assert L.Model.unpack(model.pack()).logits([["the", "old", "man"]]).argmax() == model.logits([["the", "old", "man"]]).argmax()


def test_query(spark, model):
    docs = [(1, TEXT["en"], "eng", "c"), (2, TEXT["en"], "de", "c"), (3, TEXT["en"], None, "c"), (4, f"{TEXT['de']}\n\n{TEXT['zh']}", "de", "c"), (5, None, "en", "c"), (6, "", None, "c"), (7, "1 2 3", "xx", "c"), (8, (TEXT["es"] + "\n") * 3000, "es", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, main string")
    got = sorted((r.doc_id, r.line_no, r.lang) for r in L.relabelled(L.classify(df, model)).collect())
    assert got == [(2, 1, "en"), (3, 1, "en"), (4, 1, "de"), (4, 3, "zh")]
    assert L.relabelled(L.classify(df.limit(0), model)).count() == 0


def test_fit_bounds_and_empty_samples(spark):
    samples = spark.createDataFrame([(i * 10 + k, lang, s) for i, (lang, t) in enumerate(TEXT.items()) for k, s in enumerate(t.split(". "))] * 3, "sample_id int, lang string, text string")
    documents = spark.createDataFrame([(i, TEXT["en"], "English") for i in range(20)], "doc_id long, text string, lang string")
    m = L.fit(samples, documents)
    assert L.judge(m, [TEXT["de"], TEXT["fr"]])[0] == ["de", "fr"]
    assert L.judge(L.fit(samples.limit(0)), [TEXT["de"]])[0] == [None]


def test_long_words_count_as_a_whole():
    idf = L.np.ones(L.BUCKETS, L.np.float32)
    word = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3 * L.PIECE + 17))
    idx, val = L.word_vector(word, idf)
    plain = L.np.array([L._bucket(g) for g in L._grams(word)])
    expected = L.np.bincount(plain, minlength=L.BUCKETS) / L.np.sqrt(len(plain))
    dense = L.np.zeros(L.BUCKETS)
    dense[idx] = val
    assert L.np.allclose(dense, expected)
    other = L.word_vector(word[:-1] + "!", idf)  # equal but for the last character
    assert len(other[0]) != len(idx) or not L.np.array_equal(other[0], idx)


def test_confidence_is_calibrated_on_held_out_documents():
    rows, labels, groups = [], [], []
    for d in range(40):
        for lang, text in TEXT.items():
            words = [w for s in L.sentences(text) for w in s]
            rows.append(words[d % 5 : d % 5 + 1 + d % 4])
            labels.append(lang)
            groups.append(d)
    m = L.train(rows, labels, groups, epochs=4)
    before, after = m.errors
    assert after <= before + 0.02
    assert L.Model.unpack(m.pack()).errors == m.errors
    _, conf, _ = L.judge(m, ["Der alte Mann geht langsam zum Hafen.", "Gato mano vino."])
    assert 0 < conf[1] < conf[0] <= 1
