import random
import zlib

import numpy as np
import pytest

from tesserae.llm import langid, toxicity
from tesserae.llm.char_ngrams import MIX, PLACES, TextBatch

from .conftest import edge_rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def speech(spark):
    """Texts in four made-up languages, some with a rude word."""
    rng = random.Random(11)
    words = {
        "en": "the and that with which there ought house weather thing".split(),
        "de": "der und dass mit welche dort sollte haus wetter ding schön".split(),
        "fr": "le et que avec laquelle là-bas devrait maison été chose".split(),
        "es": "el y que con la cual allí debería casa verano cosa niño".split(),
    }
    docs, labels = [], []
    for i in range(1200):
        lang = rng.choice(list(words))
        text = [rng.choice(words[lang]) for _ in range(rng.randint(4, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vermin", "scoundrel"]))
        docs.append((i, " ".join(text), lang if i % 9 else None))
        labels.append((i, 1, toxic if i % 11 else None))
    truth = {d[0]: x[2] for d, x in zip(docs, labels, strict=True)}
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth, {d[0]: d[2] for d in docs}


def test_toxicity_on_held_out_rows(speech):
    docs, labels, truth, _ = speech
    got = toxicity.toxicity(docs, labels, sample_rows=400).collect()
    assert len(got) == 1200 and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.97
    left = toxicity.drop_toxic(docs, labels, sample_rows=400)
    assert left.columns == docs.columns and left.count() == sum(not r.predicted for r in got)


def test_toxicity_at_the_edges(docs, no_docs, speech, spark):
    _, labels, _, _ = speech
    got = toxicity.toxicity(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(no_docs, labels).collect() == []


def test_language_on_held_out_rows(speech):
    docs, _, _, langs = speech
    got = langid.language_id(docs, sample_rows=200).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out and langs[r.doc_id]]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in judged]) > 0.97


def test_language_at_the_edges(docs, no_docs):
    got = {(r.doc_id, r.lang_pred) for r in langid.language_id(docs).collect()}
    assert {(4, "und"), (5, "und"), (6, "und"), (None, "und")} <= got
    assert {p for _, p in got} <= {"en", "fr", "und"}
    assert langid.language_id(no_docs).collect() == []
    untaught = langid.predict(docs, langid.fit([], [])).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def bucket(gram, bits):
    """Bucket of an n-gram, a character at a time."""
    word = 0xFFFFFFFF
    h = 0
    for place, c in zip(PLACES.tolist(), gram, strict=False):
        h = h + ord(c) * place & word
    h ^= len(gram)
    h ^= h >> 15
    h = h * int(MIX) & word
    h ^= h >> 13
    h = h * int(PLACES[1]) & word
    return h >> 32 - bits


def test_toxicity_scores_by_hand(speech):
    """Every score again from the model's weights, gram by gram; long texts are learnt from and scored whole."""
    docs, labels, truth, _ = speech
    long = docs.sparkSession.createDataFrame([(5000, "the house " * 20_000 + "vermin")], "doc_id long, text string")
    model = toxicity.train(docs.select("doc_id", "text").union(long), labels)
    for r in toxicity.score(docs.select("doc_id", "text").limit(40).union(long), model).collect():
        text = "the house " * 20_000 + "vermin" if r.doc_id == 5000 else next(x.text for x in docs.where(f"doc_id = {r.doc_id}").collect())
        if len(text) < 2000:
            # grams at a text's end reach into its padding, which is a character of its own
            found = {int(model.place[bucket((text.lower() + "\0" * 6)[i : i + n], toxicity.BITS)]) for n in toxicity.ORDERS for i in range(len(text))}
            margin = model.bias + sum(model.weights[f] for f in found if f >= 0)
            assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-9)
        else:
            assert r.score > 0.5


def test_language_margins_by_hand(speech):
    """Every prediction again from the machines' weights, gram by gram."""
    docs, _, _, _ = speech
    model = langid.train(docs)
    rows = docs.limit(25).collect()
    got = {r.doc_id: r for r in langid.predict(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), model).collect()}
    for r in rows:
        text = r.text.lower()
        table = model.table.astype(np.float64)
        margins = model.biases + 100 / len(text) * sum(table[bucket((text + "\0" * 6)[i : i + n], langid.BITS)] for n in langid.ORDERS for i in range(len(text)))
        top = model.families[int(np.argmax(margins[: len(model.families)]))]
        votes = dict.fromkeys(model.members[top], 0)
        for k, (family, a, b) in enumerate(model.pairs):
            if family == top:
                votes[a if margins[len(model.families) + k] > 0 else b] += 1
        assert got[r.doc_id].lang_pred == max(votes, key=votes.get)


def test_sample_of_a_heavy_language(spark):
    """The rows of least hash, whether a language is thinned out beforehand or not."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN 'fr' ELSE 'en' END AS lang")
    hashed = df.selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h").collect()
    got = {(r.doc_id, r.lang) for r in langid.sample_ids(df, 300).collect()}
    want = {(r.doc_id, r.lang) for lang in ("en", "fr") for r in sorted((x for x in hashed if x.lang == lang), key=lambda x: (x.h, x.doc_id))[:300]}
    assert got == want


def test_families():
    assert langid.family_of("en") == langid.family_of("de") != langid.family_of("fr") == langid.family_of("es")
    assert langid.family_of("xx") == "xx"


def test_grams_do_not_cross_texts():
    together = TextBatch(["abcdef", "", "xyz", None])
    for i, text in enumerate(["abcdef", "", "xyz", ""]):
        alone = TextBatch([text])
        for order in (2, 5):
            a = together.grams(order, 20)[together.starts[i] : together.ends[i]]
            assert a.tolist() == alone.grams(order, 20)[: len(text)].tolist()
    assert together.sums(np.ones(len(together.points) - 6)).tolist() == [6, 0, 3, 0]
