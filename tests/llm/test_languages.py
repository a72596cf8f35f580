import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import languages as lg

SENTENCES = {
    "en": "the {} was closed because nobody had renewed the lease; we found that the {} answered too late and the next run starts again",
    "de": "die {} wurde nicht geschlossen, weil niemand die Frist verlängert hatte; der {} brach ab und wir haben das zweimal besprochen",
    "es": "la {} no se cerró porque nadie renovó el plazo a tiempo; el {} devolvió una respuesta vacía y así se queda por ahora",
    "fr": "la {} ne trouvait plus son successeur parce que personne n'avait prolongé le délai; le {} attendait toujours une réponse",
    "nl": "de {} werd niet gesloten omdat niemand de termijn had verlengd; het {} gaf een leeg antwoord terug en dat blijft zo",
    "pt": "a {} não foi fechada porque ninguém renovou o prazo a tempo; o {} devolveu uma resposta vazia e assim fica por agora",
}
NOUNS = "index timer register cursor schema bridge queue vector planner journal".split()


@pytest.fixture(scope="module")
def model():
    texts = [(k, f"{s.format(a, b).capitalize()}.") for k, s in SENTENCES.items() for a in NOUNS for b in NOUNS[:4]]
    return lg.train(texts, np.ones(lg.BUCKETS))


def test_held_out_accuracy(model):
    other = {"en": "Which means that all of the old answers have been kept there.", "de": "Das bleibt vorerst so, obwohl der Grund längst entfallen ist.", "es": "Según el informe, los ambos usaban el mismo identificador.", "fr": "Les deux copies sont d'accord, mais le rapport ne le disait pas.", "nl": "Het rapport liet dat niet zien, hoewel we het hadden besproken.", "pt": "O relatório não o mostrava, embora já tivéssemos falado disso."}
    assert {k: model.segments(t)[0][0] for k, t in other.items()} == {k: k for k in other}
    assert 0.05 < model.temperature <= 5


def test_segments(model):
    en, de = SENTENCES["en"].format("x", "y").capitalize() + ".", SENTENCES["de"].format("x", "y").capitalize() + "."
    text = f"{en} {de} — {en}"
    got = model.segments(text)
    assert [s[0] for s in got] == ["en", "de", "en"]
    assert [text[s[2] : s[3]] for s in got] == [en, de, en] and all(0 <= s[1] <= 1 for s in got)
    assert model.segments(None) == model.segments("") == model.segments("123 :: q-55e") == []
    assert [s[0] for s in model.segments(" ".join([en] * 3000))] == ["en"]


def test_labels(spark):
    rows = ["en", "EN ", "eng", "English", "en-GB", "pt_BR", "Dutch", "it", "uncertain", "", None, "e n"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "c string").select(lg.label(F.col("c"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "pt", "nl", "other", None, None, None, "other"]


def test_records(spark, model):
    en, de = SENTENCES["en"].format("x", "y") + ".", SENTENCES["de"].format("x", "y") + "."
    hits = spark.createDataFrame([(1, en, "en", 0), (2, en, "de", 0), (3, en, None, 0), (4, f"{de} {en}", "German", 0), (5, None, None, 0), (6, "99", None, 0), (None, en, None, 0)], "hit_id long, entry_text string, lang string, text int")
    got = sorted((r.rec_id, r.seg_no, r.lang) for r in lg.relabelled_hits(hits, model).collect())
    assert got == [("2", 1, "en"), ("3", 1, "en"), ("4", 1, "de"), ("4", 2, "en")]
    log = spark.createDataFrame([("w1", en), ("w1", en), ("w1", de), ("w2", de), ("w3", None), (None, en), ("w4", en)], "world string, title string").selectExpr("*", "null text", "null learning", "null choice", "null why")
    conf = spark.createDataFrame([("w1", "DE"), ("w2", "deu"), ("w3", None), ("w4", "uncertain"), ("w5", None)], "world string, config_language string")
    assert sorted((r.rec_id, r.lang, round(r.confidence, 2)) for r in lg.relabelled_worlds(conf, log, model).collect()) == [("w1", "en", 0.67), ("w4", "en", 1.0)]
    assert lg.relabelled_hits(hits.limit(0), model).count() == 0


def test_fit_from_tables(spark):
    rows = [(i * 10 + n, SENTENCES[k].format(a, a) + ".", k.upper()) for i, a in enumerate(NOUNS) for n, k in enumerate(SENTENCES)] + [(999, None, "en"), (998, "x", None)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    m = lg.fit(docs, docs.select("text"))
    assert all(m.segments(SENTENCES[k].format("relay", "alias"))[0][0] == k for k in SENTENCES)
    assert m.segments("")[0:] == []
