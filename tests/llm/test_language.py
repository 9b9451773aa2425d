from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import language as L

DOCS = "doc_id long, text string, lang string, confidence string"
PHRASES = {
    "en": ("the planner", "every reviewer", "nobody", "a slow worker", "checks", "forgets", "writes down", "the open list", "an old report", "two broken links", "after lunch", "before the release", "with some care", "because it rains"),
    "de": ("der Planer", "jede Gutachterin", "niemand", "ein langsamer Arbeiter", "prüft", "vergisst", "notiert", "die offene Liste", "einen alten Bericht", "zwei kaputte Verweise", "nach dem Essen", "vor der Freigabe", "mit etwas Sorgfalt", "weil es regnet"),
    "fr": ("le planificateur", "chaque relectrice", "personne", "un ouvrier lent", "vérifie", "oublie", "note", "la liste ouverte", "un vieux rapport", "deux liens cassés", "après le repas", "avant la publication", "avec un peu de soin", "parce qu'il pleut"),
    "ru": ("планировщик", "каждый рецензент", "никто", "медленный работник", "проверяет", "забывает", "записывает", "открытый список", "старый отчёт", "две битые ссылки", "после обеда", "перед выпуском", "с некоторой осторожностью", "потому что идёт дождь"),
}


def sentence(rng, lang):
    p = PHRASES[lang]
    s = f"{rng.choice(p[:4])} {rng.choice(p[4:7])} {rng.choice(p[7:10])} {rng.choice(p[10:])}"
    return s[0].upper() + s[1:] + "."


def text(rng, lang, n=6):
    return " ".join(sentence(rng, lang) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    docs = [(lang, text(rng, lang)) for lang in PHRASES for _ in range(30)]
    docs += [("fr", text(rng, "en")) for _ in range(10)] + [("ru", text(rng, "de")) for _ in range(5)]  # wrong labels
    return L.train_models(docs)


def found(spark, model, docs):
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS)
    return sorted((r["doc_id"], r["lang"]) for r in L.mislabelled(L.document_languages(df, model)).collect())


@pytest.mark.parametrize("label,want", [(None, None), ("", None), (" ", None), ("EN", "en"), ("en_GB", "en"), (" en-us ", "en"), ("eng", "en"), ("English", "en"), ("ger", "de"), ("fr-CA", "fr"), ("und", None), ("mul", None), ("??", None), ("n/a", None), ("text", None), ("pt-BR", "pt"), ("Dutch", "nl"), ("entity", None), ("null", None)])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "c string").select(L.label_language(F.col("c"))).first()[0] == want


def test_probabilities_sum_to_one():
    model = L.fit_models({"en": ["abab abba", "bab aab b"]}, 0.0)
    for context in ("", "a", "ab", "bab ", "b a"):
        # Every character of the model and all unseen ones together fill the mass.
        total, seen = 0.0, set("ab ")
        for c in seen:
            total += _probability(model, context, c)
        total += (256 - len(seen)) * _probability(model, context, "z")
        assert abs(total - 1) < 1e-4, context


def _probability(model, context, c):
    codes = np.array([2] * 4 + [ord(" ")] + [ord(x) for x in context + c], dtype=np.uint64)
    hashes = L._grams(codes)
    log = 0.0
    for k in range(L.ORDER, 0, -1):
        at = L._lookup(model.keys[k], hashes[k][-1:])[0]
        if at >= 0:
            return float(np.exp(log + model.logs[k][at, 0]))
        back = L._lookup(model.contexts[k], hashes[k - 1][-2:-1])[0]
        log += model.backs[k][back, 0] if back >= 0 else 0.0
    return float(np.exp(log)) / 256


def test_held_out_accuracy_despite_wrong_labels(model):
    rng = random.Random(9)
    for lang in PHRASES:
        units = [u.words for u in L.units_of(text(rng, lang, 40))]
        got, post = model.classify(units)
        assert np.mean([model.langs[g] == lang for g in got if g >= 0]) > 0.97 and np.mean(got >= 0) > 0.9


def test_foreign_text_is_rejected(model):
    units = ["uusi sääntökokoelma tarkistaa kaikki odottavat tehtävät pitkän tauon jälkeen", "nikt nie wie dlaczego plik zniknął z katalogu głównego wczoraj"]
    assert (model.classify(units)[0] < 0).all()


def test_documents(spark, model):
    rng = random.Random(4)
    en, de, fr = (lambda n, x=lang: text(rng, x, n) for lang in ("en", "de", "fr"))
    code = "const facet = new Map();\nif (!token) return null;\n.a-b { margin: 3px; }\n[10:11:12] OK scan_lease 12 ms\n"
    docs = [
        (1, en(4), "en"), (2, en(4), "English"), (3, en(4), "de"), (4, en(4), None), (5, en(4), "und"), (6, en(1), None), (7, None, None), (8, "", None), (9, " \n", None),
        (10, en(3) + "\n\n" + de(3), "en"), (11, en(3) + " " + de(1) + " " + en(3), "en"), (12, code, None), (13, code + "\n// " + "\n// ".join(fr(3).split(". ")), "en"),
        (14, en(3) + ' ("' + de(1)[:40] + '")', "en"), (15, "\n".join("- " + sentence(rng, "fr") for _ in range(3)), "fr-CA"), (16, "\r\n".join("* " + sentence(rng, "de") for _ in range(3)), None),
        (17, de(4).encode().decode("latin-1"), "de"), (18, L._bare(fr(5)), "fr"), (19, en(200) + de(3), "en"), (20, code + en(1) + "\n" + code + en(1), "de"),
        (4, docs_text := en(2), None), (4, docs_text, None),
    ]
    assert found(spark, model, docs) == [(3, "en"), (4, "en"), (5, "en"), (10, "de"), (10, "en"), (13, "fr"), (16, "de"), (19, "de"), (19, "en")]


def test_segments_have_confidence_and_order(spark, model):
    rng = random.Random(5)
    df = spark.createDataFrame([(1, text(rng, "en", 3) + "\n\n" + text(rng, "de", 3) + "\n\n" + text(rng, "en", 2), "en", "")], DOCS)
    seg = L.language_segments(df, model, with_text=True).orderBy("segment").collect()
    assert [(r["lang"], r["n_units"]) for r in seg] == [("en", 3), ("de", 3), ("en", 2)] and all(0.9 <= r["confidence"] <= 1 for r in seg)
    assert all(r["text"] for r in seg)


def test_empty_tables_and_no_labels(spark, model):
    none = spark.createDataFrame([], DOCS)
    assert L.document_languages(none, model).collect() == [] and L.document_languages(none).collect() == []
    assert L.document_languages(spark.createDataFrame([(1, "Some text. More text.", None, "")], DOCS)).collect() == []


def test_repair_bytes():
    assert L.repair_bytes("Die Ã\x9cbersicht zÃ¤hlt")[0] == "Die Übersicht zählt" and L.repair_bytes("naïve ÄÖ")[0] == "naïve ÄÖ"
    assert L.repair_bytes("Привет".encode().decode("cp1252", "replace").replace("�", "?"))[0]


def test_labelled_majority_of_the_corpus_agrees(spark):
    if not SF.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    out = L.document_languages(docs.select("doc_id", "text", "lang")).where("n_languages = 1")
    known = out.withColumn("k", L.label_language(F.col("label"))).where("k IS NOT NULL")
    assert known.where("k = lang").count() > 0.8 * known.count()


def test_units_say_where_they_stand():
    text = "Intro one. Second sentence here!\n  // A comment that\n  // goes on. And ends\n- entry Ã¤Ã¶â€¦ done\nlast"
    raw = [text[u.start : u.end] for u in L.units_of(text)]
    assert raw == ["Intro one.", "Second sentence here!", "A comment that\n  // goes on.", "And ends", "entry Ã¤Ã¶â€¦", "done", "last"]
    assert L.units_of("wait â€¦")[0].end == len("wait â€¦")


def test_a_stored_model_is_the_same(spark):
    rng = random.Random(5)
    docs = [(i, text(rng, lang, 30), lang) for i, lang in enumerate(["en", "de", "fr"] * 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    L._FITTED.clear()
    first = L.shared_models(df)
    L._FITTED.clear()
    again = L.shared_models(df)
    assert again is not first and again.langs == first.langs and (again.bound == first.bound).all()
    assert all((a == b).all() for name in ("keys", "logs", "contexts", "backs") for a, b in zip(getattr(first, name), getattr(again, name)))
