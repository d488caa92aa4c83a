from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from corpusflow.llm import language as L

DATA = Path("/root/testdata")


def test_sentences_keep_offsets():
    text = '“Who sells it?” asks Mizu. Yes…\n\n# Head\nLast line'
    assert [text[a:b] for a, b in L.sentences(text)] == ['“Who sells it?”', "asks Mizu.", "Yes…", "# Head", "Last line"]
    assert L.sentences("") == [] and L.sentences(" \n ") == []


def test_labels(spark):
    labels = [None, "", " ", "??", "und", "EN", " en", "en_GB", "English", "português ", "ru-RU", "rus", "русский", "Italian", "xx", "klingon"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    from pyspark.sql import functions as F

    got = [r.c for r in df.select(L.label_code(F.col("l")).alias("c")).collect()]
    assert got == [None] * 5 + ["en"] * 4 + ["pt", "ru", "ru", "ru", "italian", None, "klingon"]


@pytest.fixture(scope="module")
def model(spark):
    return L.fit_model(spark.read.parquet(str(DATA / "sf0.01/documents.parquet")), "doc_id", "text", "lang", sample_sentences=4000)


def test_held_out_accuracy(model):
    rows = pd.read_parquet(DATA / "sf0.1/sentences.parquet").dropna(subset=["lang", "sent_text"]).iloc[::7]
    rows = rows[rows.lang.isin(L.LANGUAGES) & (rows.sent_text.str.split().str.len() >= 4)]
    p = model.confidence(np.array([sum(model.word(w) for w in L._words(t)) for t in rows.sent_text]))
    right = np.array(L.LANGUAGES)[p.argmax(1)] == rows.lang.to_numpy()
    assert right.mean() > 0.995


def test_mixed_inserted_and_wordless(model):
    en = "The old captain hides the rusty knife behind the chapel. "
    ru = "Старый капитан прячет ржавый нож за часовней. "
    texts = [en * 3 + ru, en * 3 + "The baker (за часовней) sells the honey cake in the attic.", "1.\n2.", None, "", ru * 2, "# On the narrow bridge"]
    out = L.judge(model, {}, texts)
    assert [[s[0] for s in o] for o in out] == [["en", "ru"], ["en"], [], [], [], ["ru"], ["en"]]
    assert texts[0][slice(*out[0][1][2:4])].strip() == ru.strip() and out[6][0][4] == 0
    assert all(0 <= s[1] <= 1 for o in out for s in o)


def test_deterministic():
    samples = [(["the", "old", "captain"], 1), (["der", "alte", "kapitän"], 0)] * 30
    a, b = L.train(samples), L.train(samples)
    assert np.array_equal(a.scores, b.scores) and a.temperature == b.temperature


def test_operator(spark, model):
    rows = [(1, "The old captain hides the rusty knife behind the chapel. " * 5000, "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, segments string")
    got = {r.doc_id: r.segments for r in L.language_segments(df, ["doc_id"], "text", model).collect()}
    assert [s.lang for s in got[1]] == ["en"] and got[1][0].n_sentences == 5000 and got[2] == [] and got[3] == []
    assert L.language_segments(df.limit(0), ["doc_id"], "text", model).count() == 0
    nothing = L.fit_model(df.limit(0), "doc_id", "text", "segments")
    assert L.language_segments(df, ["doc_id"], "text", nothing).count() == 4


#: Sentences of languages that no label names, two of each.
FOREIGN = {
    "it": ["La vecchia signora nasconde la chiave di ferro dietro la cappella del villaggio.", "Domani mattina partiremo presto per la montagna con i nostri amici."],
    "nl": ["De oude kapitein verbergt het roestige mes achter de kapel in het dorp.", "Morgen vertrekken wij vroeg naar de bergen met onze vrienden."],
    "pl": ["Stary kapitan chowa zardzewiały nóż za kaplicą na skraju wsi.", "Jutro rano wyruszymy w góry z naszymi przyjaciółmi."],
    "tr": ["Yaşlı kaptan paslı bıçağı köyün kenarındaki şapelin arkasına saklıyor.", "Yarın sabah arkadaşlarımızla dağlara gideceğiz."],
    "bg": ["Старият капитан крие ръждясалия нож зад параклиса в края на селото.", "Утре сутринта тръгваме рано за планината с нашите приятели."],
    "sv": ["Den gamle kaptenen gömmer den rostiga kniven bakom kapellet i byn.", "I morgon bitti åker vi tidigt till bergen med våra vänner."],
    "zh": ["老船长把生锈的刀藏在村边的教堂后面。", "明天早上我们和朋友们一起去山里。"],
}


def test_foreign_languages_are_rejected(model):
    texts = [t for ts in FOREIGN.values() for t in ts]
    out = L.judge(model, {}, texts)
    assert sum([s[0] for s in o] == ["und"] for o in out) >= 0.9 * len(texts)
    mixed = "The old captain hides the rusty knife behind the chapel. " * 3 + texts[0]
    assert [s[0] for s in L.judge(model, {}, [mixed])[0]] == ["en", "und"]


def test_a_language_left_out_is_rejected(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    rows = pd.read_parquet(DATA / "sf0.1/sentences.parquet").dropna(subset=["lang", "sent_text"]).iloc[::23]
    rows = rows[rows.sent_text.str.split().str.len() >= 5]
    for out in L.LANGUAGES:
        m = L.fit_model(docs, "doc_id", "text", "lang", [x for x in L.LANGUAGES if x != out], sample_sentences=5000)
        assert out not in m.languages and len(m.languages) == 6
        # A label is wrong now and then: only texts that the other rows call by it as well are of the language.
        there = [s[0][0] if s else None for s in L.judge(m, {}, rows[rows.lang == out].sent_text.tolist())]
        kept = [s[0][0] if s else None for s in L.judge(m, {}, rows[rows.lang.isin(m.languages)].sent_text.tolist())]
        assert sum(x == "und" for x in there) >= 0.9 * len(there) and sum(x == "und" for x in kept) <= 0.02 * len(kept), out


def test_languages_come_from_the_labels(spark, tmp_path):
    """A language outside the usual ones is learned from its labels; a right label of an unknown language is never called wrong."""
    usual = spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).select("doc_id", "text", "lang")
    words = "la vecchia signora nasconde chiave ferro dietro cappella villaggio domani mattina partiremo montagna nostri amici".split()
    rnd = np.random.default_rng(1)
    say = lambda: " ".join(" ".join(rnd.choice(words, 7)).capitalize() + "." for _ in range(4))
    more = spark.createDataFrame([(10_000_000 + i, say(), "it-IT") for i in range(40)] + [(20_000_000, FOREIGN["pl"][0], "pl"), (20_000_001, FOREIGN["tr"][0], None), (20_000_002, say(), "en"), (20_000_003, None, "it"), (20_000_004, "", None)], "doc_id long, text string, lang string")
    usual.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert L.fit_model(docs, "doc_id", "text", "lang").languages == ("de", "en", "es", "fr", "it", "pt", "ru", "uk")
    got = {(r.doc_id, r.lang_found) for r in L.p8_found(spark, str(tmp_path)).where("doc_id >= 10000000").collect()}
    assert got == {(20_000_002, "it")}
    assert L.p8_documents(spark, str(tmp_path)).where("doc_id = 20000001").first().lang_found == "und"
