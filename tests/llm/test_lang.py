from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import lang

SAMPLES = {
    "en": ["The old road was closed because nobody had repaired the bridge.", "They should have told us what the people in the house were doing."],
    "de": ["Die alte Straße war gesperrt, weil niemand die Brücke repariert hatte.", "Sie hätten uns sagen sollen, was die Leute in dem Haus gemacht haben."],
    "fr": ["La vieille route était fermée parce que personne n'avait réparé le pont.", "Ils auraient dû nous dire ce que les gens de la maison faisaient."],
    "ru": ["Старая дорога была закрыта, потому что никто не починил мост.", "Они должны были сказать нам, что делали люди в этом доме."],
}
MORE = {
    "en": "The people who were in the old house told us that nobody had closed the road.",
    "de": "Die Leute in dem alten Haus haben uns gesagt, dass niemand die Straße gesperrt hatte.",
    "fr": "Les gens de la vieille maison nous ont dit que personne n'avait fermé la route.",
    "ru": "Люди в старом доме сказали нам, что никто не закрыл эту дорогу.",
}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(k, t) for k, v in SAMPLES.items() for t in v], "lang string, text string")


@pytest.fixture(scope="module")
def model(samples):
    return lang.fit(samples)


def test_labels(spark):
    cases = {
        "en": "en", "EN": "en", " en_US ": "en", "en-GB": "en", "eng": "en", "English": "en", "GER": "de", "deu": "de", "fr-CA": "fr", "es-419": "es", "Dutch": "nl",
        "und": None, "mul": None, "xx": None, "n/a": None, "unknown": None, "": None, " ": None, None: None, "bg": None, "english text": None, "en/de": None, "zh": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", lang.stated(F.col("l")).alias("s"))
    assert {r.l: r.s for r in df.collect()} == cases


def test_prose_only():
    text = (
        "# A title that is long enough to look like a whole sentence.\n\n"
        "The first sentence uses APP.USERS and `a_b` in the middle. Then\nthe second one goes on\r\nover lines!\n"
        "SELECT the, old, road FROM the_house WHERE nobody = 1; -- A remark behind a statement that is long enough to count.\n\n"
        "```sql\nUPDATE x\n   SET y = 1\n-- Inside of a fence there is one more remark to read.\n WHERE z = 2;\n```\n"
        '- An item (mit einer kurzen Bemerkung) that has "noch eine" in it twice over.\n'
    )
    got = [(s.text.strip(), s.full) for s in lang.sentences(text)]
    assert got == [
        ("the first sentence uses and in the middle", True),
        ("then the second one goes on over lines", True),
        ("a remark behind a statement that is long enough to count", True),
        ("inside of a fence there is one more remark to read", True),
        ("an item that has in it twice over", True),
        ("mit einer kurzen bemerkung", False),
        ("noch eine", False),
    ]
    for s in lang.sentences(text):
        assert s.text.split()[0] in text[s.start : s.stop].lower()


def detected(spark, model, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, confidence string")
    return {r.doc_id: r for r in lang.detect(df, model).collect()}


def test_pure_mixed_and_empty(spark, model):
    texts = [*MORE.values(), MORE["de"] * 3 + " " + MORE["fr"], MORE["en"] + "\n-- " + MORE["ru"], None, "", "SELECT 1;", (MORE["fr"] + " ") * 20_000, MORE["en"].upper()]
    got = detected(spark, model, texts)
    assert [got[i].lang for i in range(4)] == list(MORE)
    assert {s.lang for s in got[4].segments} == {"de", "fr"} and got[4].lang == "de"
    assert [s.lang for s in got[5].segments] == ["en", "ru"]
    for i in (6, 7, 8):
        assert got[i].lang is None and got[i].confidence is None and got[i].segments == []
    assert got[9].lang == "fr" and len(got[9].segments) == 20_000 and got[9].confidence > 0.99
    assert got[10].lang == "en"


def test_unstated(spark, model):
    short = MORE["en"] + ' "noch eine kurze Bemerkung"'
    rows = [
        (1, MORE["en"], "en", 0), (2, MORE["en"], "de", 0), (3, MORE["en"] + " " + MORE["de"], "DE", 0), (4, short, "eng", 0),
        (5, MORE["fr"], None, 0), (5, MORE["fr"], None, 0), (None, MORE["ru"], "mul", 0), (7, None, None, 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, s long")
    got = sorted((r.doc_id or -1, r.lang) for r in lang.unstated(df, model).collect())
    assert got == [(-1, "ru"), (2, "en"), (3, "en"), (5, "fr")]
    assert lang.unstated(df.limit(0), model).count() == 0


def test_wrong_labels_do_not_mislead_the_fit(spark, samples):
    rows = [(i, " ".join([MORE[k]] * 3), "de" if i % 3 == 0 else k) for i, k in enumerate(list(MORE) * 20)]
    m = lang.fit(samples, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ll = m.likelihoods([s.text for t in MORE.values() for s in lang.sentences(t)])
    assert [m.langs[i] for i in ll.argmax(axis=1)] == list(MORE)


def test_held_out_accuracy_of_mixture():
    """Languages that add less than the penalty leave, others stay."""
    ll = np.array([[0.0, -60.0, -70.0], [-50.0, 0.0, -80.0], [0.0, -1.0, -90.0]])
    pi, post = lang.mixture(ll, np.array([0, 0, 1]), 2, np.array([200.0, 100.0]))
    assert (pi[0] > 0).tolist() == [True, True, False] and (pi[1] > 0).tolist() == [True, False, False]
    assert post.argmax(axis=1).tolist() == [0, 1, 0]


def test_one_sentence_of_a_very_long_document_keeps_its_language():
    n = 150_000
    ll = np.tile([0.0, -100.0, -100.0], (n + 2, 1))
    ll[n // 2] = [-100.0, 0.0, -100.0]
    pi, post = lang.mixture(ll, np.array([0] * n + [1, 1]), 2, np.array([n * 60.0, 120.0]))
    assert (pi[0] > 0).tolist() == [True, True, False] and (pi[1] > 0).tolist() == [True, False, False]
    assert post[n // 2].argmax() == 1


# These were at hand when the margin was chosen; what it is worth is for HELD_OUT to say.
FOREIGN = {
    "pl": "Po zmianie schematu wszystkie raporty trzeba było uruchomić jeszcze raz, ponieważ stare dane były niekompletne.",
    "sv": "Efter ändringen av schemat måste alla rapporter köras om eftersom de gamla uppgifterna var ofullständiga.",
    "fi": "Tällä viikolla lisäsimme uuden indeksin, joka nopeuttaa asiakkaiden tilausten hakua huomattavasti.",
    "tr": "Bu hafta müşteri siparişlerinin aranmasını oldukça hızlandıran yeni bir dizin ekledik ve denedik.",
}


@pytest.fixture(scope="module")
def fitted(spark, tiny):
    d = tiny.replace("0.001", "0.01")  # models of few documents know too little to tell what is foreign
    return lang.fit(spark.read.parquet(f"{d}/lang_samples.parquet"), spark.read.parquet(f"{d}/documents.parquet"))


def test_language_without_samples_is_unknown(spark, fitted):
    assert fitted.langs == sorted(lang.LABELS)
    english = " The report was run again because the old data were incomplete and nobody had noticed it."
    rows = [(i, t, "en") for i, t in enumerate(FOREIGN.values())] + [(10 + i, t + english, "en") for i, t in enumerate(FOREIGN.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lang.detect(docs, fitted).collect()}
    assert [got[i].lang for i in range(len(FOREIGN))] == [lang.UNKNOWN] * len(FOREIGN)
    for i in range(len(FOREIGN)):
        assert [s.lang for s in got[10 + i].segments] == [lang.UNKNOWN, "en"]
    assert lang.unstated(docs, fitted).count() == 0


def test_known_documents_stay_known(spark, tiny, fitted):
    rows = lang.detect(spark.read.parquet(f"{tiny}/documents.parquet"), fitted).select(F.explode("segments").alias("s")).where("s.full").select("s.*").collect()
    assert len(rows) > 100 and sum(r.lang == lang.UNKNOWN for r in rows) <= 0.01 * len(rows)


def test_languages_come_from_the_samples(spark, samples):
    polish = ["Stara droga była zamknięta, ponieważ nikt nie naprawił mostu nad rzeką.", "Powinni byli nam powiedzieć, co robili ludzie w tym starym domu."]
    more = samples.unionByName(spark.createDataFrame([(" PL", t) for t in polish], "lang string, text string"))
    m = lang.fit(more)
    assert m.langs == ["de", "en", "fr", "pl", "ru"]
    docs = spark.createDataFrame([(1, "Ludzie w starym domu powiedzieli nam, że nikt nie zamknął tej drogi.", "pl")], "doc_id long, text string, lang string")
    r = lang.detect(docs, m).first()
    assert (r.lang, r.stated) == ("pl", "pl")
    with pytest.raises(ValueError):
        lang.fit(samples.limit(0))


def test_confidence_falls_with_fewer_words(spark, fitted):
    """Single words, of another field than the sample's, are in doubt: the wrong ones more than the right ones."""
    words = {"de": "Straße Brücke gemacht haben wird", "en": "nobody should road while which", "fr": "vieille maison était leur dans", "it": "strada vecchia erano gli ponte"}
    rows = [(i, w, own) for i, (own, w) in enumerate((own, w) for own, ws in words.items() for w in ws.split())]
    got = lang.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fitted).collect()
    right = [r.confidence for r in got if r.lang == r.stated]
    wrong = [r.confidence for r in got if r.lang is not None and r.lang != r.stated]
    assert len(right) > 2 * len(wrong) and min(right + wrong) < 0.9
    assert np.mean(right) > np.mean(wrong)


def test_model_is_saved(tmp_path, model):
    model.save(str(tmp_path / "m"))
    again = lang.Model.load(str(tmp_path / "m"))
    assert again.langs == model.langs and (again.likelihoods([" the road "]) == model.likelihoods([" the road "])).all()


# Languages and sentences that had no part in choosing the margin.
HELD_OUT = {
    "hu":["A régi adatok hiányosak voltak, ezért minden kimutatást újra le kellett futtatni a szerveren.","Kérjük, ellenőrizze, hogy a szállítási dátum oszlopa helyesen lett-e kitöltve a következő lépés előtt."],
    "sk":["Staré údaje boli neúplné, preto bolo potrebné znova spustiť všetky zostavy na serveri.","Pred ďalším krokom skontrolujte, či je stĺpec s dátumom dodania správne vyplnený."],
    "hr":["Stari podaci bili su nepotpuni pa je sva izvješća trebalo ponovno pokrenuti na poslužitelju.","Prije sljedećeg koraka provjerite je li stupac s datumom isporuke ispravno popunjen."],
    "et":["Vanad andmed olid puudulikud, seetõttu tuli kõik aruanded serveris uuesti käivitada.","Enne järgmist sammu kontrollige, kas tarnekuupäeva veerg on õigesti täidetud."],
    "lt":["Seni duomenys buvo neišsamūs, todėl visas ataskaitas serveryje teko paleisti iš naujo.","Prieš kitą žingsnį patikrinkite, ar pristatymo datos stulpelis užpildytas teisingai."],
    "lv":["Vecie dati bija nepilnīgi, tāpēc visi pārskati serverī bija jāpalaiž no jauna.","Pirms nākamā soļa pārbaudiet, vai piegādes datuma kolonna ir aizpildīta pareizi."],
    "sq":["Të dhënat e vjetra ishin të paplota, prandaj të gjitha raportet u desh të ekzekutoheshin përsëri.","Para hapit tjetër kontrolloni nëse kolona me datën e dorëzimit është plotësuar saktë."],
    "id":["Data lama tidak lengkap sehingga semua laporan harus dijalankan kembali pada server itu.","Sebelum langkah berikutnya, periksa apakah kolom tanggal pengiriman sudah diisi dengan benar."],
    "vi":["Dữ liệu cũ không đầy đủ nên tất cả các báo cáo phải được chạy lại trên máy chủ.","Trước bước tiếp theo hãy kiểm tra xem cột ngày giao hàng đã được điền đúng chưa."],
    "no":["De gamle opplysningene var ufullstendige, og derfor måtte alle rapportene kjøres på nytt i går.","Kontroller at kolonnen med leveringsdatoen er riktig utfylt før du går videre til neste trinn."],
    "bg":["Старите данни бяха непълни и затова всички отчети трябваше да бъдат изпълнени отново на сървъра.","Преди следващата стъпка проверете дали колоната с датата на доставка е попълнена правилно."],
    "sr":["Стари подаци су били непотпуни па је све извештаје требало поново покренути на серверу.","Пре следећег корака проверите да ли је колона са датумом испоруке исправно попуњена."],
    "gl":["Os datos antigos estaban incompletos e por iso houbo que executar de novo todos os informes.","Antes do seguinte paso comprobe se a columna coa data de entrega está ben cuberta."],
    "af":["Die ou data was onvolledig en daarom moes al die verslae weer op die bediener uitgevoer word.","Kontroleer voor die volgende stap of die kolom met die afleweringsdatum korrek ingevul is."],
    "uk":["Старі відомості були неповними, тому всі звіти довелося запускати знову на сервері.","Перед наступним кроком перевірте, чи правильно заповнено стовпець із датою доставки."],
}


def test_held_out_languages_are_unknown(spark, fitted):
    """26 of 30 when this was written; Galician was taken for Spanish and Afrikaans for Dutch."""
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, own in HELD_OUT.items() for t in own)]
    got = lang.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fitted).collect()
    assert sum(r.lang == lang.UNKNOWN for r in got) >= 26
