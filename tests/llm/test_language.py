import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language as L


@pytest.fixture(scope="module")
def model(spark, data):
    return L.fit_model(spark, data.replace("sf0.001", "sf0.01"))


EN, DE, FR, ES = "The lantern answers slowly near the harbour.", "Der laute Hund knarrt neben dem Schlüssel in Veseinesse.", "On entend une guitare brève et puis le marché qui ronfle.", "Se oye una estación fuerte y luego el arroyo que resuena."
ZH, JA = "说话的人觉得这个邻居比那个钟楼更沉重。", "市場のそばでにぎやかな太鼓が歌っています。"


@pytest.mark.parametrize(
    "text,want",
    [
        (EN, ["en"]), (DE, ["de"]), (FR, ["fr"]), (ES, ["es"]), (ZH, ["zh"]), (JA, ["ja"]), (f"{EN} {EN}\n{DE}", ["en", "de"]), (f"{ZH} {EN} {JA}", ["zh", "en", "ja"]), (f"{FR} {ES} {FR}", ["fr", "es", "fr"]),
        (f"{EN} Zelirath Vorona.", ["en"]), (f"<think></think>{DE}", ["de"]), (EN.upper(), ["en"]), ("", []), ("<audio>", []), ("... !!", []),
        ((EN[:-1] + " " + EN[:-1] + " " + DE[:-1] + " " + DE[:-1]).lower(), ["en", "de"]),
    ],
)
def test_segments(model, text, want):
    got = model.segments(text)
    assert [s[0] for s in got] == want and all(0 <= s[1] <= 1 for s in got)


def test_labels(spark):
    given = ["en", "EN-us", "english", "de_DE", "es-419", "zho", "mul", "und", "", None, "Japanese", "xx"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(L.normal_label(F.col("v"))).collect()] == ["en", "en", "en", "de", "es", "zh", None, None, None, None, "ja", None]


def test_detectable():
    assert L.detectable("one two three four") and not L.detectable("one two <b> three 4") and L.detectable("一二三四五六七八") and not L.detectable("一二三四五六七")


def test_declared_labels_mostly_hold(spark, data):
    rows = L.label(spark, data).where("n_segments = 1 and detectable and declared is not null").agg(F.avg((F.col("lang") == F.col("declared")).cast("int")), F.count("*")).first()
    assert rows[0] > 0.9 and rows[1] > 200


def _groups(*rows):
    return [dict(zip(("tbl", "host", "address", "declared", "count"), r)) for r in rows]


def _trust(right=0.9):
    label = {("t", l): {d: right if d == l else (1 - right) / 6 for d in (None, *L.LANGUAGES)} for l in L.LANGUAGES}
    return L.Trust(label, {}, 0.05)


def test_priors_follow_host_and_label():
    p = L.host_priors(_groups(("t", "h", None, "de", 300), ("t", "h", None, None, 5), ("t", "o", None, "en", 600), ("t", "rare", None, None, 1)), _trust())
    assert p["t", "h", None, None]["de"] > 0.8 and p["t", "o", None, "en"]["en"] > 0.95
    assert abs(sum(p["t", "rare", None, None].values()) - 1) < 1e-9 and p["t", "rare", None, None]["en"] > p["t", "rare", None, None]["de"]  # as in the table


def test_trust_is_learned(model):
    rows = [("t", EN, "en", None)] * 40 + [("t", EN, "de", None)] * 10 + [("t", DE, "de", "de")] * 30 + [("t", f"{EN} {DE}", "en", None)] * 5
    t = L.Trust.fit(model, rows)
    assert 0.7 < t.label["t", "en"]["en"] < 0.8 and 0.15 < t.label["t", "en"]["de"] < 0.25 and t.address["de"]["de"] > 0.8 and 0 < t.change < 0.5


@pytest.mark.parametrize("text", ["Qwxo Brrtk Kempfx Odzuya.", "音楽"])
def test_label_and_host_decide_weak_texts(model, text):
    for lang in L.LATIN if text.isascii() else ("zh", "ja"):
        (got, sure, _), = model.segments(text, {l: 0.9 if l == lang else 0.02 for l in L.LANGUAGES})
        assert got == lang and sure < 0.999


@pytest.mark.parametrize("text,own", [(EN, "en"), (DE, "de"), (FR, "fr"), (ES, "es"), (ZH, "zh"), (JA, "ja")])
def test_strong_texts_overrule_label_and_host(model, text, own):
    for lang in L.LANGUAGES:
        assert [s[0] for s in model.segments(text, {l: 0.95 if l == lang else 0.01 for l in L.LANGUAGES})] == [own]


def test_evidence_against_lowers_the_confidence(model):
    prior = lambda lang: {l: 0.9 if l == lang else 0.02 for l in L.LANGUAGES}
    weak = "Qwxo Brrtk near Kempfx."
    assert model.segments(weak, prior("en"))[0][1] > model.segments(weak, prior("de"))[0][1]
    mixed = f"{EN} {DE}"
    assert model.segments(mixed, prior("en"))[0][1] > model.segments(mixed, prior("fr"))[0][1]
