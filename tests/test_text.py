import pytest
from pyspark.sql import functions as F

from vellum import config
from vellum.functions import scoring as S
from vellum.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,base,runs",
    [
        ("وزارة الثقافة", "rtl", [("وزارة الثقافة", "rtl")]),
        ("يعقد مؤتمر Digital Heritage في القاعة", "rtl", [("يعقد مؤتمر ", "rtl"), ("Digital Heritage", "ltr"), (" في القاعة", "rtl")]),
        ("الرقم 812 بتاريخ", "rtl", [("الرقم 812 بتاريخ", "rtl")]),
        ("نظام ECM 2025 الجديد", "rtl", [("نظام ", "rtl"), ("ECM 2025", "ltr"), (" الجديد", "rtl")]),
        ("Ref ١٢٣", "ltr", [("Ref ", "ltr"), ("١٢٣", "rtl")]),
        ("بِسْمِ اللَّهِ", "rtl", [("بِسْمِ اللَّهِ", "rtl")]),
        ("Ministry وزارة office", "ltr", [("Ministry ", "ltr"), ("وزارة", "rtl"), (" office", "ltr")]),
        ("", "rtl", []),
    ],
)
def test_bidi_runs(text, base, runs):
    assert T.bidi_runs(text, base) == runs


def test_bidi_runs_lose_nothing(spark):
    s = "تم إرسال الملف PDF إلى قسم IT قبل 15/10/2025، شكراً."
    got = one(spark, lambda c: T.bidi_run_array(c, F.lit("rtl")), s)
    assert "".join(r.text for r in got) == s


def test_language_and_direction(spark):
    for s, lang, d in (("وزارة الثقافة", "ar", "rtl"), ("Ministry of Culture", "en", "ltr"), ("نظام ECM الجديد", "mixed", "rtl"), ("123", None, "rtl"), (None, None, "rtl"), ("", None, "rtl")):
        assert (one(spark, T.language, s), one(spark, T.direction, s)) == (lang, d)


def test_dates(spark):
    get = lambda s: [(d.calendar, d.normalized, d.raw) for d in one(spark, lambda c: T.dates(c, F.lit("b")), s)]
    assert get("التاريخ: ١٢/٠٣/١٤٤٦ هـ الموافق 15/09/2024 م")[:2] == [("hijri", "1446-03-12", "١٢/٠٣/١٤٤٦ هـ"), ("gregorian", "2024-09-15", "15/09/2024 م")]
    assert [x[:2] for x in get("حرر في 5 رمضان 1445 هـ")] == [("hijri", "1445-09-05")]
    assert [x[:2] for x in get("Date: 3 March 2025")] == [("gregorian", "2025-03-03")]
    assert [x[1] for x in get("31/02/2024 13/13/2024 12/05/24 2024-5-6")] == ["2024-02-31", "2024-05-06"]
    assert get("217.94.102.185") == [] and get(None) == []


def test_document_numbers(spark):
    get = lambda s, own: [(d.value, d.value_latin, d.role) for d in one(spark, lambda c: T.doc_numbers(c, F.lit("b"), F.lit(own)), s)]
    assert get("الرقم: ٤/٣٢٤١", True) == [("٤/٣٢٤١", "4/3241", "self")]
    assert get("Ref. No.: 7/6547", False) == [("7/6547", "7/6547", "reference")]


def test_types_of_lines(spark):
    kind = lambda t, s: one(spark, T.refined_type, t, s)
    assert kind("paragraph", "الرقم: 1/6486") == "doc_number"
    assert kind("paragraph", "التاريخ: 16/02/1445 هـ") == "date"
    assert kind("paragraph", "بالإشارة إلى كتابكم رقم 812 وتاريخ 1/1/2024 بشأن الموضوع المذكور أعلاه والمرسل إلينا سابقاً") == "paragraph"
    assert kind("footer", "الرقم: 1/6486") == "footer" and kind("title", None) == "title"
    assert one(spark, T.line_kind, "Date: 02/10/2024") == "date" and one(spark, T.line_kind, "  ") is None


def test_agreement(spark):
    get = lambda a, b, d=False: one(spark, lambda x, y: S.agreement(x, y, d), a, b)
    assert get("بِسْمِ اللَّهِ", "بسم الله") == 1.0 and get("الرقم 14", "الرقم", True) == 1.0 and get("abc", "xyz") == 0.0
    assert get(None, "x") is None and get("", " ") == 1.0


def test_clean_output(spark):
    get = lambda s, t: one(spark, T.cleaned_output, s, t)
    r = get("```html\n<table><tr><td>a</td></tr></table>\n```", "table")
    assert (r.text, r.flags) == ("<table><tr><td>a</td></tr></table>", [])
    r = get("نص " + "مكرر جدا " * 10, "text")
    assert r.flags == ["repetition_truncated"] and r.text.count("مكرر") <= 2
    assert get("no table", "table").flags == ["no_html_table"]


def test_token_budget_and_adapters(spark):
    df = spark.range(1)
    f = lambda w, h, k: df.select(S.token_budget(F.lit(w), F.lit(h), F.lit(k), F.lit(40.0)).alias("x")).first()["x"]
    assert 32 <= f(300, 50, "text") < f(1400, 400, "text") < f(1400, 400, "table") <= 2048
    m = F.create_map(*(F.lit(x) for x in ("printed", "P", "handwritten", "H", "table", "T")))
    for t, want in (("paragraph", "P"), ("handwritten_note", "H"), ("table", "T")):
        assert df.select(T.adapter(m, F.lit(t)).alias("x")).first()["x"] == want
    assert "table" in df.select(T.prompt(F.lit("table")).alias("x")).first()["x"]


def test_rates(spark):
    df = spark.createDataFrame([("", "x"), ("", ""), ("ab", "abcdefgh"), ("abc", "abd")], "r string, h string")
    assert [round(x.c, 4) for x in df.select(S.cer(F.col("r"), F.col("h")).alias("c")).collect()] == [1.0, 0.0, 3.0, 0.3333]
    df = spark.createDataFrame([("a b c d", "a x c"), ("", ""), ("a", ""), ("", "b")], "r string, h string")
    assert [x.c for x in df.select(S.wer(F.col("r"), F.col("h")).alias("c")).collect()] == [0.5, 0.0, 1.0, 1.0]
    taus = spark.createDataFrame([([],), ([3],), ([2, 2],), ([0, 1, 2],), ([2, 1, 0],), ([0, 2, 1],)], "r array<int>")
    assert [x.t if x.t is None else round(x.t, 4) for x in taus.select(S.kendall_tau(F.col("r")).alias("t")).collect()] == [None, None, None, 1.0, -1.0, 0.3333]


def test_logprobs_and_scores(spark):
    df = spark.createDataFrame([([-0.1, -0.1],), ([],), ([-5.0],)], "l array<double>")
    got = [x.c for x in df.select(S.logprob_confidence(F.col("l")).alias("c")).collect()]
    assert round(got[0], 4) == 0.9048 and got[1] is None and got[2] == 0.0
    rows = [("paragraph", "fine", None, None, None), ("paragraph", " ", None, 0.9, None), ("handwritten_note", "x", None, 1.0, None), ("paragraph", "x [؟] [؟]", None, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "k string, t string, h string, c double, a double")
    r = [x.s for x in df.select(S.score_block(F.col("k"), F.col("t"), F.col("h"), F.col("c"), F.col("a"), F.array().cast("array<string>")).alias("s")).collect()]
    assert [x.confidence for x in r] == [0.5, 0.2, 0.85, 0.7]
    assert [x.needs_review for x in r] == [True, True, True, True]
    assert r[3].review_reasons[0] == "engines disagree (agreement 0.50)" and "empty transcription" in r[1].review_reasons


def test_settings(tmp_path):
    c = config.load()
    assert c.profile == "dev-cpu" and len(c.digest()) == 12 and c.digest() == config.load().digest()
    p = tmp_path / "c.json"
    p.write_text('{"profile": "dev-vlm", "qa": {"min_blur_var": 10}}')
    d = config.load(p, overrides={"qa": {"min_blur_var": 20}})
    assert d.recognition.primary == "vlm" and d.qa.min_blur_var == 20 and d.digest() != c.digest()
    with pytest.raises(ValueError):
        config.load(profile="nope")
    assert config.merged({"a": {"b": 1}, "c": 1}, {"a": {"d": 2}, "c": {"e": 3}}) == {"a": {"b": 1, "d": 2}, "c": {"e": 3}}
