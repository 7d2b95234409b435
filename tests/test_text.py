import pytest
from pyspark.sql import functions as F

from quernel.functions import stats as S
from quernel.functions import text as T


def one(spark, expr, *rows, names="x"):
    cols = names.split()
    df = spark.createDataFrame([tuple(r) if isinstance(r, tuple) else (r,) for r in rows], " string, ".join(cols) + " string")
    return [r[0] for r in df.select(expr).collect()]


def test_lower_case(spark):
    assert one(spark, T.tr_lower("x"), "IĞDIR", "İzmir", "ÇÖŞ", None) == ["ığdır", "izmir", "çöş", None]


def test_tokens_stems_and_equivalents(spark):
    got = one(spark, T.tokenize("x"), "Üçüncü vardiya 06/2024", "Mayıs", "bir o x 7", "çalıştırılacak", None, "000")
    assert got[0] == ["üçüncü", "3", "vardiya", "vardiy~", "06", "6", "2024"]
    assert got[1] == ["mayıs", "5", "05"]
    assert got[2] == ["7"]
    assert got[3] == ["çalıştırılacak", "çalışt~"]
    assert got[4] == []
    assert got[5] == ["000", "0"]


def test_coverage(spark):
    rows = [("kasım raporu", "11/2024 raporu"), ("raporlama işlemi", "raporların tamamı"), ("", "x y"), ("hiçbiri", "başka")]
    got = one(spark, T.coverage(T.content_terms("q"), T.content_terms("b")), *rows, names="q b")
    assert got == pytest.approx([2 / 3, 0.5, 0.0, 0.0])


def test_numbers(spark):
    assert one(spark, T.normalize_number("x"), "1.490,00", "1.490,50", "170", "9.2", "1.234.567", "0,50", None) == ["1490", "1490,5", "170", "9.2", "1234567", "0,5", ""]
    assert one(spark, T.numbers_in(T.strip_citations("x")), "32 ay, 1.490,00 TL [K1] K2 01/05") == [["32", "1.490,00", "01", "05"]]


def test_sentences(spark):
    got = one(spark, T.split_sentences("x"), "Süre 9.2. madde gereği. [K1] Bu kadar. son\n- madde bir. Hâlâ aynı\n\n2) iki", None)
    assert got == [["Süre 9.2. madde gereği.", "[K1] Bu kadar. son", "- madde bir. Hâlâ aynı", "2) iki"], []]


def test_meta_and_factual(spark):
    xs = ["Bu bilgiler [K1] kaynağından elde edilmiştir.", "Evet.", "Bu iş için avans verilmeyecektir.", "32 aydır [K1].", ""]
    assert one(spark, T.is_meta("x"), *xs) == [True, True, False, False, True]
    assert one(spark, T.is_factual("x"), *xs) == [True, False, False, True, False]


def test_refusal_phrase(spark):
    text, n = T.strip_refusal("x", "Bu konu hakkında bilgi yoktur.")
    got = one(spark, F.concat_ws("|", text, n.cast("string")), "Süre 36 aydır [K1]. Bu konu hakkında [K2] bilgi yoktur.", "Süre 5 gün.", "Ancak bu konu hakkında bilgi yoktur.")
    assert got == ["Süre 36 aydır [K1].|1", "Süre 5 gün.|0", "|1"]


def test_cleaning_and_headings(spark):
    assert one(spark, T.clean_text("x"), "kon-\nsantre\r\n  - 12 -  \n\n\n\nson   söz", None) == ["konsantre\n\nson söz", ""]
    assert one(spark, T.detect_heading("x"), "MADDE 9\nmetin", "GENEL HÜKÜMLER\nx", "a\nb\nc\nBÖLÜM II", "3.1 Kapsam") == ["MADDE 9", "GENEL HÜKÜMLER", None, "3.1 Kapsam"]


def test_articles(spark):
    long = "x" * 60
    got = one(spark, T.split_articles("x"), f"MADDE 1- {long}\nMADDE 2- {long}", f"9.1. {long}. 9.2. {long}", "tek parça", f"BAŞLIK\nMADDE 1- {long}")
    assert [len(g) for g in got] == [2, 2, 1, 1]
    assert got[3] == [f"BAŞLIK\nMADDE 1- {long}"]


def test_table_rows(spark):
    xs = ["Ocak 2024 1.490,00 TL", "12 kişi 3 ay 5 gün", "Toplam tutar 145,00", "Sözleşmenin genel hükümleri", "abc", "2021-05 | 7"]
    assert one(spark, T.is_table_row("x"), *xs) == [True, True, True, False, False, True]


def test_expected_values(spark):
    rows = [("1.500 tl", "500"), ("16 gün", "6"), ("1.548.750,00", "1.548.750"), ("%6'sı", "%6"), ("servisin", "Servis"), ("x", ""), ("24:00", "24:00")]
    assert one(spark, T.value_in("t", "e"), *rows, names="t e") == [False, False, True, True, True, False, True]


def test_recognised_text(spark):
    score, issues = T.assess_quality("x")
    clean = "Sayfa düzgün okunmuş bir sözleşme metnidir, herhangi bir sorun içermez."
    bad = "9480fazlası birim 530867520 fiyat a b c cetveli ab12cd kişi 1234567 ücret tutar"
    got = one(spark, F.struct(score, issues), clean, bad, "kısa")
    assert got[0][0] == 1.0 and got[2][0] == 1.0 and got[1][0] < 0.5 and "long_digits" in got[1][1]
    assert one(spark, T.clean_ocr("x"), "iyi satır 12\n-- . |\n   ikinci    satır\n~~a~~~~~~~~") == ["iyi satır 12\nikinci satır"]


def test_highlight_and_prefix(spark):
    assert one(spark, T.highlight("x", F.lit("IŞIK"), 9), "aaaaaaaaaaaa ışık bbbbbbbbbbbbbbb") == ["…aa ışık bbbb…"]
    assert one(spark, T.lcp(F.col("a"), F.col("b")), ("kesme", "kesilmesi"), ("", "x"), ("ab", "ab"), names="a b") == [3, 0, 2]


def test_intervals(spark):
    df = spark.createDataFrame([(28, 29, 9, 16), (0, 0, 1, 2), (5, 5, 5, 5)], "a int, b int, c int, d int")
    lo, hi = S.wilson(F.col("a"), F.col("b"))
    assert [(round(r[0], 3), round(r[1], 3)) for r in df.select(lo, hi).collect()] == [(0.828, 0.994), (0.0, 0.0), (0.566, 1.0)]
    d = [r[0] for r in df.select(S.newcombe(*map(F.col, "abcd"))).collect()]
    assert d[0].significant and (d[0].diff, d[0].lo, d[0].hi) == (40.3, 15.5, 63.5) and not d[1].significant and not d[2].significant
    s = S.ratio_summary(F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(S.format_ratio(s)).collect()][:2] == ["28/29  %96,6  (GA %83-99)", "veri yok"]
