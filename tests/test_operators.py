import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quernel.functions import fixed
from quernel.operators import chunking, context, evaluate, index, ingest, search, tools, verify
from quernel.sources import files as src
from quernel.streaming import refresh


def finalized(spark, *rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw_answer string, chunks array<string>, question string")
    return verify.finalize(df, **kw).orderBy("i").collect()


SOURCE = ["Sözleşme süresi 36 aydır. Günlük yemek bedeli 145,00 TL olarak ödenir. Depo görevlisi sayısı 12 kişidir."]


def test_answers_that_stand(spark):
    rows = [
        ("Sözleşme süresi 36 aydır [K1].", SOURCE, "Sözleşme süresi kaç aydır?"),
        ("Yemek bedeli 145,00 TL olarak ödenir. Bu bilgi [K1] kaynağından alınmıştır.", SOURCE, "Yemek bedeli nedir?"),
        ("Süre 36 aydır [K1]. Bu konu hakkında yüklenen belgelerde bilgi bulunmamaktadır.", SOURCE, "Süre nedir?"),
        ("Süre 36 aydır [K1]. Toplam iş süresi ise yaklaşık 99 aya ulaşmaktadır.", SOURCE, "Süre nedir?"),
    ]
    got = finalized(spark, *rows)
    assert [r.reason for r in got] == [None] * 4
    assert got[1].final_answer == "Yemek bedeli 145,00 TL olarak ödenir [K1]."
    assert got[2].final_answer == "Süre 36 aydır [K1]." and got[2].cited == [1]
    assert got[3].final_answer == "Süre 36 aydır [K1]." and len(got[3].uncited) == 1


def test_answers_that_fall(spark):
    rows = [
        ("", SOURCE, "x"), (fixed.REFUSAL, SOURCE, "x"), ("Süre 36 aydır [K7].", SOURCE, "x"), ("Süre 36 aydır.", SOURCE, "x"),
        ("Süre 48 aydır [K1].", SOURCE, "Süre nedir?"), ("Depo görevlisi sayısı kaç kişidir [K1]?", SOURCE, "Depo görevlisi sayısı kaç kişidir?"),
        ("Bu bilgiler [K1] kaynağından elde edilmiştir.", SOURCE, "x"), ("Kısa bir söz. [K1] Toplam 36 ay sürer ve bundan sonra yenilenir.", SOURCE, "x"),
    ]
    assert [r.reason for r in finalized(spark, *rows)] == ["empty", "only_refusal", "invalid_citation", "no_citation", "unsupported_number", "question_echo", "only_meta", None]


def test_unsupported_words(spark):
    rows = [("Bağlı olduğu üst yındıktıyı ifade eder [K1].", ["bağlı olduğu üst yöneticiyi ifade eder"], "kim"), ("Ücret kesilmesi yapılmaz [K1].", ["ücretten kesme yapılmaz"], "kesinti")]
    got = finalized(spark, *rows, words_mode="warn")
    assert got[0].flagged == ["yındıktıyı"] and got[1].flagged == []
    assert finalized(spark, *rows, words_mode="block")[0].reason == "unsupported_word"


def test_fused_ranks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid long, doc_id long, rank int")
    got = {r.doc_id: r.fusion_score for r in search.rrf([a, b]).collect()}
    assert got == pytest.approx({10: 1 / 61, 11: 1 / 61 + 1 / 62, 12: 1 / 62})
    with pytest.raises(ValueError):
        search.rrf([a, b], [1.0])


def test_mmr_against_plain_loop(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    e = rng.normal(size=(12, 8))
    e[5] = e[0]
    score = np.sort(rng.random(12))[::-1]
    df = spark.createDataFrame([(1, i, i + 1, float(score[i]), [float(x) for x in e[i]]) for i in range(12)], "qid long, doc_id long, pos int, final_score double, embedding array<double>")
    u = e / np.linalg.norm(e, axis=1)[:, None]
    rel = (score - score.min()) / (score.max() - score.min())
    chosen = [0]
    while len(chosen) < 6:
        rest = [i for i in range(12) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (round(0.6 * rel[i] - 0.4 * max(u[i] @ u[j] for j in chosen), 12), -i)))
    assert [r.doc_id for r in search.mmr(df, 6).orderBy("mmr_rank").collect()] == chosen


def test_cap_fills_up(spark):
    df = spark.createDataFrame([(1, i, "a" if i < 5 else "b", i) for i in range(6)], "qid long, doc_id long, source string, pos int")
    got = search.cap_per_document(df, 2, 4).orderBy("cap_pos").collect()
    assert [r.doc_id for r in got] == [0, 1, 5, 2]


def test_retrieval_end_to_end(spark):
    docs = spark.createDataFrame([(1, "Depo görevlisi sayısı 12 kişidir", "a"), (2, "Yemek bedeli 145 liradır", "a"), (3, "başka konu", "b")], "doc_id long, text string, source string")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(7, "yemek bedeli", [0.1, 1.0]), (8, "depo görevlisi", None)], "qid long, question string, qvec array<double>")
    got = search.retrieve(index.build(docs), docs, vec, q).orderBy("qid", "final_rank").collect()
    assert [(r.qid, r.doc_id) for r in got] == [(7, 2), (7, 3), (8, 1)]


def test_budget_and_history(spark):
    df = spark.createDataFrame([(1, 1, 700), (1, 2, 300), (1, 3, 5)], "qid long, pos int, size int")
    assert [r.pos for r in context.within_budget(df, "size", F.lit(600), ["qid"], "pos").collect()] == [1]
    assert [r.pos for r in context.within_budget(df, "size", F.lit(1000), ["qid"], "pos").orderBy("pos").collect()] == [1, 2]
    for ctx in (1024, 4096, 8192):
        b = spark.range(1).select(context.fit_budget(F.lit(9000), F.lit(ctx), F.lit(700), F.lit(2.75), F.lit(1741), F.lit(50))).first()[0]
        assert 600 <= b <= 9000
    t = spark.createDataFrame([(1, i, f"q{i}", "a" * 400) for i in range(4)], "conv_id long, turn int, question string, answer string")
    h = context.last_turns(t).orderBy("turn").collect()
    assert [len(r.history) for r in h] == [0, 1, 2, 2] and len(h[3].history[0].answer) == 300


def test_boilerplate(spark):
    pages = spark.createDataFrame([("d", i, f"Sözleşme No 117 Sayfa {i}\nmetin {i}\norta satır\nSözleşme No 117 Sayfa 9 geçer\nson {i}\nbir\niki\nüç") for i in range(1, 5)], "doc string, page int, text string")
    bp = chunking.boilerplate(pages)
    assert {r.line for r in bp.collect()} == {"sözleşme no # sayfa #"}
    assert all(r.text.startswith("metin") for r in chunking.strip_boilerplate(pages, bp).collect())


def test_strip_boilerplate_counts_empty_last_lines(spark):
    """Only the last line end is no line of its own: the line here is the fourth from the end, so it stays."""
    pages = spark.createDataFrame([("d", 1, "a\nb\nc\nd\nfoot line\nx\n\n\n")], "doc string, page int, text string")
    found = spark.createDataFrame([("d", "foot line")], "doc string, line string")
    assert chunking.strip_boilerplate(pages, found).first().text == "a\nb\nc\nd\nfoot line\nx"


def test_page_rows(spark):
    text = "Bu sayfada aşağıdaki hakediş tablosu yer almaktadır ve okunmalıdır.\nDönem | Tutar\nOcak 2024 1.490,00\nŞubat 2024 1.500,00\nMart 2024 1.510,00"
    rows = chunking.page_rows(spark.createDataFrame([("d", 1, text), ("d", 2, "tek satır")], "doc string, page int, text string")).orderBy("ord").collect()
    assert len(rows) == 4 and rows[1].text == "[TABLO SATIRI] Dönem | Tutar\nOcak 2024 1.490,00"


def test_splitter_invariants(spark):
    text = "MADDE 1\n\n" + ("kelime " * 300) + "\n\n" + ("x" * 1500) + ". son; cümle, bitti"
    pieces = chunking._pieces(text, chunking.X.SEPARATORS, 700, 150)
    assert all(len(p) <= 700 for p in pieces)
    for word in ("MADDE 1", "bitti"):
        assert any(word in p for p in pieces)
    assert sum(p.count("x") for p in pieces) >= 1500


def test_chunks(spark):
    blocks = spark.createDataFrame([("f", 1, "GENEL HÜKÜMLER\n" + "uzun metin " * 20, False), ("f", 2, "a | 1", True), ("f", 3, "kısa", False)], "rel_path string, ord int, text string, is_row boolean")
    got = chunking.chunks(blocks).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == [1, 2] and {r.section for r in got} == {"GENEL HÜKÜMLER"} and len({r.chunk_id for r in got}) == 2


def test_upkeep(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "rel_path string, hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "3"), ("d", "4")], "rel_path string, hash string")
    diff = ingest.manifest_diff(new, old)
    assert {r.rel_path: r.status for r in diff.collect()} == {"a": "added", "b": "unchanged", "c": "updated", "d": "removed"}
    chunks = lambda *p: spark.createDataFrame([(x, f"{x}{n}", n) for x, n in p], "source_path string, chunk_id string, page int")
    out = ingest.refreshed(chunks(("b", 1), ("c", 1), ("d", 1)), chunks(("a", 2), ("c", 2)), diff)
    assert sorted(r.chunk_id for r in out.collect()) == ["a2", "b1", "c2"]
    man = old.withColumn("chunks", F.lit(1).cast("long")).withColumn("pages", F.lit(1))
    assert {r.rel_path: r.hash for r in ingest.next_manifest(man, diff, chunks(("a", 2))).collect()} == {"a": "1", "b": "2", "c": "3"}


def test_verdicts_and_summary(spark):
    schema = "type string, refused boolean, answer string, sources array<string>, expect_keywords array<string>, expect_any array<string>, expect_source string, forbid_keywords array<string>"
    rows = [("answerable", False, "Süre 36 aydır", ["a.pdf"], ["36"], None, "A.pdf", ["30"]), ("answerable", False, "30 ay", ["b.pdf"], ["36"], ["x"], "a.pdf", ["30"]), ("must_refuse", True, "", [], None, None, None, None), ("trap", True, "", [], None, None, None, None), ("answerable", True, "", [], None, None, None, None)]
    got = evaluate.verdicts(spark.createDataFrame(rows, schema))
    assert [r.passed for r in got.collect()] == [True, False, True, True, False]
    assert len(got.collect()[1].issues) == 4
    s = evaluate.summary(got.withColumn("elapsed_s", F.lit(2.0)).withColumn("n_sources", F.size("sources")).withColumn("n_flagged", F.lit(0))).first()
    assert (s.success.n_ok, s.success.n, s.refusal.n_ok, s.false_refusal.n_ok, s.p95) == (3, 5, 1, 1, 2.0)


def test_outage_runs(spark):
    rows = [("r", i, "Connection refused" if i in (2, 3, 4, 6) else "ok", "", []) for i in range(8)]
    got = evaluate.outages(spark.createDataFrame(rows, "run string, pos int, answer string, raw_answer string, issues array<string>")).collect()
    assert [(r.start, r.length) for r in got] == [(2, 3)]


def test_tools(spark):
    d = spark.createDataFrame([(1, "a\nsecret = 'abcdefgh12345'\nx@y.org"), (2, "temiz")], "path int, text string")
    assert [(r.line_no, r.kind) for r in tools.leak_scan(d, ["TEMİZ"]).orderBy("path", "line_no").collect()] == [(2, "secret"), (3, "email"), (1, "term:TEMİZ")]
    hits = tools.find_text(d.withColumnRenamed("path", "doc_id"), ["SECRET", "temiz"]).collect()
    assert {(r.term, r.doc_id, r.hits) for r in hits} == {("SECRET", 1, 1), ("temiz", 2, 1)}


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(p if p.startswith("<") else f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return b.getvalue()


def xlsx():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="inlineStr"><is><t>Ad</t></is></c><c r="B1"><v>2.5</v></c></row><row><c r="A3"><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>')
    return b.getvalue()


def test_file_sources(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("bir\n\n\n\niki", encoding="utf-8")
    (root / ".gizli.txt").write_text("x")
    (root / "sub" / "t.csv").write_text("ad;tutar\nx;1,5\n;\ny;2\n", encoding="utf-8")
    (root / "s.xlsx").write_bytes(xlsx())
    (root / "w.DOCX").write_bytes(docx("Başlık", "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"))
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "z.bin").write_bytes(b"x")
    found = src.scan(spark, str(root)).cache()
    assert {r.rel_path for r in found.collect()} == {"a.txt", "sub/t.csv", "s.xlsx", "w.DOCX", "bad.docx"}
    assert [r.text for r in chunking.text_blocks(src.texts(found)).orderBy("ord").collect()] == ["bir", "iki"]
    rows = {(r.rel_path, r.rn): r.cells for r in src.table_rows(found).collect()}
    assert rows == {("sub/t.csv", 1): ["ad", "tutar"], ("sub/t.csv", 2): ["x", "1,5"], ("sub/t.csv", 3): ["y", "2"], ("s.xlsx", 1): ["Ad", "2,5"], ("s.xlsx", 2): ["7", "7"]}
    assert [(r.kind, r.text) for r in src.document_blocks(found).orderBy("ord").collect()] == [("text", "Başlık"), ("table", "a | b")]
    assert [r.rel_path for r in src.failures(found, src.texts(found), src.table_rows(found), src.document_blocks(found)).collect()] == ["bad.docx"]


def test_stream_refresh(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "chunks")
    feed.mkdir()
    schema = "source_path string, file_hash string, text string"
    to_chunks = lambda d: d.select(F.col("rel_path").alias("source_path"), F.col("hash").alias("file_hash"), F.explode(F.split("text", " ")).alias("text"))

    def push(n, *rows):
        spark.createDataFrame(rows, "rel_path string, hash string, text string").coalesce(1).write.json(str(feed / f"b{n}"))
        stream = spark.readStream.schema("rel_path string, hash string, text string").json(str(feed / "*"))
        q = refresh.refresh_stream(stream, table, str(tmp_path / "cp"), to_chunks, schema)
        q.awaitTermination(120)
        return sorted((r.source_path, r.text) for r in refresh.latest(spark, table, schema).collect())

    assert push(1, ("a", "1", "x y"), ("b", "1", "z")) == [("a", "x"), ("a", "y"), ("b", "z")]
    assert push(2, ("a", "2", "w"), ("b", "1", "other")) == [("a", "w"), ("b", "z")]


def test_cases_from_yaml(spark, tmp_path):
    (tmp_path / "set.yaml").write_text("# files: a.pdf\n- question: Kaç gün?\n  expect_keywords: ['5']\n- question: Yok?\n  type: must_refuse\n", encoding="utf-8")
    files = src.scan(spark, str(tmp_path), ["yaml"])
    got = evaluate.read_cases(spark, files).orderBy("question").collect()
    assert [(r.question, r.type, r.expect_keywords) for r in got] == [("Kaç gün?", "answerable", ["5"]), ("Yok?", "must_refuse", None)]


def test_ingest_end_to_end(spark, tmp_path):
    root, folder = tmp_path / "files", str(tmp_path / "collection")
    (root / "sub").mkdir(parents=True)
    long = " ".join(f"kelime{i}" for i in range(60))
    (root / "a.txt").write_text(f"MADDE 1\n{long}", encoding="utf-8")
    (root / "sub" / "b.csv").write_text("ad;tutar\nbir;1,5\niki;2,5\n", encoding="utf-8")
    (root / "c.xyz").write_bytes(b"?")
    (root / "d.txt").write_text(" \n", encoding="utf-8")
    (root / "e.pdf").write_bytes(b"p1|p2|p3|p4")
    page = lambda i: f"KURUM BELGE BAŞLIĞI\n{long} sayfa metni {chr(97 + i) * 5}\nson"
    extract = lambda content: [page(i) for i, _ in enumerate(content.split(b"|"))]
    r = ingest.run(spark, str(root), folder, extract).first()
    assert (r.added, r.updated, r.removed) == (["a.txt", "c.xyz", "d.txt", "e.pdf", "sub/b.csv"], [], [])
    assert {f.rel_path: f.error for f in r.failed} == {"c.xyz": "unsupported", "d.txt": "no_content"}
    table = ingest.collection(spark, folder)
    first = {x.source_path: x for x in table.orderBy("chunk_index").collect()}
    assert r.chunks_written == table.count() and first.keys() == {"a.txt", "e.pdf", "sub/b.csv"} and table.where("source_path = 'sub/b.csv'").count() == 2
    assert first["e.pdf"].page == 4 and not table.where("text like '%BELGE BAŞLIĞI%'").count() and first["a.txt"].section == "MADDE 1"
    r = ingest.run(spark, str(root), folder, extract).first()
    assert r.unchanged == ["a.txt", "e.pdf", "sub/b.csv"] and r.chunks_written == 0 and r.added == ["c.xyz", "d.txt"]
    (root / "a.txt").write_text(f"yeni {long}", encoding="utf-8")
    (root / "sub" / "b.csv").unlink()
    (root / "e.pdf").write_bytes(b"x")
    r = ingest.run(spark, str(root), folder, lambda content: []).first()
    assert (r.updated, r.removed) == (["a.txt", "e.pdf"], ["sub/b.csv"]) and "e.pdf" in {f.rel_path for f in r.failed}
    now = ingest.collection(spark, folder)
    assert {x.source_path for x in now.collect()} == {"a.txt", "e.pdf"} and now.where("source_path = 'a.txt'").first().text.startswith("yeni")
    assert ingest.published(spark, folder) == [1, 2, 3] and ingest.last_report(spark, f"{folder}/v=3/report").first().removed == ["sub/b.csv"]
    assert len(ingest.run(spark, str(root), folder, extract, reset=True).first().added) == 4


def test_sinks(spark, tmp_path):
    assert ingest.read_manifest(spark, str(tmp_path / "none")).count() == 0
    ingest.write_manifest(spark.createDataFrame([("a", "h", 2, 1)], "rel_path string, hash string, chunks long, pages int"), str(tmp_path / "m"))
    assert ingest.read_manifest(spark, str(tmp_path / "m")).first().chunks == 2
    (tmp_path / "bad.json").write_text('{"rel_path": "a", "hash": "h"}\n{"rel_pa')
    assert ingest.read_manifest(spark, str(tmp_path / "bad.json")).count() == 0
    answers = spark.createDataFrame([("q", True, "empty", 0.51239, ["s"], "x", 1.0)], "question string, refused boolean, reason string, top_similarity double, sources array<string>, answer string, elapsed_s double")
    assert ingest.append_audit(answers, str(tmp_path / "audit")) and ingest.append_audit(answers, str(tmp_path / "audit"))
    lines = spark.read.json(str(tmp_path / "audit"))
    assert lines.count() == 2 and lines.first().top_similarity == 0.5124
    assert not ingest.append_audit(answers, str(tmp_path / "bad.json" / "below"))


def test_prompts_and_confidence(spark):
    rows = spark.createDataFrame([(1, 1, "a.txt", "Sayfa 1", "", "metin {question}"), (1, 2, "b.txt", None, "II", "x" * 9000)], "qid int, final_rank int, source string, locator string, section string, text string")
    asked = spark.createDataFrame([(1, " ne? "), (2, "kim?")], "qid int, question string")
    got = {r.qid: r.prompt for r in context.prompts(rows, asked, template="{count}|{context}|{question}|{refusal}", refusal="yok").collect()}
    assert got == {1: "2|[K1] Belge: a.txt | Konum: Sayfa 1\n---\nmetin {question}\n---|ne?|yok", 2: "0||kim?|yok"}
    pool = spark.createDataFrame([(1, 0.2), (1, 0.54), (2, 0.55)], "qid int, similarity double")
    answers = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "qid int, refused boolean")
    assert {r.qid: (r.top_similarity, r.low_confidence) for r in context.confidence(pool, answers).collect()} == {1: (0.54, True), 2: (0.55, False), 3: (0.0, False), 4: (0.0, True)}


def test_cells():
    e = datetime(1899, 12, 30)
    got = [src.format_cell(*x, e) for x in [("45291", None, True), ("45291.75", "n", True), ("1", "n", True), ("61", None, True), ("45291", None, False), ("1490.5", "n", False), ("1", "b", False), ("2024-02-29T00:00:00Z", "d", False), ("", None, True)]]
    assert got == ["31.12.2023", "31.12.2023", "01.01.1900", "01.03.1900", "45291", "1490,5", "True", "29.02.2024", ""]
    assert src.format_cell("0", None, True, datetime(1904, 1, 1)) == "01.01.1904"


def test_heading_forward_fill_equals_its_sql(spark, tmp_path):
    """Numbered headings are none for this query; white space, case and missing values as in DuckDB."""
    import duckdb

    from quernel import catalogue

    texts = ["GENEL HÜKÜMLER\nx", "3.1 Kapsam ve Tanımlar\nx", "MADDE 9\nx", "Madde 9 x\nBÖLÜM II", "\u00a0ABCD\u00a0", "ABC\u00a0", "\x0bABC", "ABCD \u0085", " \t\fABCD\r\nx", "ABC", "ABC ﬁ", "STRAßE", "ŉ ABC", "1234", "a\nb\nc\nLATE", "", None, "Ω" * 100, "Ω" * 101, "İSTANBUL", "ΑΣ ᾼΣ", None]
    rows = [(i if i % 7 else None if i == 7 else i, t, s) for s in ("a", None) for i, t in enumerate(texts)] + [(i, t, str(i)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.queries()["heading_forward_fill"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(db.execute(catalogue.oracle_sql()["heading_forward_fill"]).fetchall(), key=key)
