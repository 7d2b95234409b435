import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiouhlmnrst") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    bench = [(i, prose(25)) for i in range(3)]
    docs, labels = [], []
    for i in range(300):
        good = i % 5 > 0
        text = prose(rng.randint(30, 80)) if good else " ".join(word() + "###" for _ in range(40))
        docs.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, int(good), 0))
    docs[11][1] = prose(70)
    near = docs[11][1].split()
    near[3] = "changed"
    docs += [[300, docs[11][1], "en", "s0", 0], [301, " ".join(near), "en", "s1", 0], [302, f"{prose(20)} {bench[1][1]} {prose(20)}", "en", "s1", 0], [303, prose(40) + ' password=b7db7aa4a5fcc78305 ' + prose(9), "en", "s2", 0]]
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    gone = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        kept = {r.doc_id for r in out.collect()}
        gone[name], ids, docs = ids - kept, kept, out
    assert gone["quality"] == {i for i in range(300) if i % 5 == 0}
    assert gone["near_copies"] == {300, 301} and gone["decontamination"] == {302} and gone["secrets"] == set()
    final = {r.doc_id: r for r in docs.collect()}
    assert all(1 <= r.copies <= 3 for r in final.values())
    assert all("b7db7aa4a5fcc78305" not in r.text for r in final.values())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns[-1] == "copies"


def test_stages_carry_any_columns_and_odd_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, "en", None, 0), (None, "Some plain words stand here for good.", "en", "s0", 0), (7000, "", None, "s1", 0), (7001, "long words stand here " * 40_000, "en", "s1", 0), (7001, "long words stand here " * 40_000, "en", "s1", 0)], docs.schema)
    extra = {"copies": 1, "row": 2, "key": 3, "gone": 4, "_q_id": 5, "score": 6, "i": 7, "positive": True, "component_id": 8, "flags": 9, "start": 10}
    docs = docs.unionByName(odd).withColumns({k: F.lit(v) for k, v in extra.items()})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == (columns if name != "mixing" else [*columns, "copies_1"]) and docs.count() > 0
        assert all(r.asDict().items() >= extra.items() for r in docs.collect())


def test_stages_of_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
