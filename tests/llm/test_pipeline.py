import corpus_pipeline
import pytest
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(results):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name in names[:-1]:
        assert results[name].columns == COLUMNS
        assert results[name].where("n_chars <> char_length(text)").count() == 0


def test_quality_keeps_good_documents(spark, results):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = labels.join(results["quality"], "doc_id", "left_semi").groupBy("quality").count().collect()
    kept = {r.quality: r["count"] for r in kept}
    total = {r.quality: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert kept[1] >= 0.98 * total[1] and kept.get(0, 0) <= 0.05 * total[0]


def test_no_line_stays_in_three_documents(results):
    lines = results["line_dedup"].select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    many = lines.where("char_length(trim(line)) >= 20").groupBy("line").agg(F.countDistinct("doc_id").alias("n"))
    assert many.where("n >= 3").count() == 0


def test_one_document_of_each_group_of_near_copies(results):
    from test_ngram_join import brute

    before = [(r.doc_id, r.text) for r in results["line_dedup"].orderBy("doc_id").limit(250).collect()]
    groups = brute(before, 5, 80)
    kept = {r.doc_id for r in results["near_copies"].select("doc_id").collect()}
    for doc, (_, component) in groups.items():
        if component != doc:
            assert doc not in kept


def test_no_passage_of_a_test_item_stays(spark, results):
    from stratalens.llm.decontaminate import find_contamination

    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    before, after = results["near_copies"], results["decontamination"]
    found = find_contamination(before, bench)
    clean = found.where("n_hit = 0").select("doc_id")
    assert clean.join(after, "doc_id", "left_anti").count() == 0
    assert found.where("n_hit > 0").count() > 0


def test_packing_covers_the_last_documents(results):
    packed, docs = results["packing"], results["decontamination"]
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts and repeated rows pass every stage; an empty table gives an empty one."""
    sf_dir = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [(None, "A text without an id.", "en", "s", 21), (5000, None, None, None, None), (5001, "", "en", "s", 0)] + [(5002, "Twice the same row.", "en", "s", 19)] * 2,
        some.schema,
    )
    docs = some.union(odd)
    for name, stage in corpus_pipeline.STAGES[1:]:
        rows = stage(spark, docs, sf_dir)
        assert rows.count() > 0
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        if name == "near_copies":
            assert rows.where("doc_id = 5002").count() == 1 and rows.where("doc_id IS NULL").count() == 1
    quality = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert quality.columns == COLUMNS and quality.count() > 0


def test_run_agrees_with_the_stages(spark, results):
    columns = ["doc_id", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01").select(*columns)
    want = results["packing"].select(*columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_near_copies_under_repeated_and_missing_ids(spark):
    """Rows are judged by their own text, whatever other rows share their id."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(words)), (5, near), (5, "Another text altogether, under the same number."), (None, near), (None, "x " + " ".join(words)),
            (None, "Yet another text without a number."), (9, None), (9, None), (8, ""), (5, near)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert kept.columns == COLUMNS
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[5], (9, None), (8, "")], key=str)


def test_packing_tokenises_in_small_batches(spark, monkeypatch):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    monkeypatch.setattr(corpus_pipeline, "pack", lambda docs, *_, **__: spark.conf.get(limit))
    assert corpus_pipeline.packing_stage(spark, spark.range(1), "") == "4m"
    assert spark.conf.get(limit) == before
