from corpus_pipeline import STAGES, run
from fluxweave.llm import bpe, mixing, neardup, quality
from fluxweave.llm.tables import _file_order
from tests.conftest import SMOKE
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_neardup import brute_classes
from tests.llm.test_substrings import brute


def test_stages_equal_brute_force(spark, tmp_path):
    """Every stage on what the one before it has left, against a plain version in Python."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    vectors = quality.word_vectors(docs)
    net = quality.learn(docs, spark.read.parquet(f"{SMOKE}/labels.parquet"), vectors)
    accepted = {r.doc_id for r in quality.scored(docs, vectors, net, ["doc_id"]).collect() if r.score >= quality.ACCEPT}
    texts = {i: t for i, t in texts.items() if i in accepted}
    classes = brute_classes(texts, neardup.idf_table(docs.filter(docs.doc_id.isin(list(texts)))))
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    texts = {i: (t if not removed else kept) for i, (t, (_, removed, kept)) in ((i, (texts[i], b)) for i, b in brute(texts).items())}
    got = {r.doc_id: r for r in run(spark, SMOKE).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i].text == t and got[i].n_chars == len(t) and got[i].ids == LIBRARY.encode_ordinary(t)


def test_columns_and_edges(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(0, None, "en", "a", 0), (1, "", None, None, 0), (None, "some text here", "en", "a", 14), (2, "word " * 30_000, "en", "b", 150_000)]
    rows += [(3, "twice the same row of text", "en", "a", 26)] * 2
    for name, made in (("full", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(made, columns).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for number, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, str(folder))
            if number < len(STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(str(folder / str(number)))
            docs = spark.read.parquet(str(folder / str(number)))
        assert docs.count() <= len(made)


def test_result_keeps_the_order_of_the_mix(spark, monkeypatch):
    """The mix is several files of different sizes, so that they are not read in order."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = run(spark, SMOKE)
        assert len(result.inputFiles()) > 1
        got = sorted(result.collect(), key=lambda r: r.mix_position)
        places = {r.doc_id: r.position for r in mixing.schedule(result.drop("ids")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.mix_position for r in got}) == len(got) == len(places) > 100
    assert [r.doc_id for r in got] == sorted(places, key=places.get)


def test_places(spark, tmp_path):
    """Files of which the later are the larger, in several scan tasks; rows that are in no file; names of many files."""
    rows = 0
    for part in range(6):
        n = 10 * 3**part
        spark.range(rows, rows + n, 1, 1).selectExpr("id AS doc_id", "string(id) AS text", "7 AS mix_position").write.mode("append").parquet(str(tmp_path / str(part)))
        (made,) = (tmp_path / str(part)).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"part-{99_997 + part}-x-c000.snappy.parquet").write_bytes(made.read_bytes())
        rows += n
    got = bpe.stage(spark, spark.read.parquet(str(tmp_path / "all")), "").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.mix_position)] == list(range(rows)) and len({r.mix_position for r in got}) == rows
    loose = spark.range(100).selectExpr("id AS doc_id", "'a' AS text")
    assert [r.doc_id for r in bpe.stage(spark, loose, "").orderBy("mix_position").collect()] == [r.doc_id for r in loose.collect()]
    assert sorted(["part-00010-a-c000.x", "part-00002-a-c001.x", "part-00002-a-c000.x"], key=_file_order) == ["part-00002-a-c000.x", "part-00002-a-c001.x", "part-00010-a-c000.x"]
