import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test")
        assert docs.columns == first.columns
        sizes.append(docs.count())
    assert first.count() > sizes[0] >= sizes[1] > sizes[2] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == sizes[3]


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "empty")
        assert docs.count() == 0


def test_stages_of_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and clashing names, beside enough plain documents to learn from."""
    import random

    random.seed(20)
    words = ["".join(random.choice("aeiourstln") for _ in range(random.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = [(i, prose(200), "en", f"s{i % 3}", 5) for i in range(30)]
    rows += [(None, prose(90), None, None, None), (31, None, "en", "s0", 0), (32, "", "en", "s0", 0), (33, " \n ", None, "s1", 0), (34, prose(60_000), "en", "s1", 1)]
    rows += [(35, rows[0][1], "en", "s2", 2), rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", "1 AS key", "2 AS s", "3 AS fp", "4 AS row", "5 AS id", "6 AS _rank", "7 AS score")
    names, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "odd")
        assert docs.columns == names and {tuple(r[-7:]) for r in docs.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
        sizes.append(docs.count())
    assert sizes[0] == 38 and sizes[1] == 35 and sizes[2] == 35 and sizes[3] == 32  # three without words; a copy and two repeats
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == sizes[4]
