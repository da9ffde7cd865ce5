"""Each query against its SQL twin. A quick choice runs by default; LODESTONE_ALL=1 runs every query."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

FOLDER = os.environ.get("LODESTONE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "row_documents revenue_by_region multi_hop_customers as_of_current bm25_topk hybrid_rrf retrieval_metrics chunk_fixed shingles near_dup_clusters "
    "canonical_url dedupe_lines luhn_cards rag_metrics metric_gate self_consistency fleet_metrics psi_drift infer_types date_normalize ts_normalize "
    "json_flatten json_presence thread_roots fair_topk token_budget"
).split()
NAMES = sorted(registry.queries()) if os.environ.get("LODESTONE_ALL") else QUICK


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(v) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    sql = registry.oracle_sql().get(name)
    got = df.collect()
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_limits_groups_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from lodestone.operators.retrieval import top_k

    df = top_k(spark.range(1000).select((F.col("id") % 7).alias("g"), "id"), ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_near_duplicates_need_no_cartesian_product(spark):
    df = registry.queries()["near_dup_pairs"](spark, FOLDER)
    assert "Cartesian" not in df._jdf.queryExecution().toString()


def test_minhash_signature_has_64_places(spark, duck):
    """Against the twin, on some documents."""
    from lodestone.plans import corpus

    few = "CREATE OR REPLACE TEMP VIEW few AS SELECT * FROM documents WHERE doc_id % 10 = 0"
    duck.sql(few)
    want = dict(duck.sql(corpus.MINHASH.replace("FROM documents", "FROM few")).fetchall())
    got = {r["doc_id"]: r["signature"] for r in registry.queries()["minhash_signature"](spark, FOLDER).filter("doc_id % 10 = 0").collect()}
    assert got == want and {len(s.split(",")) for s in got.values()} == {64}


def _all_nearest(duck, score, order, k, where="true"):
    return rows(
        ["qid", "score", "vec_id"],
        duck.sql(f"""SELECT qid, s, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s {order}, vec_id) AS r FROM
(SELECT q.vec_id AS qid, e.vec_id, round({score}(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS s FROM embeddings e, embeddings q
WHERE q.vec_id % 100 = 0 AND {where})) WHERE r <= {k}""").fetchall(),
    )


@pytest.mark.parametrize(
    "name, arguments",
    [
        ("knn_cosine", ("list_cosine_similarity", "DESC", 10)),
        ("knn_euclidean", ("list_distance", "ASC", 10)),
        ("filtered_topk", ("list_cosine_similarity", "DESC", 5, "e.label = 1 AND e.vec_id <> q.vec_id")),
    ],
)
def test_every_hundredth_vector_is_a_query(spark, duck, name, arguments):
    df = registry.queries()[name](spark, FOLDER)
    assert rows(df.columns, df.collect()) == _all_nearest(duck, *arguments)
    assert df.select("qid").distinct().count() == duck.sql("SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0").fetchall()[0][0] > 1


def test_caches_see_every_user_turn(spark, duck):
    from lodestone.functions.hashing import hash_embed
    from lodestone.plans import common, evaluation

    got = registry.queries()["exact_cache_key"](spark, FOLDER)
    turns = "FROM conversations WHERE role = 'user'"
    want = duck.sql(f"SELECT conv_id, turn, row_number() OVER (PARTITION BY {evaluation.KEY} ORDER BY conv_id, turn) > 1 AS hit {turns}")
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()) and got.filter("turn > 0").count() > 0
    got = registry.queries()["lru_cache"](spark, FOLDER)
    want = duck.sql(f"SELECT {evaluation.KEY} AS key, conv_id, turn {turns} QUALIFY row_number() OVER (PARTITION BY {evaluation.KEY} ORDER BY conv_id DESC, turn DESC) = 1 ORDER BY conv_id DESC, turn DESC LIMIT 256")
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    # hits of the semantic cache: a paraphrase finds its turn at least, and no nearer earlier request is passed over
    v = {}
    turns = common.user_turns(spark, FOLDER).selectExpr("id", "text", "array_join(reverse(split(text, ' ')), ' ') AS back")
    for again, column in enumerate(("text", "back")):
        v |= {(*r["id"], again): r["v"] for r in hash_embed(turns, "id", column).collect()}
    best = {}
    for a in v:
        found = [(-round(sum(x * y for x, y in zip(v[a], v[b], strict=True)), 6), b) for b in v if b < a]
        if found and -min(found)[0] >= 0.92:
            best[a] = (min(found)[1], -min(found)[0])
    found = registry.queries()["semantic_cache"](spark, FOLDER).collect()
    assert {(r["conv_id"], r["turn"], r["again"]): ((r["hit_conv_id"], r["hit_turn"], r["hit_again"]), r["similarity"]) for r in found} == best
    assert len(best) >= turns.count() > 0


def test_line_signature_of_every_line(spark, duck):
    from lodestone.plans.evaluation import B

    got = registry.queries()["line_signature"](spark, FOLDER)
    want = duck.sql(f"""SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '#', 'g'), '{B}+', ' ', 'g')) AS sig FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)""")
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()) and got.filter("pos > 0").count() > 0
