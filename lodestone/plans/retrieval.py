"""Retrieval over documents (queries: all benchmark passages) and over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_embed
from ..functions.text import STOP_CACHE, STOP_QUERY, tokenize_alnum, tokenize_stopwords, tokenize_words
from ..functions.vectors import cosine, l2_normalize
from ..operators import retrieval as R
from ..operators.durable import written
from .common import read, user_turns

K = 10
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
WORDS_ = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_QUERY) + "]"


def _queries(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


def bm25_sql(words: str, qtf: str = "count(*)") -> str:
    """CTEs up to scores(qid, doc_id, score)."""
    return f"""t AS (SELECT doc_id, unnest({words}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT doc_id, len({words}) AS dl FROM documents),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
q AS (SELECT qid, term, {qtf} AS qtf FROM (SELECT item_id AS qid, unnest({words}) AS term FROM benchmark) GROUP BY qid, term),
scores AS (SELECT qid, p.doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM q JOIN f USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, c GROUP BY qid, p.doc_id)"""


def ranked_sql(table: str, k: int = K) -> str:
    return f"""SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER
(PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {table}) WHERE rank <= {k}"""


EMBED = f"""list_transform(range(64), lambda i: CAST(len(list_filter(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in STOP_CACHE)}], w)), lambda w: CAST('0x' || substr(md5(w), 31, 2) AS INTEGER) & 63), lambda p: p = i)) AS DOUBLE))"""
DENSE = f"""dv AS MATERIALIZED (SELECT doc_id, {EMBED} AS v FROM documents), qv AS MATERIALIZED (SELECT item_id AS qid, {EMBED} AS v FROM benchmark),
dense AS (SELECT qid, doc_id, round(CASE WHEN list_sum(dv.v) = 0 OR list_sum(qv.v) = 0 THEN 0 ELSE list_cosine_similarity(dv.v, qv.v) END, 6) AS score FROM dv, qv)"""


def term_stats(spark, sf):
    """Document frequency and occurrences of every term."""
    return R.index(_docs(spark, sf)).terms


def bm25_topk(spark, sf):
    return R.bm25_top_k(_queries(spark, sf), R.index(_docs(spark, sf)), K)


def bm25_rank_all(spark, sf):
    """Every document's score for every passage, stop words left out."""
    return R.bm25_rank_all(_queries(spark, sf), R.index(_docs(spark, sf), tokens=tokenize_stopwords))


def _dense(spark, sf):
    return hash_embed(_queries(spark, sf), "qid"), hash_embed(_docs(spark, sf), "doc_id")


def _dense_top(spark, sf, k=K):
    queries, docs = _dense(spark, sf)
    return R.top_k(R.dense_scores(queries, docs, k), ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def dense_topk(spark, sf):
    return _dense_top(spark, sf)


def hybrid_rrf(spark, sf):
    """Dense and BM25 lists of ten fused by reciprocal rank from 0, first ten."""
    fused = R.rrf([_dense_top(spark, sf), bm25_topk(spark, sf)])
    return R.top_k(fused, ["qid"], [F.desc("score"), F.asc("doc_id")], K)


FUSED = f"""l AS ({ranked_sql("dense")} UNION ALL {ranked_sql("scores")})"""


def rrf_fusion(spark, sf):
    """The full rankings of both sides, ranks from 1: every document by its vector, and those that hold a query word."""
    docs = _docs(spark, sf)
    return R.rrf_all(_queries(spark, sf), docs, R.index(docs))


def hybrid_weighted(spark, sf):
    """0.5 of scaled dense and of scaled BM25 scores, first ten."""
    docs = _docs(spark, sf)
    return R.weighted_top_k(_queries(spark, sf), docs, R.index(docs), 0.5, K)


def _scaled(name: str, table: str) -> str:
    return f"""{name} AS (SELECT qid, doc_id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS x FROM (SELECT *,
min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM {table}))"""


WEIGHTED = f"""WITH {bm25_sql(WORDS)}, {DENSE}, {_scaled("a", "dense")}, {_scaled("b", "scores")}, m AS (SELECT coalesce(a.qid, b.qid) AS qid,
coalesce(a.doc_id, b.doc_id) AS doc_id, round(0.5 * coalesce(a.x, 0) + 0.5 * coalesce(b.x, 0), 6) AS score FROM a FULL JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id)
{ranked_sql("m")}"""


def union_dedupe(spark, sf):
    return R.union_dedupe([_dense_top(spark, sf), bm25_topk(spark, sf)])


UNION = f"""WITH {bm25_sql(WORDS)}, {DENSE}, l AS (SELECT *, 0 AS list FROM ({ranked_sql("dense")}) UNION ALL SELECT *, 1 FROM ({ranked_sql("scores")})),
m AS (SELECT qid, doc_id, min(list * 1000 + rank) AS place FROM l GROUP BY ALL)
SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS pos FROM m"""


def multi_query(spark, sf):
    """Each passage and its first and second half as variants, three documents each, in order without repeats."""
    words = tokenize_alnum(F.col("text"))
    half = F.floor(F.size(words) / 2).cast("int")
    parts = [F.array_join(F.slice(words, 1, F.greatest(half, F.lit(1))), " "), F.array_join(F.slice(words, half + 1, F.size(words) - half), " ")]
    queries = _queries(spark, sf)
    variants = [q.select(F.struct("qid", F.lit(i).alias("list")).alias("qid"), "text") for i, q in enumerate((queries, *(queries.select("qid", p.alias("text")) for p in parts)))]
    best = R.bm25_top_k(variants[0].union(variants[1]).union(variants[2]), R.index(_docs(spark, sf)), 3)
    best = written(best.select("qid.qid", "qid.list", "doc_id", "rank"), "variants")
    return R.union_dedupe([best.filter(F.col("list") == i) for i in range(3)])


MULTI = f"""WITH w AS (SELECT item_id AS qid, {WORDS} AS w FROM benchmark), v AS (SELECT qid, 0 AS list, w FROM w UNION ALL SELECT qid, 1, w[1 : greatest(len(w) // 2, 1)] FROM w
UNION ALL SELECT qid, 2, w[len(w) // 2 + 1 :] FROM w), t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, len({WORDS}) AS dl FROM documents), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
q AS (SELECT qid, list, term, count(*) AS qtf FROM (SELECT qid, list, unnest(w) AS term FROM v) GROUP BY ALL), s AS (SELECT qid, list, p.doc_id,
round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN d ON d.doc_id = p.doc_id, c
GROUP BY qid, list, p.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid, list ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3),
m AS (SELECT qid, doc_id, min(list * 1000 + rank) AS place FROM r GROUP BY ALL) SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS pos FROM m"""


def mmr_rerank(spark, sf):
    """Five of the twenty nearest by hashed vectors, chosen for relevance and difference."""
    queries, docs = _dense(spark, sf)
    shortlist = _dense_top(spark, sf, 20).withColumnRenamed("score", "relevance").join(docs, "doc_id")
    return R.mmr(shortlist, 5)


def rerank_shortlist(spark, sf):
    """The BM25 ten in the order of their dense score, first five."""
    shortlist = written(bm25_topk(spark, sf).select("qid", "doc_id"), "shortlist")
    docs = hash_embed(_docs(spark, sf).join(shortlist.select("doc_id").distinct(), "doc_id"), "doc_id").withColumnRenamed("v", "dv")
    pairs = shortlist.join(docs, "doc_id").join(hash_embed(_queries(spark, sf), "qid").withColumnRenamed("v", "qv"), "qid")
    return R.rerank(pairs, F.round(cosine(F.col("qv"), F.col("dv")), 6), 5).select("qid", "doc_id", "rank", "score")


RERANK = f"""WITH {bm25_sql(WORDS)}, {DENSE}, s AS ({ranked_sql("scores")}), r AS (SELECT s.qid, s.doc_id, dense.score FROM s
JOIN dense ON s.qid = dense.qid AND s.doc_id = dense.doc_id) {ranked_sql("r", 5)}"""


def synonym_expand(spark, sf):
    """Passages with synonyms of two words after them."""
    table = {"the": ["a", "that"], "of": ["from"]}
    return _queries(spark, sf).select("qid", R.synonym_expand(F.col("text"), table, tokenize_words).alias("expanded"))


SYNONYMS = f"""SELECT item_id AS qid, text || ' ' || array_to_string(list_transform(list_filter({WORDS_}, lambda w: w IN ('the', 'of')),
lambda w: CASE w WHEN 'the' THEN 'a that' ELSE 'from' END), ' ') AS expanded FROM benchmark"""


def _vector_queries(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def knn_cosine(spark, sf):
    vectors, queries = _vector_queries(spark, sf)
    return R.nearest(vectors, queries, "vec_id", K)


def knn_euclidean(spark, sf):
    vectors, queries = _vector_queries(spark, sf)
    return R.nearest(vectors, queries, "vec_id", K, "euclidean")


def _knn_sql(score: str, order: str) -> str:
    return f"""SELECT qid, vec_id, score FROM (SELECT q.vec_id AS qid, e.vec_id, round({score}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score {order}, vec_id) <= {K}"""


def l2_normalize_vectors(spark, sf):
    """The length of every vector after normalizing, and all its components to six places as text."""
    from ..functions.vectors import norm

    unit = l2_normalize(F.col("embedding"))
    whole = F.array_join(F.transform(unit, lambda x: F.format_string("%d", F.round(x * 1_000_000).cast("bigint"))), ",")
    return read(spark, sf, "embeddings").select("vec_id", F.round(norm(unit), 6).alias("length"), whole.alias("millionths"))


def hash_embed_documents(spark, sf):
    """The hashed vector of every document, rounded, as text."""
    v = F.transform("v", lambda x: F.round(x, 4).cast("string"))
    return hash_embed(_docs(spark, sf), "doc_id").select("doc_id", F.array_join(v, ",").alias("v"))


HASHED = f"""WITH e AS (SELECT doc_id, {EMBED} AS v FROM documents), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS z FROM e)
SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(round(CASE WHEN z > 0 THEN x / z ELSE 0 END, 4) AS DOUBLE)), ',') AS v FROM n"""


def semantic_cache(spark, sf):
    """For each user turn, and its words in reverse order asked right after it, the nearest request before by hashed vectors, from 0.92 on."""
    from ..operators.monitoring import semantic_cache_hits

    turns = user_turns(spark, sf)
    again = F.array_join(F.reverse(F.split("text", " ")), " ")
    asked = F.array(F.struct(F.lit(0).alias("again"), F.col("text").alias("text")), F.struct(F.lit(1).alias("again"), again.alias("text")))
    requests = turns.select("id", F.inline(asked)).select(F.struct("id.conv_id", "id.turn", "again").alias("id"), "text")
    hits = semantic_cache_hits(requests, 0.92)
    to = F.col("hit_id")
    return hits.select("id.conv_id", "id.turn", "id.again", to["conv_id"].alias("hit_conv_id"), to["turn"].alias("hit_turn"), to["again"].alias("hit_again"), "similarity")


SEMANTIC = f"""WITH r AS (SELECT conv_id, turn, 0 AS again, text FROM conversations WHERE role = 'user' UNION ALL
SELECT conv_id, turn, 1, array_to_string(list_reverse(string_split(text, ' ')), ' ') FROM conversations WHERE role = 'user'), v AS MATERIALIZED (SELECT conv_id, turn, again, {EMBED} AS v FROM r),
s AS (SELECT a.conv_id, a.turn, a.again, b.conv_id AS hit_conv_id, b.turn AS hit_turn, b.again AS hit_again, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
FROM v a, v b WHERE (b.conv_id, b.turn, b.again) < (a.conv_id, a.turn, a.again) AND list_sum(a.v) > 0 AND list_sum(b.v) > 0)
SELECT * FROM s WHERE similarity >= 0.92 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, again ORDER BY similarity DESC, hit_conv_id, hit_turn, hit_again) = 1"""


def retrieval_metrics(spark, sf):
    """Hit rate, reciprocal rank, precision and recall of the BM25 ten; relevant are documents that hold the passage."""
    from ..operators.evaluation import ranking_metrics

    queries, docs = _queries(spark, sf), _docs(spark, sf)
    return ranking_metrics(bm25_topk(spark, sf), R.containing(docs, queries), K)


METRICS = f"""WITH {bm25_sql(WORDS)}, r AS ({ranked_sql("scores")}), g AS (SELECT item_id AS qid, doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)),
gn AS (SELECT qid, count(*) AS rel FROM g GROUP BY qid), h AS (SELECT r.qid, count(*) AS hits, min(rank) AS first FROM r JOIN g USING (qid, doc_id) GROUP BY r.qid),
rn AS (SELECT qid, count(*) AS got FROM r GROUP BY qid)
SELECT round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr,
round(avg(coalesce(hits, 0)::DOUBLE / greatest(coalesce(got, 0), 1)), 4) AS precision, round(avg(coalesce(hits, 0)::DOUBLE / rel), 4) AS recall
FROM gn LEFT JOIN rn USING (qid) LEFT JOIN h USING (qid)"""


def route_rules(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", R.route_rules(F.col("text")).alias("route"))


def route_engine(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", R.route_engine(F.col("text")).alias("engine"))


QUERIES = {
    "term_stats": (
        term_stats,
        f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT doc_id, term, count(*) AS tf FROM
(SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term""",
    ),
    "bm25_topk": (bm25_topk, f"WITH {bm25_sql(WORDS)} {ranked_sql('scores')}"),
    "bm25_rank_all": (
        bm25_rank_all,
        f"""WITH {bm25_sql(f"list_filter({WORDS_}, lambda w: NOT list_contains({STOP}, w))", "1")} SELECT b.item_id AS qid, d.doc_id, coalesce(s.score, 0) AS score
FROM benchmark b CROSS JOIN d LEFT JOIN scores s ON s.qid = b.item_id AND s.doc_id = d.doc_id""",
    ),
    "dense_topk": (dense_topk, f"WITH {DENSE} {ranked_sql('dense')}"),
    "hybrid_rrf": (
        hybrid_rrf,
        f"WITH {bm25_sql(WORDS)}, {DENSE}, {FUSED}, m AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 9) AS score FROM l GROUP BY ALL) {ranked_sql('m')}",
    ),
    "rrf_fusion": (
        rrf_fusion,
        f"WITH {bm25_sql(WORDS)}, {DENSE}, l AS ({ranked_sql('dense', 2**40)} UNION ALL {ranked_sql('scores', 2**40)}) SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM l GROUP BY ALL",
    ),
    "hybrid_weighted": (hybrid_weighted, WEIGHTED),
    "union_dedupe": (union_dedupe, UNION),
    "multi_query": (multi_query, MULTI),
    "mmr_rerank": (mmr_rerank, None),
    "rerank_shortlist": (rerank_shortlist, RERANK),
    "synonym_expand": (synonym_expand, SYNONYMS),
    "knn_cosine": (knn_cosine, _knn_sql("list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "DESC")),
    "knn_euclidean": (knn_euclidean, _knn_sql("list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "ASC")),
    "l2_normalize": (
        l2_normalize_vectors,
        """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS z FROM embeddings)
SELECT vec_id, CASE WHEN z > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length, array_to_string(list_transform(v, lambda x: CAST(round(CASE WHEN z > 0 THEN x / z ELSE 0 END * 1000000) AS BIGINT)), ',') AS millionths FROM e""",
    ),
    "hash_embed": (hash_embed_documents, HASHED),
    "semantic_cache": (semantic_cache, SEMANTIC),
    "retrieval_metrics": (retrieval_metrics, METRICS),
    "route_rules": (
        route_rules,
        """SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: regexp_full_match(w, '[0-9]{4}'))) > 0 THEN 'hybrid'
WHEN starts_with(lower(text), 'why') OR starts_with(lower(text), 'how') OR starts_with(lower(text), 'explain') THEN 'hyde'
WHEN contains(lower(text), 'which') OR contains(lower(text), 'all') OR contains(lower(text), 'list') OR contains(lower(text), 'every') THEN 'multi_query'
ELSE 'dense' END AS route FROM conversations""",
    ),
    "route_engine": (
        route_engine,
        f"SELECT conv_id, turn, CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in R.AGGREGATE)} THEN 'structured' ELSE 'unstructured' END AS engine FROM conversations",
    ),
}
