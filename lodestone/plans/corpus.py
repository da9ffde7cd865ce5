"""Corpus cleaning and text queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import corpus as C
from ..operators import retrieval as R
from .common import read
from .evaluation import NB, B, content_sql

W_ = r"[\p{L}\p{N}_]+"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_QUERY) + "]"


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


def tokenize_alnum(spark, sf):
    t = T.tokenize_alnum(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


def tokenize_stopwords(spark, sf):
    t = T.tokenize_stopwords(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


def content_words(spark, sf):
    t = F.array_sort(T.content_words(F.col("text")))
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(t, " ").alias("words"))


def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def chunk_fixed(spark, sf):
    return C.chunk_fixed(_docs(spark, sf))


def _windows_sql(size: int, step: int, words: str = "w") -> str:
    return f"greatest(0, CAST(ceil((len({words}) - {size})::DOUBLE / {step}) AS INTEGER))"


CHUNK = f"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '{NB}') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range({_windows_sql(200, 160)} + 1)) AS i FROM d WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') AS text FROM i"""


def chunk_length_aware(spark, sf):
    return C.chunk_length_aware(_docs(spark, sf)).select("doc_id", "chunk_id", "text")


AWARE = f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{NB}') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range({_windows_sql(60, 45)} + 1)) AS i FROM d WHERE len(w) > 80)
SELECT doc_id, doc_id || '#' || i AS chunk_id, array_to_string(w[i * 45 + 1 : i * 45 + 60], ' ') AS text FROM i UNION ALL SELECT doc_id, doc_id || '#0', text FROM d WHERE len(w) <= 80"""


def chunk_counts(spark, sf):
    """Chunks of every source, by length-aware windows, and documents."""
    counts = C.chunk_length_aware(_docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = read(spark, sf, "documents").select("doc_id", "source").join(counts, "doc_id", "left")
    return rows.groupBy("source").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count("*").alias("documents"))


def chunk_paragraph(spark, sf):
    """Lines packed up to 500 characters."""
    return C.chunk_paragraphs(_docs(spark, sf), by="\n")


def semantic_chunk(spark, sf):
    """Sentences of conversation turns cut where the hashed vector turns far from the one before."""
    turns = read(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    keyed = turns.withColumn("key", F.concat_ws("-", "doc_id", "pos"))
    return C.chunk_semantic(keyed.join(H.hash_embed(keyed, "key"), "key"))


def shingles(spark, sf):
    """Number and digest of the distinct five-word shingles of every document."""
    s = T.shingles(F.col("text"))
    return _docs(spark, sf).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


SHINGLES = f"""s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W_}') AS w FROM documents))"""


def minhash_signature(spark, sf):
    """64-place md5 signatures of every document."""
    return H.minhash_documents(_docs(spark, sf), "doc_id").select("doc_id", F.array_join("signature", ",").alias("signature"))


MINHASH = f"""WITH {SHINGLES}, x AS (SELECT doc_id, unnest(s) AS x FROM s), m AS (SELECT doc_id, p, min(substr(md5(p || ':' || x), 1, 16)) AS h FROM x, range(64) r(p) GROUP BY ALL)
SELECT doc_id, string_agg(h, ',' ORDER BY p) AS signature FROM m GROUP BY doc_id"""


def near_dup_pairs(spark, sf):
    """Pairs of different texts of similarity 0.8 or more, between the least documents of equal shingle sets."""
    return C.similar_pairs(_docs(spark, sf))[1]


def jaccard_members(spark, sf):
    """The representative of each document's shingle set."""
    return C.equal_sets(_docs(spark, sf))


REPS = f"{SHINGLES}, k AS (SELECT doc_id, md5(array_to_string(list_sort(s), '|')) AS k, s FROM s), g AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep, s FROM k)"
PAIRS = f"""{REPS}, u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM g WHERE doc_id = rep), shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL), pairs AS MATERIALIZED (SELECT a, b, c::DOUBLE / (na + nb - c) AS j FROM shared WHERE c::DOUBLE / (na + nb - c) >= 0.8)"""


def near_dup_clusters(spark, sf):
    return C.near_duplicate_clusters(_docs(spark, sf))


CLUSTERS = f"""WITH RECURSIVE {PAIRS}, e AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(rep, r) AS (SELECT DISTINCT rep, rep FROM g UNION SELECT reach.rep, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT rep, min(r) AS cluster_id FROM reach GROUP BY rep), l AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY a)
SELECT g.doc_id, cluster_id, coalesce(links, 0) AS links FROM g JOIN c USING (rep) LEFT JOIN l USING (rep)"""


def canonical_version(spark, sf):
    """Of each cluster the document that the version order puts last: superseding text, then the name's mark, then the date.

    Names and dates are made of the ids, as documents have none; the greater id decides between equal ones.
    """
    i = F.col("doc_id")
    name = F.concat(F.lit("report_"), F.element_at(F.array(*map(F.lit, MARKS)), (i % len(MARKS) + 1).cast("int")), F.lit(".txt"))
    date = F.format_string("2024-%02d-01", (i % 12 + 1).cast("int"))
    named = _docs(spark, sf).select("doc_id", C.version_order(name, F.col("text"), date).alias("version"))
    rows = C.near_duplicate_clusters(_docs(spark, sf)).join(named, "doc_id")
    return rows.groupBy("cluster_id").agg(F.max_by("doc_id", F.struct("version", "doc_id")).alias("canonical"), F.count("*").alias("members"))


#: Version marks of made-up file names.
MARKS = ("v2", "draft", "final", "v11", "FINAL2")


CANONICAL = CLUSTERS.replace("SELECT g.doc_id, cluster_id, coalesce(links, 0) AS links FROM g JOIN c USING (rep) LEFT JOIN l USING (rep)", """, f AS (SELECT g.doc_id, cluster_id, contains(lower(text), 'supersede')::INT AS s, [2, 0, 3, 11, 4][d.doc_id % 5 + 1] AS m, printf('2024-%02d-01', d.doc_id % 12 + 1) AS dt
FROM g JOIN c USING (rep) JOIN documents d ON d.doc_id = g.doc_id)
SELECT cluster_id, arg_max(doc_id, (s, m, dt, doc_id)) AS canonical, count(*) AS members FROM f GROUP BY cluster_id""").replace("GROUP BY a)\n, f", "GROUP BY a), f")


def canonical_url(spark, sf):
    return read(spark, sf, "pages").select("page_id", H.canonical_url(F.col("url")).alias("canonical"))


URL = r"""(CASE WHEN s = '' THEN 'https' ELSE lower(s) END) || '://' || lower(h) || (CASE WHEN p = '' THEN '/' ELSE p END) || (CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END)"""
URLS = r"""u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), x AS (SELECT page_id, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS s, regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1) AS h,
regexp_replace(regexp_extract(u, '^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*)?([^?]*)', 1), '/+$', '') AS p, list_sort(list_transform(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
lambda y: y <> '' AND NOT regexp_matches(regexp_extract(y, '^([^=]*)', 1), '(?i)^(utm_|gclid|fbclid|mc_|ref$|ref_|igshid)')), lambda y: CASE WHEN contains(y, '=') THEN y ELSE y || '=' END)) AS q FROM u),
c AS (SELECT page_id, """ + URL + " AS canonical FROM x)"


def url_dedupe(spark, sf):
    return C.first_urls(read(spark, sf, "pages"))


def dedupe_lines(spark, sf):
    return C.dedupe_lines(_docs(spark, sf))


LINES = f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
n AS (SELECT doc_id, pos, regexp_replace(raw, '^{B}+|{B}+$', '', 'g') AS line FROM l), k AS (SELECT *, trim(regexp_replace(lower(line), '{B}+', ' ', 'g')) AS k FROM n)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) = 1"""


def repeated_lines(spark, sf):
    """Lines that a thousandth of all documents share, two at least, documents as pages."""
    docs = _docs(spark, sf)
    lines = docs.select(F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text")).withColumn("band", F.lit("body"))
    return C.repeated_lines(lines.filter(T.squeeze(F.col("text")) != ""), docs.count(), 0.001)


REPEATED = f"""WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '#', 'g'), '{B}+', ' ', 'g')) AS sig, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents))
SELECT sig, count(DISTINCT doc_id) AS pages, CASE WHEN length(trim(replace(sig, '#', ''))) <= 12 THEN 'watermark' ELSE 'repeating' END AS kind FROM l WHERE sig <> '' GROUP BY sig HAVING count(DISTINCT doc_id) >= greatest(2, (SELECT ceil(count(*) / 1000.0) FROM documents))"""


def line_signature(spark, sf):
    """The form of every line of each document, by its place from 0."""
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.line_signature(F.col("line")).alias("sig"))


def pii_detect(spark, sf):
    """Valid personal data in every document, by kind."""
    found = C.pii_found(F.col("text"))
    rows = _docs(spark, sf).select("doc_id", F.inline(found))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def pii_redact(spark, sf):
    return _docs(spark, sf).select("doc_id", C.redact(F.col("text")).alias("text"))


def luhn_cards(spark, sf):
    """Card-shaped strings of every document and whether they pass Luhn's check."""
    cards = F.transform(F.regexp_extract_all("text", F.lit(C.PII[1][1]), F.lit(1)), lambda v: F.trim(v))
    return _docs(spark, sf).select("doc_id", F.explode(cards).alias("card")).withColumn("valid", H.luhn_valid(F.col("card")))


LUHN = r"""WITH c AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '\b(?:[0-9][ -]?){13,16}\b'))) AS card FROM documents), d AS (SELECT *, regexp_replace(card, '[^0-9]', '', 'g') AS g FROM c)
SELECT doc_id, card, length(g) >= 13 AND list_sum(list_transform(range(length(g)), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN (CASE WHEN g[i + 1]::INT * 2 > 9 THEN g[i + 1]::INT * 2 - 9 ELSE g[i + 1]::INT * 2 END) ELSE g[i + 1]::INT END)) % 10 = 0 AS valid FROM d"""


def verhoeff(spark, sf):
    """Order keys as 12-digit numbers that pass Verhoeff's check."""
    number = F.lpad(F.col("o_orderkey").cast("string"), 12, "7")
    return read(spark, sf, "orders").select("o_orderkey", H.verhoeff_valid(number).alias("valid"))


def pii_placeholder(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", H.pii_placeholder("ACCOUNT", F.col("c_name")).alias("placeholder"))


def script_detect(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(T.scripts(F.col("text")), ",").alias("scripts"), T.code_switch(F.col("text")).alias("code_switch"))


SCRIPTS = f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'Devanagari' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin' END,
CASE WHEN regexp_matches(regexp_replace(text, '[\\x00-\\x7Fऀ-ॿ]', '', 'g'), '\\p{{L}}') THEN 'Other' END], lambda x: x IS NOT NULL), ',') AS scripts,
(regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[A-Za-z]')) OR len(list_intersect(list_distinct(list_transform(regexp_extract_all(lower(text), '{NB}'), lambda w: regexp_replace(w, '^[.,?!]+|[.,?!]+$', '', 'g'))),
[{", ".join(f"'{w}'" for w in T.ROMAN_HINDI)}])) >= 2 AS code_switch FROM documents"""


def filler_strip(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.strip_fillers(F.col("text")).alias("text"))


def contradictions(spark, sf):
    """Claims about refund windows and prices that orders make by the number of their priority, as topic text."""
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "refund within ").otherwise("priced at INR "), F.substring("o_orderpriority", 1, 1), F.lit(" days"))
    docs = rows.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("_policy")).alias("filename"), text.alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return C.contradictions(docs).select("topic", "claim", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"), "authoritative")


CONTRADICTIONS = """WITH r AS (SELECT o_orderkey || '_policy' AS filename, CASE WHEN o_orderkey % 2 = 0 THEN 'refund_policy' ELSE 'pricing' END AS topic, CASE WHEN o_orderkey % 2 = 0 THEN 'refund_window_days' ELSE 'price_inr' END AS claim,
substr(o_orderpriority, 1, 1)::DOUBLE AS value, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT topic, claim, array_to_string(list_transform(list_sort(list_distinct(list(value))), lambda v: CAST(v AS VARCHAR)), ',') AS values, arg_max(filename, (date, filename)) AS authoritative FROM r GROUP BY topic, claim HAVING count(DISTINCT value) > 1"""


def thread_roots(spark, sf):
    """Each turn's parent, whether the parent is there, and its depth: a turn replies to the one before."""
    t = read(spark, sf, "conversations").select("conv_id", "turn")
    parent = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("parent"))
    joined = t.join(parent, ["conv_id", "turn"], "left")
    w = Window.partitionBy("conv_id").orderBy("turn")
    root = F.max(F.when(F.col("parent").isNull(), F.col("turn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("conv_id", "turn", F.col("parent").isNull().alias("is_root"), (F.col("turn") - root).alias("depth"))


THREADS = """WITH j AS (SELECT t.conv_id, t.turn, p.turn AS parent FROM conversations t LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1)
SELECT conv_id, turn, parent IS NULL AS is_root, turn - max(CASE WHEN parent IS NULL THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS depth FROM j"""


def naive_topk(spark, sf):
    """Ten best chunks for each passage by length-normalized occurrences."""
    return R.top_k(_chunk_scores(spark, sf, False), ["qid"], [F.desc("score"), F.asc("chunk_id")], 10)


def _chunk_scores(spark, sf, one_of_a_document):
    """Scores of chunks that hold a word of the passage."""
    return R.chunk_scores(read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), C.chunk_length_aware(_docs(spark, sf)), T.tokenize_words, 10, one_of_a_document)


def fair_topk(spark, sf):
    """Ten best chunks for each passage, one of each document."""
    return R.fair_top_k(_chunk_scores(spark, sf, True), "doc_id", "chunk_id", 10)


CHUNK_SCORES = f"""c AS ({AWARE.replace("WITH d AS", "WITH d AS", 1)}), p AS (SELECT doc_id, chunk_id, regexp_extract_all(lower(text), '{W_}') AS w FROM c), t AS (SELECT doc_id, chunk_id, len(w) AS n, unnest(w) AS term FROM p),
f AS (SELECT doc_id, chunk_id, n, term, count(*) AS tf FROM t GROUP BY ALL), q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '{W_}')) AS term FROM benchmark),
s AS (SELECT qid, doc_id, chunk_id, round(sum(tf)::DOUBLE / sqrt(n), 6) AS score FROM f JOIN q USING (term) GROUP BY qid, doc_id, chunk_id, n)"""


def token_budget(spark, sf):
    """Turns of each conversation, first ones first, within 200 estimated tokens."""
    rows = read(spark, sf, "conversations").withColumnsRenamed({"conv_id": "qid", "turn": "rank"})
    return R.token_budget(rows, T.token_estimate(F.col("text")), 200).select("qid", "rank", "used")


def assemble_context(spark, sf):
    """Turns within a budget of 100 words, with source tags, as one context."""
    rows = read(spark, sf, "conversations").withColumnsRenamed({"conv_id": "qid", "turn": "rank"})
    kept = R.token_budget(rows, F.size(T.tokenize_blank(F.col("text"))), 100)
    part = F.concat(F.format_string("[source: %s#%s]\n", F.col("qid").cast("string"), F.col("rank").cast("string")), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"])
    return kept.groupBy("qid").agg(F.array_join(ordered, "\n\n").alias("context"))


def compress_context(spark, sf):
    """Of each answer the 60 % of sentences, one at least, that share most words with the question, in their order."""
    from ..plans.evaluation import _turns

    asked = T.tokenize_ascii(F.col("question"), 3)
    rows = _turns(spark, sf).select("conv_id", "turn", asked.alias("q"), F.posexplode(T.sentences(F.col("answer"))).alias("pos", "s"))
    scored = rows.withColumn("score", F.size(F.array_intersect("q", T.tokenize_ascii(F.col("s"), 3))))
    w = Window.partitionBy("conv_id", "turn")
    keep = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * 0.6)).cast("int")
    kept = scored.withColumn("keep", keep).withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "pos"))).filter("r <= keep")
    return kept.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("text"))


def sentences_sql(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.;]){B}+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"


def _compress_sql() -> str:
    from .evaluation import TURNS, _ascii

    return f"""WITH {TURNS}, s AS (SELECT conv_id, turn, {_ascii("question", 3)} AS q, {sentences_sql("answer")} AS s FROM t), x AS (SELECT conv_id, turn, q, unnest(s) AS s, generate_subscripts(s, 1) AS pos, len(s) AS n FROM s),
k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(list_intersect(q, {_ascii("s", 3)})) DESC, pos) <= greatest(1, round_even(n * 0.6, 0)))
SELECT conv_id, turn, string_agg(s, ' ' ORDER BY pos) AS text FROM k GROUP BY conv_id, turn"""


PARAGRAPHS = """WITH RECURSIVE p AS MATERIALIZED (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS p FROM documents),
r(doc_id, i, p, chunk_index, n) AS (SELECT doc_id, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT FROM documents WHERE text IS NOT NULL
UNION ALL SELECT r.doc_id, p.i, p.p, CASE WHEN r.n + length(p.p) <= 500 THEN r.chunk_index ELSE r.chunk_index + 1 END, CASE WHEN r.n + length(p.p) <= 500 THEN r.n ELSE 0 END + length(p.p)
FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1), c AS (SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, coalesce(ltrim(string_agg(p, chr(10) ORDER BY i), chr(10)), '') AS text FROM r GROUP BY ALL)
SELECT doc_id, chunk_index, text FROM c QUALIFY text <> '' OR chunk_index < max(chunk_index) OVER (PARTITION BY doc_id)"""

#: Verhoeff's check of 12-digit texts s, by multiplying through the digits from the last one.
VERHOEFF = """pw(i, d, v) AS (SELECT 0, d, d FROM range(10) t(d) UNION ALL SELECT i + 1, d, CAST('1576283094'[v + 1] AS BIGINT) FROM pw WHERE i < 7),
r(s, i, c) AS (SELECT s, 0, 0::BIGINT FROM n UNION ALL SELECT s, r.i + 1, CASE WHEN c < 5 THEN CASE WHEN v < 5 THEN (c + v) % 5 ELSE 5 + (c + v) % 5 END WHEN v < 5 THEN 5 + (c - v + 5) % 5 ELSE (c - v + 5) % 5 END
FROM r JOIN pw ON pw.i = r.i % 8 AND pw.d = CAST(s[12 - r.i] AS BIGINT) WHERE r.i < 12), ok AS (SELECT s, c = 0 AS valid FROM r WHERE i = 12)"""
VERHOEFFS = f"""WITH RECURSIVE n AS (SELECT DISTINCT lpad(CAST(o_orderkey AS VARCHAR), 12, '7') AS s FROM orders), {VERHOEFF}
SELECT o_orderkey, valid FROM orders JOIN ok ON s = lpad(CAST(o_orderkey AS VARCHAR), 12, '7')"""
DETECT = f"""WITH RECURSIVE a AS (SELECT trim(unnest(regexp_extract_all(text, '(\\b[0-9]{{4}}\\s?[0-9]{{4}}\\s?[0-9]{{4}}\\b)'))) AS value FROM documents), n AS (SELECT DISTINCT regexp_replace(value, '[^0-9]', '', 'g') AS s FROM a), {VERHOEFF},
l AS ({LUHN.replace("WITH c AS", "WITH c AS", 1)}), f AS (SELECT 'AADHAAR' AS kind, value FROM a JOIN ok ON s = regexp_replace(value, '[^0-9]', '', 'g') WHERE valid UNION ALL SELECT 'CARD', card FROM l WHERE valid
UNION ALL SELECT 'PAN', unnest(regexp_extract_all(text, '\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b')) FROM documents UNION ALL SELECT 'ACCOUNT', unnest(regexp_extract_all(text, '(?i)\\baccount\\s+([0-9]{{9,18}})\\b', 1)) FROM documents)
SELECT kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM f GROUP BY kind"""

QUERIES = {
    "tokenize_alnum": (
        tokenize_alnum,
        r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)",
    ),
    "tokenize_stopwords": (
        tokenize_stopwords,
        f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{W_}'), lambda w: NOT list_contains({STOP}, w)) AS t FROM documents)",
    ),
    "content_words": (content_words, f"SELECT conv_id, turn, array_to_string(list_sort({content_sql('text')}), ' ') AS words FROM conversations"),
    "token_estimate": (token_estimate, "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents"),
    "chunk_fixed": (chunk_fixed, CHUNK),
    "chunk_length_aware": (chunk_length_aware, AWARE),
    "chunk_paragraph": (chunk_paragraph, PARAGRAPHS),
    "chunk_counts": (
        chunk_counts,
        f"WITH c AS ({AWARE}) SELECT source, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks, count(*) AS documents FROM documents LEFT JOIN (SELECT doc_id, count(*) AS chunks FROM c GROUP BY doc_id) USING (doc_id) GROUP BY source",
    ),
    "semantic_chunk": (semantic_chunk, None),
    "shingles": (shingles, f"WITH {SHINGLES} SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), '|')) AS digest FROM s"),
    "minhash_signature": (minhash_signature, MINHASH),
    "near_dup_pairs": (near_dup_pairs, f"WITH {PAIRS} SELECT a, b, round(j, 4) AS jaccard FROM pairs"),
    "jaccard_pairs": (jaccard_members, f"WITH {REPS} SELECT doc_id, rep FROM g"),
    "near_dup_clusters": (near_dup_clusters, CLUSTERS),
    "canonical_version": (canonical_version, CANONICAL),
    "canonical_url": (canonical_url, f"WITH {URLS} SELECT page_id, canonical FROM c"),
    "url_dedupe": (url_dedupe, f"WITH {URLS} SELECT page_id, canonical, min(page_id) OVER (PARTITION BY canonical) AS first_id FROM c"),
    "dedupe_lines": (dedupe_lines, LINES),
    "repeated_lines": (repeated_lines, REPEATED),
    "line_signature": (
        line_signature,
        f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '#', 'g'), '{B}+', ' ', 'g')) AS sig FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)""",
    ),
    "pii_detect": (pii_detect, DETECT),
    "pii_redact": (pii_redact, None),
    "luhn_cards": (luhn_cards, LUHN),
    "verhoeff": (verhoeff, VERHOEFFS),
    "pii_placeholder": (
        pii_placeholder,
        "SELECT c_custkey, '[ACCOUNT_' || substr(sha256('rag-ingest-salt-v1:' || regexp_replace(c_name, '[^0-9]', '', 'g')), 1, 6) || ']' AS placeholder FROM customer",
    ),
    "script_detect": (script_detect, SCRIPTS),
    "filler_strip": (filler_strip, None),
    "contradictions": (contradictions, CONTRADICTIONS),
    "thread_roots": (thread_roots, THREADS),
    "naive_topk": (
        naive_topk,
        f"WITH {CHUNK_SCORES} SELECT qid, doc_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10",
    ),
    "fair_topk": (
        fair_topk,
        f"WITH {CHUNK_SCORES}, o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, chunk_id) = 1) SELECT qid, doc_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 10",
    ),
    "token_budget": (
        token_budget,
        "SELECT conv_id AS qid, turn AS rank, CAST(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM conversations QUALIFY used <= 200",
    ),
    "assemble_context": (
        assemble_context,
        f"""SELECT qid, string_agg('[source: ' || qid || '#' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT conv_id AS qid, turn AS rank, text,
sum(len(regexp_extract_all(text, '{NB}'))) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 100 GROUP BY qid""",
    ),
    "compress_context": (compress_context, _compress_sql()),
}
