"""Evaluation of answers and rankings: overlap metrics, claims, citations, consistency, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import atomic_claims, content_words, metric_tokens

# Metric floors, and ceilings where lower is better.
FLOORS = {
    "faithfulness": 0.85, "answer_relevancy": 0.75, "context_precision": 0.55, "context_recall": 0.80,
    "context_entity_recall": 0.45, "answer_correctness": 0.60, "answer_similarity": 0.75,
}
CEILINGS = {"noise_sensitivity": 0.30}


def share(part: Column, whole: Column) -> Column:
    return F.size(part) / F.greatest(F.size(whole), F.lit(1))


def rag_metrics(samples: DataFrame, stop=None, marks: str = ".,()$") -> DataFrame:
    """Eight overlap metrics of each sample (question, answer, context, ground_truth)."""
    cut = (lambda c: metric_tokens(F.col(c), stop, marks)) if stop else (lambda c: metric_tokens(F.col(c), marks=marks))
    words = samples.withColumns({"_q": cut("question"), "_a": cut("answer"), "_c": cut("context"), "_g": cut("ground_truth")})
    q, a, c, g = (F.col(x) for x in ("_q", "_a", "_c", "_g"))
    both = F.array_intersect(a, g)
    noise = F.array_except(F.array_except(a, c), q)
    return words.withColumns(
        {
            "faithfulness": share(F.array_intersect(a, c), a),
            "answer_relevancy": share(F.array_intersect(a, q), a),
            "context_precision": share(F.array_intersect(c, g), c),
            "context_recall": share(F.array_intersect(g, c), g),
            "context_entity_recall": share(F.array_intersect(g, c), g),
            "answer_correctness": share(both, F.array_union(a, g)),
            "answer_similarity": share(both, F.array_union(a, g)),
            "noise_sensitivity": share(noise, a),
        }
    ).drop("_q", "_a", "_c", "_g")


METRICS = [*FLOORS, *CEILINGS]


def mean_metrics(scored: DataFrame, metrics=METRICS) -> DataFrame:
    """(metric, mean): means over samples to three places, and the hallucination rate where faithfulness is there."""
    row = scored.agg(*(F.round(F.avg(m), 3).alias(m) for m in metrics))
    if "faithfulness" in metrics:
        row = row.withColumn("hallucination_rate", F.round(1 - F.col("faithfulness"), 3))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in row.columns))
    return row.select(F.inline(pairs))


def gate(means: DataFrame, floors=FLOORS, ceilings=CEILINGS) -> DataFrame:
    """(metric, mean, threshold, status): PASS or FAIL against a floor or ceiling, SKIP where the mean is missing."""
    spark = means.sparkSession
    rules = spark.createDataFrame([(m, float(t), False) for m, t in floors.items()] + [(m, float(t), True) for m, t in ceilings.items()], "metric string, threshold double, ceiling boolean")
    ok = F.when(F.col("ceiling"), F.col("mean") <= F.col("threshold")).otherwise(F.col("mean") >= F.col("threshold"))
    status = F.when(F.col("mean").isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL")
    return rules.join(means, "metric", "left").select("metric", "mean", "threshold", status.alias("status"))


def pass_counts(scored: DataFrame, floors=FLOORS, ceilings=CEILINGS) -> DataFrame:
    """(metric, passed, n, rate) over samples, each metric against its floor or ceiling; all of them together as overall."""
    checks = [(m, F.col(m) >= t) for m, t in floors.items() if m in scored.columns] + [(m, F.col(m) <= t) for m, t in ceilings.items() if m in scored.columns]
    row = scored.agg(F.count("*").alias("n"), *(F.count_if(ok).alias(m) for m, ok in checks))
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("passed"), "n") for m, _ in checks]
    whole = F.struct(F.lit("overall").alias("metric"), sum((F.col(m) for m, _ in checks), F.lit(0)).cast("bigint").alias("passed"), (F.col("n") * len(checks)).alias("n"))
    rows = row.select(F.inline(F.array(*parts, whole)))
    return rows.withColumn("rate", F.round(F.col("passed") / F.greatest(F.col("n"), F.lit(1)), 3))


def failures(scored: DataFrame, floors=FLOORS, ceilings=CEILINGS) -> DataFrame:
    """Samples with the names of the metrics they miss; samples that miss none are left out."""
    low = [F.when(F.col(m) < t, F.lit(m)) for m, t in floors.items() if m in scored.columns]
    high = [F.when(F.col(m) > t, F.lit(m)) for m, t in ceilings.items() if m in scored.columns]
    return scored.withColumn("failed", F.array_compact(F.array(*low, *high))).filter(F.size("failed") > 0)


def overlap(claim: Column, context: Column) -> Column:
    words = content_words(claim)
    return F.size(F.array_intersect(words, content_words(context))) / F.greatest(F.size(words), F.lit(1))


def nli_label(claim: Column, context: Column) -> Column:
    """entailment from 0.6 of the claim's content words in the context, neutral from 0.2, else contradiction."""
    found = overlap(claim, context)
    return F.when(found >= 0.6, "entailment").when(found >= 0.2, "neutral").otherwise("contradiction")


def claims(answers: DataFrame) -> DataFrame:
    """(… , pos, claim) for each claim of each answer."""
    return answers.select("*", F.posexplode(atomic_claims(F.col("answer"))).alias("pos", "claim"))


def faithfulness(answers: DataFrame, *key: str) -> DataFrame:
    """(key, claims, faithfulness, hallucination_rate) of answers (key, answer, context)."""
    judged = claims(answers).withColumn("ok", nli_label(F.col("claim"), F.col("context")) == "entailment")
    counted = judged.groupBy(*key).agg(F.count("*").alias("claims"), F.count_if("ok").alias("ok"))
    full = answers.select(*key).join(counted, list(key), "left").fillna(0, ["claims", "ok"])
    value = F.col("ok") / F.greatest(F.col("claims"), F.lit(1))
    return full.select(*key, "claims", F.round(value, 3).alias("faithfulness"), F.round(1 - value, 3).alias("hallucination_rate"))


def claim_support(answers: DataFrame) -> DataFrame:
    """Each claim as supported by its context, else retrieval_induced if the corpus column supports it, else generation_induced."""
    near = nli_label(F.col("claim"), F.col("context")) == "entailment"
    far = nli_label(F.col("claim"), F.col("corpus")) == "entailment"
    kind = F.when(near, "supported").when(far, "retrieval_induced").otherwise("generation_induced")
    return claims(answers).withColumn("support", kind).drop("context", "corpus", "answer")


def citations(answer: Column, pattern: str = r"order\s*(1[0-9]{3})") -> Column:
    """Distinct cited ids in the order in which they occur."""
    return F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(pattern), F.lit(1)))


def check_citations(answers: DataFrame, corpus: DataFrame, key: str, pattern: str = r"order\s*(1[0-9]{3})") -> DataFrame:
    """(key, cited, valid): an answer is valid if it cites and every cited record (id, text) entails it."""
    bare = F.regexp_replace("answer", r"(?i)\[" + pattern.replace("(", "(?:") + r"\]", "")
    cited = answers.select(key, bare.alias("bare"), F.explode_outer(citations(F.col("answer"), pattern)).alias("id"))
    judged = cited.join(corpus.select("id", "text"), "id", "left")
    ok = F.coalesce(nli_label(F.col("bare"), F.col("text")) == "entailment", F.lit(False)) & F.col("text").isNotNull()
    return judged.groupBy(key).agg(F.count("id").alias("cited"), (F.bool_and(ok) & (F.count("id") > 0)).alias("valid"))


def signature(answer: Column) -> Column:
    """Four-digit ids from 1000 on and content words of more than four characters."""
    ids = F.regexp_extract_all(answer, F.lit(r"\b(1[0-9]{3})\b"), F.lit(1))
    return F.array_union(ids, F.filter(content_words(answer), lambda w: F.length(w) > 4))


def self_consistency(samples: DataFrame, key: str, threshold: float = 0.5, needed: float = 0.6) -> DataFrame:
    """(key, agreement, consistent) of repeated answers (key, sample, answer): the greatest share that one answer agrees with.

    Equal signatures meet once, weighted by their number, so a group's pairs are pairs of distinct signatures.
    """
    signed = samples.select(key, F.array_sort(signature(F.col("answer"))).alias("_s")).groupBy(key, "_s").agg(F.count("*").alias("_c"))
    a, b = signed.select(key, F.col("_s").alias("_sa")), signed.select(key, F.col("_s").alias("_sb"), "_c")
    union = F.size(F.array_union("_sa", "_sb"))
    near = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("_sa", "_sb")) / union) >= threshold
    total = signed.groupBy(key).agg(F.sum("_c").alias("_n"))
    best = a.join(b, key).filter(near).groupBy(key, "_sa").agg(F.sum("_c").alias("_k")).groupBy(key).agg(F.max("_k").alias("_k"))
    value = F.col("_k") / F.col("_n")
    return best.join(total, key).select(key, F.round(value, 3).alias("agreement"), (value >= needed).alias("consistent"))


def abstention_rate(answers: DataFrame) -> DataFrame:
    from .monitoring import abstains

    return answers.agg(F.round(F.avg(abstains(F.col("answer")).cast("double")), 3).alias("abstention_rate"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Means over all queries that have relevant documents: hit rate, reciprocal rank, precision over what was returned, recall.

    A query that returned nothing counts 0 in each.
    """
    top = ranked.filter(F.col("rank") <= k)
    got = top.groupBy("qid").agg(F.count("*").alias("got"))
    hits = top.join(relevant, ["qid", "doc_id"]).groupBy("qid").agg(F.count("*").alias("hits"), F.min("rank").alias("first"))
    rel = relevant.groupBy("qid").agg(F.count("*").alias("rel"))
    rows = rel.join(got, "qid", "left").join(hits, "qid", "left").fillna(0, ["hits", "got"])
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return rows.agg(
        mean((F.col("hits") > 0).cast("double"), "hit_rate"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"),
        mean(F.col("hits") / F.greatest(F.col("got"), F.lit(1)), "precision"),
        mean(F.col("hits") / F.col("rel"), "recall"),
    )


def parse_score(text: Column) -> Column:
    """The first 0, 1 or decimal of either in a judge's reply; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"([01](?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
