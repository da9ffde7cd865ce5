"""A question-answering service over tables: ingest, query, and injected models with offline defaults.

Models are callables: an embedder takes (rows, key) and returns (key, v); an answerer takes a list of messages and
returns text. The defaults hash words and echo the best passage, so everything runs without a network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_embed
from ..functions.vectors import cosine
from .corpus import chunk_fixed
from .retrieval import parse_filter, top_k, where_equal

ABSTAIN = "I don't know based on the provided documents."
MOST_RESULTS = 20

Embedder = Callable[[DataFrame, str], DataFrame]
Answerer = Callable[[list[dict]], str]


def echo(messages: list[dict]) -> str:
    """The first passage of the context: the offline answerer."""
    context = messages[0]["content"].split("\n\nContext:\n", 1)[-1]
    return context.split("\n\n")[0].split("\n", 1)[-1]


def build_messages(question: str, context: str) -> list[dict]:
    rules = f"Answer from the context alone and name your sources. Where the context has no answer, say exactly: {ABSTAIN}"
    return [{"role": "system", "content": f"{rules}\n\nContext:\n{context}"}, {"role": "user", "content": question}]


def mapped(rows: DataFrame, column: str, model: Callable[[list[str]], list], kind: str, name: str = "output", batch: int = 128) -> DataFrame:
    """rows with a column of a model's outputs, in Arrow batches; the model sees batch texts at most at once."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        values = texts.tolist()
        for a in range(0, len(values), batch):
            out += model(values[a : a + batch])
        return pd.Series(out, index=texts.index)

    return rows.withColumn(name, run(column))


@dataclass
class Service:
    """An index table under a path; each ingest adds to it, and a document that comes again replaces its chunks."""

    spark: SparkSession
    path: str
    embed: Embedder = hash_embed
    answer: Answerer = echo
    dim: int = 64
    max_context_words: int = 1_500

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def index(self) -> DataFrame:
        """The chunks of each document's last ingest."""
        rows = self.spark.read.parquet(self.path)
        last = rows.groupBy("doc_id").agg(F.max("ingest").alias("ingest"))
        return rows.join(last, ["doc_id", "ingest"])

    def ingest(self, docs: DataFrame, size: int = 200, overlap: int = 40) -> int:
        """Chunks, embeds and adds docs (doc_id, text, …); other columns stay as metadata for filters. Returns the chunks added."""
        number = self.spark.read.parquet(self.path).agg(F.max("ingest")).first()[0] + 1 if self._exists() else 0
        metadata = docs.drop("text")
        chunks = chunk_fixed(docs.select("doc_id", "text"), size, overlap).withColumn("key", F.concat_ws("#", "doc_id", "chunk_index"))
        rows = chunks.join(self.embed(chunks.select("key", "text"), "key"), "key").join(metadata, "doc_id")
        guard = F.when(F.size("v") != self.dim, F.raise_error(F.format_string("expected %s dimensions, got %s", F.lit(self.dim), F.size("v")))).otherwise(F.col("v"))
        before = self.spark.read.parquet(self.path).count() if number else 0
        rows.drop("key").withColumns({"v": guard, "ingest": F.lit(number)}).write.mode("append").parquet(self.path)
        return self.spark.read.parquet(self.path).count() - before

    def retrieve(self, question: str, k: int = 4, filters: dict[str, object] | str | None = None) -> DataFrame:
        """The k nearest chunks among those that pass the equality filters."""
        if not 1 <= k <= MOST_RESULTS:
            raise ValueError(f"k must be between 1 and {MOST_RESULTS}")
        if isinstance(filters, str):
            filters = dict([parse_filter(filters)])
        asked = self.spark.createDataFrame([("q", question)], "key string, text string")
        query = self.embed(asked, "key").select(F.col("v").alias("_q"))
        scored = where_equal(self.index(), filters or {}).crossJoin(F.broadcast(query.limit(1)))
        scored = scored.withColumns({"qid": F.lit(0), "score": F.round(cosine(F.col("v"), F.col("_q")), 6)}).drop("_q", "v")
        return top_k(scored, ["qid"], [F.desc("score"), F.asc("doc_id"), F.asc("chunk_index")], k).drop("qid", "ingest")

    def hybrid(self, question: str, k: int = 4) -> DataFrame:
        """The k best chunks by reciprocal ranks of the k nearest and of the k best by BM25."""
        from .retrieval import bm25_top_k, index, rrf

        rows = self.index().withColumn("key", F.struct("doc_id", "chunk_index"))
        asked = self.spark.createDataFrame([(0, question)], "qid int, text string")
        dense = self.retrieve(question, k).select(F.lit(0).alias("qid"), F.struct("doc_id", "chunk_index").alias("doc_id"), "rank")
        sparse = bm25_top_k(asked, index(rows.select("key", "text"), "key"), k)
        best = top_k(rrf([dense, sparse]), ["qid"], [F.desc("score"), F.asc("doc_id")], k).select(F.col("doc_id").alias("key"), "score", "rank")
        return rows.join(best, "key").drop("key", "v", "ingest")

    def query(self, question: str, k: int = 4, filters: dict[str, object] | str | None = None) -> dict:
        """answer, grounded, and sources with 200-character snippets. Without evidence the answerer is not called."""
        hits = self.retrieve(question, k, filters).filter("score > 0").orderBy("rank").collect()
        if not hits:
            return {"answer": ABSTAIN, "grounded": False, "sources": []}
        parts, used = [], 0
        for h in hits:
            words = len(h["text"].split())
            if used + words > self.max_context_words:
                break
            parts.append(f"[source: {h['doc_id']}#{h['chunk_index']}]\n{h['text']}")
            used += words
        text = self.answer(build_messages(question, "\n\n".join(parts)))
        sources = [{"doc_id": h["doc_id"], "chunk_index": h["chunk_index"], "score": h["score"], "snippet": h["text"][:200]} for h in hits]
        return {"answer": text, "grounded": ABSTAIN.lower() not in text.lower(), "sources": sources}


def valid_answer(raw: Column) -> Column:
    """struct<valid, answer, cited_order_ids, grounded> of model output that should be JSON with an answer and a grounded flag."""
    got = F.from_json(raw, "answer string, cited_order_ids array<string>, grounded boolean", {"mode": "PERMISSIVE"})
    ok = got["answer"].isNotNull() & got["grounded"].isNotNull()
    ids = F.coalesce(got["cited_order_ids"], F.array().cast("array<string>"))
    return F.struct(ok.alias("valid"), got["answer"].alias("answer"), ids.alias("cited_order_ids"), got["grounded"].alias("grounded"))


def repair_prompt(raw: str, error: str, schema: str) -> str:
    return f"The output did not match the schema.\nOUTPUT:\n{raw}\n\nERROR:\n{error}\n\nSCHEMA:\n{schema}\n\nReturn corrected JSON only."


def hyde(service: Service, question: str, write: Callable[[str], str], k: int = 4) -> DataFrame:
    """Chunks nearest to an invented answer."""
    return service.retrieve(write(question), k)


def routed(service: Service, question: str, variants: Callable[[str], list[str]], write: Callable[[str], str], k: int = 4) -> tuple[str, DataFrame]:
    """The strategy that the rules choose, and its chunks."""
    from .retrieval import route_rules

    name = service.spark.createDataFrame([(question,)], "q string").select(route_rules(F.col("q")).alias("r")).first()["r"]
    if name == "hyde":
        return name, hyde(service, question, write, k)
    if name == "multi_query":
        found = None
        for v in [question, *variants(question)]:
            rows = service.retrieve(v, k)
            found = rows if found is None else found.unionByName(rows)
        return name, found.dropDuplicates(["doc_id", "chunk_index"])
    return name, service.hybrid(question, k) if name == "hybrid" else service.retrieve(question, k)


def chosen_route(reply: str, labels: tuple[str, ...] = ("dense", "hybrid", "multi_query", "hyde")) -> str:
    """The label that a model's reply is, or else begins or names first; the first label without one."""
    low = reply.strip().lower()
    found = [(low.find(x), i) for i, x in enumerate(labels) if x in low]
    return labels[min(found)[1]] if found else labels[0]


def typed_answer(raw: str, model: Callable[[str], str]) -> dict:
    """A model's JSON answer with answer and grounded checked; what fails goes back to the model once, then raises."""
    import json

    for attempt in range(2):
        try:
            got = json.loads(raw)
            if not isinstance(got, dict) or not isinstance(got.get("answer"), str) or not isinstance(got.get("grounded"), bool):
                raise ValueError("answer must be a text and grounded true or false")
            ids = got.get("cited_order_ids", [])
            if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
                raise ValueError("cited_order_ids must be a list of texts")
            return {"answer": got["answer"], "cited_order_ids": ids, "grounded": got["grounded"]}
        except ValueError as error:
            if attempt:
                raise
            raw = model(repair_prompt(raw, str(error), "answer: text, cited_order_ids: list of texts, grounded: boolean"))
    raise AssertionError
