"""Every opN_ query over a whole table: the columns of its contract, one row for each that it owes, and what else it fixes."""

import collections
import re
import zlib

import pytest

from lodestone.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op2_html_extraction": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op3_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op4_sentencepiece": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op5_lm_scoring": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")],
    "op6_quality_rules": [("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean")],
    "op7_url_filter": [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")],
    "op8_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op9_neighbours": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op10_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{FOLDER}/{n}.parquet").toPandas() for n in ("documents", "pages", "embeddings", "labels")}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, name):
    df = queries.queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    assert all(types[c] == t for c, t in COLUMNS[name])
    rows = df.collect()
    docs, pages = tables["documents"], tables["pages"]
    if name == "op9_neighbours":
        ids = sorted(tables["embeddings"]["vec_id"])
        found = collections.defaultdict(list)
        for r in rows:
            found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(found) == [i for i in ids if i % 20 == 0]
        for q, v in found.items():
            v.sort()
            assert [r for r, _, _ in v] == list(range(1, 21)) and q not in {i for _, i, _ in v}
            assert v == sorted(v, key=lambda x: (-x[2], x[1]))
        return
    key, table = ("page_id", pages) if COLUMNS[name][0][0] == "page_id" else ("doc_id", docs)
    assert sorted(r[key] for r in rows) == sorted(table[key])
    if "held_out" in types:
        folds = 5 if name == "op5_lm_scoring" else 3
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == 1) for r in rows)
    if name == "op1_quality":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        known = dict(zip(tables["labels"]["doc_id"], tables["labels"]["quality"], strict=True))
        judged = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and known.get(r["doc_id"]) in (0, 1)]
        assert sum(judged) >= 0.75 * len(judged)
    if name == "op2_html_extraction":
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    if name == "op3_mixing":
        words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
        assert all(r["size"] == words[r["doc_id"]] and r["taken"] == r["size"] * len(r["shards"]) <= 3 * r["size"] for r in rows)
        assert abs(sum({r["source_size"]: r["target"] for r in rows}.values()) - sum(words.values())) < 1e-3
        taken = collections.Counter()
        for r in rows:
            taken[r["source_size"]] += r["taken"]
        assert all(abs(taken[n] / t - 1) < 0.1 for n, t in {r["source_size"]: r["target"] for r in rows}.items())
    if name == "op5_lm_scoring":
        assert len({r["train_tokens"] for r in rows}) == 1 and all(r["n_known"] <= r["n_tokens"] for r in rows)
        assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    if name == "op6_quality_rules":
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in rows)
    if name == "op7_url_filter":
        assert {r["verdict"] for r in rows} <= {"allow", "block"} and any(r["rule"] == "com/en/" for r in rows)
    if name == "op8_language_id":
        known = dict(zip(docs["doc_id"], docs["lang"], strict=True))
        judged = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"] and known[r["doc_id"]] and r["lang_pred"] != "und"]
        assert sum(judged) >= 0.95 * len(judged)
    if name == "op10_simhash":
        assert all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in rows)
