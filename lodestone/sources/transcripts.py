"""Speech transcripts: turns, cleaning, entity corrections, sentence restoration and chunks. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _stripped, code_switch, let, mark_inaudible, scripts, strip_fillers

TURN = r"^\[([0-9]{2}):([0-9]{2}):([0-9]{2})\]\s*(SPEAKER_[0-9]+):\s*(.*)$"
# Corrections, homophones and discourse markers.
GLOSSARY = {"metphormin": "metformin", "axenture": "accenture", "pharamcy": "pharmacy"}
HOMOPHONES = (("their", "there", "they're"), ("to", "too", "two"), ("your", "you're"))
MARKERS = "so and but because then right okay well lekin".split()


def seconds(stamp: Column) -> Column:
    """Seconds of HH:MM:SS."""
    part = lambda i: F.element_at(F.split(stamp, ":"), i).cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def parse_turns(files: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, turn, speaker, start_sec, text): marked lines start turns, others join the turn before; lines before any go."""
    lines = files.select(key, F.posexplode(F.split(raw, "\n")).alias("lineno", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    w = Window.partitionBy(key).orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").rlike(TURN)
    tagged = lines.withColumn("turn", F.sum(starts.cast("int")).over(w)).filter("turn > 0")
    body = F.when(starts, F.trim(F.regexp_extract("line", TURN, 5))).otherwise(F.col("line"))
    first = lambda c: F.min_by(c, "lineno")
    stamp = F.regexp_extract("line", r"^\[([0-9:]{8})\]", 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", body.alias("b")))), lambda x: x["b"]), " ")
    grouped = tagged.groupBy(key, "turn").agg(first(F.regexp_extract("line", TURN, 4)).alias("speaker"), first(stamp).alias("stamp"), joined.alias("text"))
    return grouped.select(key, "turn", "speaker", seconds(F.col("stamp")).alias("start_sec"), "text")


def normalize(text: Column) -> Column:
    """struct<text, corrections, homophones>: known misspellings corrected and listed; homophones only listed."""
    fix = F.create_map(*(F.lit(x) for pair in GLOSSARY.items() for x in pair))
    same = F.create_map(*(x for group in HOMOPHONES for w in group for x in (F.lit(w), F.array(*map(F.lit, sorted(group))))))
    bare = lambda t: _stripped(F.lower(t), ".,?!;:")
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")

    def build(ts: Column) -> Column:
        words = F.transform(ts, lambda t: F.coalesce(F.when(t != "<INAUDIBLE>", F.try_element_at(fix, bare(t))), t))
        fixed = F.filter(F.transform(ts, bare), lambda b: F.map_contains_key(fix, b))
        heard = F.filter(F.transform(ts, bare), lambda b: F.map_contains_key(same, b))
        return F.struct(
            F.array_join(words, " ").alias("text"),
            F.transform(fixed, lambda b: F.struct(b.alias("from"), F.try_element_at(fix, b).alias("to"))).alias("corrections"),
            F.transform(heard, lambda b: F.struct(b.alias("token"), F.try_element_at(same, b).alias("alternatives"))).alias("homophones"),
        )

    return let(tokens, build)


def _fold(items: Column, joins, cut_before, cut_after) -> Column:
    """Groups of consecutive items, cut by conditions on (group so far, item)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(joins), x))
        fresh = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now"))
        state = F.when(cut_before(s["now"], x), fresh).otherwise(F.struct(s["done"].alias("done"), now.alias("now")))
        return F.when(cut_after(state["now"]), F.struct(F.concat(state["done"], F.array(state["now"])).alias("done"), F.lit("").alias("now"))).otherwise(state)

    return F.aggregate(items, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def _count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def restore_sentences(text: Column) -> Column:
    """A new sentence at each discourse marker after four words or more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return _fold(words, " ", lambda now, w: F.lower(w).isin(MARKERS) & (_count(now) >= 4), lambda now: F.lit(False))


def build_chunks(turns: DataFrame, target: int = 30) -> DataFrame:
    """Chunks of whole sentences of 30 words or more within each turn, with scripts, switches and audit lists."""
    marked, _ = mark_inaudible(F.col("text"))
    cleaned = turns.withColumn("n", normalize(strip_fillers(marked)))
    packed = _fold(restore_sentences(F.col("n.text")), " ", lambda now, s: F.lit(False), lambda now: _count(now) >= target)
    keys = [c for c in turns.columns if c not in ("text", "speaker", "start_sec")]
    rows = cleaned.select(*keys, "speaker", "start_sec", F.col("n.corrections").alias("corrections"), F.col("n.homophones").alias("homophone_flags"), F.posexplode(packed).alias("chunk_index", "text"))
    return rows.withColumns(
        {
            "chunk_id": F.concat("speaker", F.lit("@"), F.col("start_sec").cast("string"), F.lit("s#"), F.length("text").cast("string")),
            "scripts": scripts(F.col("text")),
            "code_switch": code_switch(F.col("text")),
            "inaudible_spans": F.regexp_count("text", F.lit("<INAUDIBLE>")),
        }
    )
