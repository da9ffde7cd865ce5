"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams.

The regression is trained here from a small labelled table of invented URLs. Their hosts and paths are put together at
random from the word lists below, plain ones also from random syllables; a URL is unwanted if its host or its path
holds an unwanted word. The regression reads host and path only, so schemes, queries and fragments never matter.

Results for odd input: a null url, or one without ://, has an empty host and path, fits no rule and is allowed, as
there is nothing to judge; repeated rows are judged alike.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, LABELLED = 1 << 16, 15_000

# Words of unwanted and of plain URLs; among the plain ones some that hold an unwanted word's letters.
UNWANTED = (
    "casino bet bets betting gambling gamble slots slot poker jackpot roulette blackjack bingo lottery wager bookmaker pills viagra cialis "
    "pharmacy tramadol xanax adult porn porno xxx sex sexy nude cams camgirl escort hentai milf spam linkfarm backlinks clickbank adserver "
    "popads tracker phish phishing verifyaccount freeprize giveaway crack cracked keygen warez serialkey torrent torrents malware trojan "
    "replica fakewatches payday loans quickcash getrich doubler airdrop followers likesbuy darkmarket"
).split()
PLAIN = (
    "cooking garden history library museum science physics weather news travel school college music poetry bridge river mountain forest "
    "kitchen bakery letters theatre painting chess football running cycling sailing health doctor teacher law council city village market "
    "harbour railway engine compiler notes essays journal archive lecture books photo house family green blue north south east west home "
    "open world little old new public local daily weekly central park street better alphabet betty elizabeth essex sussex middlesex sextant "
    "pillow adventure address shadow analysis analog cocktail peacock assets classic passage document trackwork soundtrack slotted spamalot "
    "scunthorpe torrential crackers serial likes following lottie beta tibet pokerwork loaned airport drops cash rich watch account free "
    "cheap online best shop club app blog group service team support download login search account gallery guide review help forum"
).split()
PATHS = "about news article story post posts category tag archive index page section en de fr es blog contact help images docs wiki topics item view research report".split()
GLUE = "free cheap online best top my the vip real live hot super go get play win your 24 365 888 777 1 2 x 4u".split()
ENDINGS = "com org net info io co.uk de fr es edu app site online club example.com example.org example.net".split()
FRONTS = ("", "", "", "www.", "blog.", "m.", "news.", "shop.")


def labelled_urls(seed: int = 1, n: int = LABELLED) -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted) of n invented URLs."""
    r = random.Random(seed)

    def syllables() -> str:
        pairs = "th he an in er on re st en nd at or es ti ed is ar te se al ra ri ne to io le tion ing ble wh sh ly ou ea ha nt ch sch ung que eau os ar ció".split()
        return "".join(r.choice(pairs) for _ in range(r.randint(2, 4)))

    def name(unwanted: bool) -> str:
        words = [r.choice(PLAIN) if r.random() < 0.6 else syllables() for _ in range(r.choice((1, 1, 1, 2, 2, 3)) - unwanted)]
        words += [r.choice(GLUE)] * (r.random() < 0.35) + [r.choice(UNWANTED)] * unwanted
        words += [r.choice(UNWANTED)] * (unwanted and r.random() < 0.3)
        r.shuffle(words)
        return r.choice(("", "", "-")).join(words) or syllables()

    def path(unwanted: bool) -> str:
        parts = [r.choice((r.choice(PATHS), r.choice(PLAIN), syllables(), str(r.randrange(10_000)))) for _ in range(r.randint(0, 3))]
        if unwanted:
            parts.insert(r.randint(0, len(parts)), name(True))
        end = r.choice(("", "", "/", ".html")) if parts else r.choice(("", "/"))
        return "".join("/" + x for x in parts) + end

    out = []
    for _ in range(n):
        kind = r.choice((0, 0, 0, 0, 1, 1, 2))  # a plain URL, an unwanted host, a plain host with an unwanted path
        out.append((r.choice(FRONTS) + name(kind == 1) + "." + r.choice(ENDINGS), path(kind == 2 or kind == 1 and r.random() < 0.3), int(kind > 0)))
    return out


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character 3- to 6-grams of the host and of the path, each with end marks.

    Words of host and path share their n-grams: what is unwanted in one is so in the other.
    """
    grams = set()
    for text in (f".{host}.", f"{path}/"):
        text = text.lower().replace("-", ".").replace("/", ".").replace("_", ".")
        grams.update(text[i : i + n] for n in (3, 4, 5, 6) for i in range(len(text) - n + 1))
    return np.fromiter({zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams}, np.int64)


def train(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch descent with a rate for each weight."""
    found = [features(h, p) for h, p, _ in rows]
    labels = np.array([y for _, _, y in rows], float)
    row, column = np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found)
    weights, bias, speed = np.zeros(BUCKETS), -1.0, np.full(BUCKETS, 1e-6)
    for _ in range(120):
        error = 1 / (1 + np.exp(-np.bincount(row, weights[column], len(rows)) - bias)) - labels
        gradient = np.bincount(column, error[row], BUCKETS) + 0.1 * weights
        speed += gradient**2
        weights -= 0.15 * gradient / np.sqrt(speed)
        bias -= 0.5 * error.mean()
    return weights, bias


@lru_cache(1)
def model() -> tuple[np.ndarray, float]:
    return train(labelled_urls())


def probability(host: str, path: str, fitted: tuple[np.ndarray, float] | None = None) -> float:
    """That the URL should be blocked; 0 for an empty host and path."""
    if not host and not path:
        return 0.0
    weights, bias = fitted or model()
    return float(1 / (1 + np.exp(-min(max(weights[features(host, path)].sum() + bias, -500.0), 500.0))))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, bool]]) -> tuple[Column, Column]:
    """The longest rule that fits, or null, and its verdict. A rule is host + path, with true for block."""
    rule = verdict = F.lit(None).cast("string")
    for text, block in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit("block" if block else "allow")).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, bool]], threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row of pages.

    The verdict is the rule's; without one it is block where the regression gives threshold or more.
    """

    fitted = pages.sparkSession.sparkContext.broadcast(model())  # BUCKETS numbers

    @F.pandas_udf("double")
    def scored(host, path):
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(host, path, strict=True):
            if pair not in known:
                known[pair] = probability(*pair, fitted.value)
            out.append(known[pair])
        import pandas as pd

        return pd.Series(out, dtype="float64")

    url = pages["url"].cast("string")
    split = pages.select(pages["page_id"].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "ruled": verdict, "block_score": scored("host", "path")})
    own = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "block_score")
