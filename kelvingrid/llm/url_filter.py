"""URL filters: host and path rules, and a logistic regression on hashed character n-grams behind them."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Width of the hashed feature space and the n-gram lengths.
WIDTH, GRAMS = 1 << 14, (3, 4, 5)

#: A small labelled URL table, made up for training: (url, 1 for block).
LABELLED: list[tuple[str, int]] = [
    ("http://free-bets.example.net/win/now", 1), ("https://www.casino-royal.test/slots", 1), ("http://casino-win.example.com/en/12", 1),
    ("http://best-casino.test/jackpot", 1), ("https://online-bets.test/poker?ref=1", 1), ("http://bets-free.test/bonus", 1),
    ("http://cheap-pills.example.org/en/5", 1), ("https://buy-pills.test/cheap/viagra", 1), ("http://pills-cheap-rx.test/order", 1),
    ("http://pharma-pills.test/discount", 1), ("http://spam-farm.example.org/en/7", 1), ("http://link-farm.test/seo-spam", 1),
    ("https://spam-links.test/backlinks", 1), ("http://www.spam-site.test/click", 1), ("http://ads-track.example.com/en/1", 1),
    ("https://track-ads.test/pixel?id=3", 1), ("http://ads.click-track.test/banner", 1), ("http://popup-ads.test/go", 1),
    ("http://adult-x.example.net/en/9", 1), ("https://xxx-adult.test/cams", 1), ("http://adult-video.test/x", 1), ("http://sexy-adult-x.test/chat", 1),
    ("http://free-win-prize.test/claim", 1), ("http://win-money-fast.test/offer", 1), ("http://m.free-bets.test/es/3", 1), ("http://blog.casino-win.test/fr/8", 1),
    ("https://www.cheap-pills.test/de/4", 1), ("http://m.adult-x.test/en/2", 1), ("http://blog.ads-track.test/en/6", 1), ("http://www.spam-farm.test/fr/9", 1),
    ("https://blog.therton.example.net/en/633", 0), ("http://www.thanes.example.com/fr/12", 0), ("https://m.tionre.example.org/es/8", 0),
    ("http://ththin.example.com/en/671", 0), ("https://www.library.test/catalog/books", 0), ("http://news.daily.test/world/2024/05", 0),
    ("https://docs.project.test/en/latest/index.html", 0), ("http://blog.garden.test/recipes/bread", 0), ("https://www.school.test/courses/history", 0),
    ("http://museum.test/de/ausstellung", 0), ("https://wiki.test/fr/article/Paris", 0), ("http://forum.cycling.test/thread/99", 0),
    ("https://weather.test/es/madrid", 0), ("http://blog.ndering.example.org/en/17.html", 0), ("https://www.onthere.example.net/de/42/", 0),
    ("http://ingerre.example.com/fr/77#top", 0), ("https://m.ererth.example.org/es/5", 0), ("http://shops.test/furniture/tables", 0),
    ("https://research.university.test/papers/physics.pdf", 0), ("http://city.test/services/water", 0), ("https://music.test/albums/jazz", 0),
    ("http://travel.test/en/guide/lisbon", 0), ("https://health.clinic.test/doctors", 0), ("http://www.code.test/python/tutorial", 0),
    ("http://blog.ththat.test/en/3", 0), ("http://www.thouin.test/fr/25", 0), ("https://m.enthe.test/de/81", 0), ("http://atanes.test/es/64", 0),
    ("https://blog.edions.test/en/9.html", 0), ("http://lyhaor.test/fr/204", 0),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of ``rules`` (``host/path`` strings) that fits: its host or a subdomain of it, and a path that starts with its path.  Null: none."""
    out = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path; the two have separate grams."""
    grams = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode()
        for n in GRAMS:
            grams.update(zlib.crc32(raw[i : i + n], ord(mark) * n) % WIDTH for i in range(len(raw) - n + 1))
    return np.fromiter(grams, np.int64, len(grams))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, as ``host_of`` and ``path_of`` have them (for the training table and tests)."""
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[:end]


def train(table: Sequence[tuple[str, int]] = LABELLED, ridge: float = 0.02, steps: int = 400, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by gradient descent on the small table (rows scaled to length 1)."""
    rows = [features(*split_url(u)) for u, _ in table]
    y = np.array([label for _, label in table], np.float64)
    w, bias = np.zeros(WIDTH), 0.0
    for _ in range(steps):
        z = np.array([w[r].sum() / np.sqrt(max(len(r), 1)) for r in rows]) + bias
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.zeros(WIDTH)
        for r, e in zip(rows, error):
            grad[r] += e / np.sqrt(max(len(r), 1))
        w -= rate * (grad / len(rows) + ridge / len(rows) * w)
        bias -= rate * error.mean()
    return w, bias


def block_chance(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    """Chance that a URL is one to block; a host that repeats within a batch is scored once per path."""
    w, bias = model

    def score(h: pd.Series, p: pd.Series) -> pd.Series:
        out = np.empty(len(h))
        for i, (a, b) in enumerate(zip(h, p)):
            r = features(a or "", b or "")
            out[i] = w[r].sum() / np.sqrt(max(len(r), 1)) + bias
        return pd.Series(1 / (1 + np.exp(-out)))

    return F.pandas_udf(score, "double")(host, path)


def judge_urls(pages: DataFrame, allow: Sequence[str], block: Sequence[str], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Rows (id, host, path, rule, verdict, score): the longest rule decides, else the classifier.

    A null URL or one without ``://`` has an empty host and path and is left to the classifier.  A rule that is in
    both lists blocks.  Nothing is shuffled: repeated rows, hot hosts and long URLs cost no more than others; an
    empty table gives no rows.  Only id and URL are read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block]))
    scored = ruled.withColumn("score", block_chance(F.col("host"), F.col("path"), train()))
    verdict = F.when(F.col("rule").isin(list(block)), "block").when(F.col("rule").isin(list(allow)), "allow").otherwise(F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
