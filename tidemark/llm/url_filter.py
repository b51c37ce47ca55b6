"""URL filter: host and path rules first, then gradient-boosted trees.

Rules are (host, path) with a verdict; one fits its host and all subdomains if the
url's path starts with the rule's, and the longest fitting rule wins.  Few rules become
one expression; a long list is joined on the suffixes of the distinct hosts.

Urls without a rule go to trees that are boosted on lexical features: length, path
depth, digit ratio, entropy of the host, parameter count, hyphens and statistics of
the host's suffixes (smoothed block rates among the labelled urls).  They are trained
on labelled urls, at most ``most_labelled`` of them, by a hash of the url; a threshold on
it thins the rows on the executors.

Nulls, empties, repeats: a null url, or one without ``://``, has empty host and path,
fits no rule and is judged by the trees on empty features.  Every row gives a row.
Rows that repeat a url or an id are judged each, alike.  Urls of any length are read
whole.  Without labelled urls of both kinds the trees allow everything.  Of rules of the
same text the one given last wins.  Empty tables give empty results; columns other than
id and url are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.quality import drawn

#: Words that mark a host of a labelled url as one to block.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "farm", "pills", "poker", "porn", "spam", "track", "viagra", "xxx")
FEW_RULES = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.translate(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host and path, like "example.net/en/"

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def apply_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (with host, path) plus rule and rule_verdict, null where none fits."""
    rules = list({r.text: r for r in rules}.values())
    if len(rules) <= FEW_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return rows.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "suffix string, rule_path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = rows.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix")
    by_host = fitting.groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "rule_verdict", "rule_path")).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])))
    joined = rows.join(by_host, "host", "left").withColumn("best", best)
    return joined.withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("rules", "best")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _suffixes(host: str) -> tuple[str, str, str]:
    """Top-level label, registered name's last three characters, its longest hyphen part's ending."""
    labels = host.split(".")
    name = labels[-3] if len(labels) > 2 else labels[0]
    return labels[-1], name[-3:], name.rpartition("-")[2][-4:] if "-" in name else ""


def lexical(url: str | None, rates: dict[tuple[int, str], float], base: float) -> list[float]:
    url = url or ""
    rest = url.partition("://")[2]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].lower(), rest[end:]
    path, _, query = tail.partition("#")[0].partition("?")
    digits = sum(c.isdigit() for c in url)
    return [
        float(len(url)),
        float(len(host)),
        float(path.count("/")),
        digits / max(len(url), 1),
        sum(c.isdigit() for c in host) / max(len(host), 1),
        _entropy(host),
        float(query.count("&") + 1 if query else 0),
        float(host.count("-")),
        float(host.count(".")),
        float("#" in tail),
        *(rates.get((i, s), base) for i, s in enumerate(_suffixes(host))),
    ]


@dataclass
class Tree:
    """A depth-limited regression tree as a flat list: (feature, threshold, left, right) or (-1, value, 0, 0)."""

    nodes: list[tuple[int, float, int, int]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        f = np.array([n[0] for n in self.nodes])
        t = np.array([n[1] for n in self.nodes])
        left, right = np.array([n[2] for n in self.nodes]), np.array([n[3] for n in self.nodes])
        while (f[at] >= 0).any():
            inner = f[at] >= 0
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return t[at]


def _grow(tree: Tree, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> int:
    me = len(tree.nodes)
    tree.nodes.append((-1, float(-g.sum() / (h.sum() + l2)), 0, 0))
    if depth == 0 or len(g) < 20:
        return me
    best, split = 1e-6, None
    total_g, total_h = g.sum(), h.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        gain = cg[cut] ** 2 / (ch[cut] + l2) + (total_g - cg[cut]) ** 2 / (total_h - ch[cut] + l2) - total_g**2 / (total_h + l2)
        k = int(gain.argmax())
        if gain[k] > best:
            best, split = float(gain[k]), (f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if split is None:
        return me
    go = x[:, split[0]] <= split[1]
    left = _grow(tree, x[go], g[go], h[go], depth - 1, l2)
    right = _grow(tree, x[~go], g[~go], h[~go], depth - 1, l2)
    tree.nodes[me] = (*split, left, right)
    return me


@dataclass
class Boosted:
    rates: dict[tuple[int, str], float]
    base_rate: float
    bias: float
    trees: list[Tree]

    def features(self, urls: list) -> np.ndarray:
        return np.array([lexical(u, self.rates, self.base_rate) for u in urls], np.float64).reshape(len(urls), 13)

    def score(self, urls: list) -> np.ndarray:
        x = self.features(urls)
        z = np.full(len(x), self.bias)
        for t in self.trees:
            z += 0.2 * t.predict(x)
        return 1 / (1 + np.exp(-z))


def boost(urls: list, blocked: np.ndarray, rounds: int = 40, depth: int = 3, l2: float = 1.0) -> Boosted | None:
    """Logistic boosting with second-order leaves; deterministic."""
    y = blocked.astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    base = float(y.mean())
    seen: dict[tuple[int, str], list[float]] = {}
    for u, v in zip(urls, y, strict=True):
        rest = (u or "").partition("://")[2]
        host = rest[: min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))].lower()
        for key in enumerate(_suffixes(host)):
            pair = seen.setdefault(key, [0.0, 0.0])
            pair[0] += v
            pair[1] += 1
    rates = {k: (a + 20 * base) / (n + 20) for k, (a, n) in seen.items()}
    model = Boosted(rates, base, math.log(base / (1 - base)), [])
    x, z = model.features(urls), np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = Tree()
        _grow(tree, x, p - y, p * (1 - p) + 1e-9, depth, l2)
        model.trees.append(tree)
        z += 0.2 * tree.predict(x)
    return model


def labelled_by_words(pages: DataFrame, words: tuple[str, ...] = BLOCKED_WORDS, url_col: str = "url") -> DataFrame:
    """url, blocked: a page's url is labelled by whether a part of its host is a listed word."""
    parts = F.split(host_of(F.col(url_col)), r"[.\-_0-9]+")
    return pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.arrays_overlap(parts, F.array(*map(F.lit, words))).alias("blocked"))


def fit_urls(labelled: DataFrame, most_labelled: int) -> Boosted | None:
    known = labelled.where("url is not null and blocked is not null").select(F.col("url").alias("id"), "blocked")
    rows = drawn(known, most_labelled, known.count(), 0, "blocked").collect()
    return boost([r.id for r in rows], np.array([r.blocked for r in rows], bool)) if rows else None


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], labelled: DataFrame, most_labelled: int = 10_000, block_from: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (the trees' probability, also where a rule decides)."""
    shared = spark.sparkContext.broadcast(fit_urls(labelled, most_labelled))

    @F.pandas_udf("double")
    def score(url: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(np.round(own.score(url.where(url.notna(), None).tolist()), 9) if own else np.zeros(len(url)))

    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", "url", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    judged = apply_rules(rows, rules).withColumn("block_score", score("url"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= block_from, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
