"""URL filter: rules first, then naive Bayes over the words of host and path, host names being split by a unigram Viterbi."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: Words of the lexicon besides those of the corpus, and labelled examples (one a line) that the classifier is trained on.
LEXICON = (
    "about academy account ads adult article articles auto baby bank bet betting blog bonus book books business buy car cards care cash casino"
    " cheap cheats city click cloud club code college coupon crack credit data date dating deal deals design dev diet discount docs domain download"
    " drug drugs easy education escort events fake farm fast film finance fitness food forum free fund game games garden gold government guide"
    " health help history home hosting hot hotel house info insurance journal keygen lab learn legal library life link links loan loans local lottery"
    " loss lucky mail market math media medicine money mortgage movie museum music nature net news now nude office offer offers online open order park"
    " payday pharma pharmacy photo pills play poker porn press prize pro project radio rapid recipe replica research review reviews rich rolex sale"
    " school science search seo service sex shop shopping site slots soft software spam sport sports store story stream support tech test text track tracker banner"
    " amazon app apps art at biz british ca ch cloud co com content cool daily de dot east edu en engine es eu example express fi first fr gov group guru hub info io it jobs just king la land live mail map max mobile more nl no north"
    " one org out paper pl plus post power real red school se server smart south space start state street team the time today up us user video west wiki with work works you your zone"
    " tickets tips top torrent tour trade traffic travel tube university viagra video warez watch water weather web weight wiki win winner world xxx"
).split()
BAD = """cheap pills online
spam farm links
ads track click
ad tracker banner traffic
cheap viagra pharmacy buy now
online casino bonus free
poker bet win cash prize
payday loan fast cash
replica rolex watch sale cheap
xxx adult porn video
sex escort dating nude
warez crack keygen download free
torrent movie stream free download
weight loss diet pills
lottery winner prize click
seo links traffic farm spam
fake pharma drugs order online
betting slots lucky bonus
free coupon click win offer
link farm seo spam spam""".splitlines()
GOOD = """blog article news
university research science
wiki history article
docs help guide code
library book journal
news press story weather
school college education learn
museum park garden nature
software dev project docs
health care medicine journal
music film photo review
city government office service
blog travel food recipe
forum support help
data science math research
sport club events news
home garden local news
www en blog m""".splitlines()

HOST, PATH = r"^(?s).*?://([^/?#]*)", r"^(?s).*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """allow or block (verdict) all urls of host and its subdomains whose path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without a ://, and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Number of the longest rule that fits (the first among equally long ones), or null. Rules are a parameter, not data."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    fits = [F.when(((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path), F.lit(i)) for i in order]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def segment(name: str, cost: dict[str, float], unknown: float, longest: int | None = None) -> list[str]:
    """The cheapest split of a run of letters into words of the lexicon; a letter outside of a word costs `unknown`.

    Neighbouring unknown letters are given back as one word. longest: of the lexicon's words, if known.
    """
    longest = longest or max(map(len, cost), default=1)
    best, back = [0.0], [(0, False)]
    for j in range(1, len(name) + 1):
        options = [(best[j - 1] + unknown, j - 1, False)]
        for i in range(max(0, j - longest), j):
            if (c := cost.get(name[i:j])) is not None:
                options.append((best[i] + c, i, True))
        b, i, known = min(options)
        best.append(b)
        back.append((i, known))
    words, j, known_before = [], len(name), True
    while j:
        i, known = back[j]
        if known or known_before:
            words.append(name[i:j])
        else:
            words[-1] = name[i:j] + words[-1]
        known_before, j = known, i
    return words[::-1]


@dataclass
class UrlModel:
    """Unigram costs and the multinomial naive Bayes; token_odds and prior are logarithms of block against allow."""

    cost: dict[str, float]
    unknown: float
    token_odds: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    remembered: dict[str, list[str]] = field(default_factory=dict, repr=False)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.cost), default=1)

    def words(self, text: str) -> list[str]:
        out = []
        for run in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", text.lower()):
            if (got := self.remembered.get(run)) is None:
                got = segment(run, self.cost, self.unknown, self.longest)
                if len(self.remembered) >= 100_000:
                    self.remembered.clear()
                self.remembered[run] = got
            out += got
        return out

    def odds(self, host: str, path: str) -> float:
        """Of the segmented words of host and path; words that training did not see say nothing."""
        return self.prior + sum(self.token_odds.get(w, 0.0) for w in self.words(host) + self.words(path))


def train(counts: dict[str, int], bad: list[str] = BAD, good: list[str] = GOOD, alpha: float = 1.0) -> UrlModel:
    """counts: how often the corpus has each word; the fixed lexicon has a thousandth of all besides."""
    total = sum(counts.values()) + 1
    base = max(1, total // 1000)
    both = Counter(counts)
    for w in LEXICON:
        both[w] += base
    total = sum(both.values())
    # a word costs its log-probability; an unknown letter more than a letter of any usual word
    cost = {w: -math.log(n / total) for w, n in both.items() if len(w) > 1}
    model = UrlModel(cost, max(cost.values(), default=10.0) + 3)
    seen = [Counter(w for line in lines for w in line.split()) for lines in (bad, good)]
    sizes, words = [sum(x.values()) for x in seen], set(seen[0]) | set(seen[1])
    for w in words:
        model.token_odds[w] = math.log((seen[0][w] + alpha) / (sizes[0] + alpha * len(words))) - math.log((seen[1][w] + alpha) / (sizes[1] + alpha * len(words)))
    model.prior = math.log(len(bad) / len(good)) - math.log(3)  # block only on evidence
    return model


def lexicon(pages: DataFrame, url: str = "url", least: int = 2, longest: int = 24) -> dict[str, int]:
    """On how many pages each word stands in the path or (with a column html) in the title, if it also stands within a host name.

    A word is a whole run of 2 to `longest` letters a-z, on `least` pages or more. Host names as such are left out: as words of their own they
    would never be split. Words that no host name holds could split none; leaving them out bounds the table by the hosts' vocabulary.
    """
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1) if "html" in pages.columns else F.lit("")
    text = F.lower(F.concat_ws(" ", url_path(F.col(url)), title))
    run = F.lit(f"(?<![a-z])[a-z]{{2,{longest}}}(?![a-z])")
    parts = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(text, run, F.lit(0)))).alias("w"))
    counts = parts.groupBy("w").count().where(F.col("count") >= least)
    names = pages.select(F.explode(F.regexp_extract_all(url_host(F.col(url)), F.lit("[a-z]{2,}"), F.lit(0))).alias("name")).distinct()
    at = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name") - 1)).alias("i"))
    within = at.select(F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.length("name") - F.col("i") + 1)), lambda n: F.substring(F.col("name"), F.col("i"), n))).alias("w")).distinct()
    return dict(counts.join(within, "w", "left_semi").toLocalIterator())


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, block_odds and words (host and path segmented).

    A url that is null or has no :// has empty host and path, fits no rule, and is judged by the prior: allow. Columns of
    pages with one of these names are replaced. Repeated rows are judged each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(lexicon(pages, url)))
    made = ["host", "path", "rule", "verdict", "block_odds", "words"]
    kept = [c for c in pages.columns if c not in made or c == url]
    host, path = url_host(F.col(url)), url_path(F.col(url))

    @F.pandas_udf("odds double, words string")
    def score(hosts, paths):  # noqa: ANN001, ANN202
        import pandas as pd

        model = shared.value
        rows = [(model.odds(h, p), " ".join(model.words(h) + model.words(p))) for h, p in zip(hosts, paths)]
        return pd.DataFrame(rows, columns=["odds", "words"])

    names = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array().cast("array<string>")
    verdicts = F.array(*(F.lit(r.verdict) for r in rules)) if rules else F.array().cast("array<string>")
    out = pages.select(F.struct(*(pages[f"`{c}`"] for c in kept)).alias("row"), host.alias("host"), path.alias("path"))
    out = out.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("fits"), score("host", "path").alias("score"))
    verdict = F.coalesce(F.get(verdicts, F.col("fits")), F.when(F.col("score.odds") > 0, "block").otherwise("allow"))
    return out.select(*(C.own(c).alias(c) for c in kept), "host", "path", F.get(names, F.col("fits")).alias("rule"), verdict.alias("verdict"), F.col("score.odds").alias("block_odds"), F.col("score.words").alias("words"))
