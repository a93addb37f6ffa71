"""URL verdicts: host and path rules first, else naive Bayes over words that Viterbi segmentation finds in the URL.

Words run together in a host ("bestcasinobonus") are split by the most probable sequence of known words. The words'
probabilities come from running text of the pages themselves: every word with at least MIN_SHARE of all words, hence
no more than 1 / MIN_SHARE words whatever the size of the corpus, which bounds what is broadcast.

Multinomial naive Bayes over the words of host and path gives the verdict where no rule fits. It starts from labelled
names, whose words label a URL each of at most SAMPLE hosts of the table, chosen by hash: bad from SURE on, good without
more signs of bad names than of good ones, and left out between. Word weights and the share of bad hosts (the prior) are
then fitted to names and labelled URLs, so words that go along with bad names weigh against a URL, too. A word's share in a
class is smoothed towards its share in both by SMOOTH words, so that common words weigh little while a class has few hosts.

Null URLs and URLs without "://" have an empty host and path and no words: naive Bayes then has only its prior. Rows are
judged one by one: no shuffle, equal hosts need no care, and repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvlake.llm.common import held_out

MIN_SHARE, SAMPLE, SURE, SMOOTH = 1e-5, 20_000, 0.7, 20.0
LETTERS = re.compile(r"[^\W\d_]+")

#: Labelled host names and path parts for the classifier, invented for this purpose; hyphens part words.
SEED_BLOCK = """spam-farm cheap-pills online-casino best-casino-bonus free-slots poker-bonus viagra-online buy-viagra-cheap
discount-meds pharmacy-no-prescription adult-cams adult-dating hot-singles-near-you xxx-videos porn-tube sex-chat
quick-payday-loans fast-cash-loans get-rich-now win-prize-now win-cash free-gift-card click-bait-links link-farm
seo-backlinks buy-followers replica-watches fake-rolex miracle-diet weight-loss-pills crypto-doubler bitcoin-giveaway
torrent-warez cracked-software keygen-download betting-tips sports-bets free-bets jackpot-spin lottery-winner escort-service
spam-sites malware-download phishing-login cheap-meds ad-server ads-tracker pop-ads click-track banner-ads casino bonus pills
spam farm xxx porn adult bets betting jackpot loans replica ads"""
SEED_ALLOW = """news daily-times city-library national-museum university-press science-journal open-data
public-health government-services school-district weather-report travel-guide cooking-recipes garden-club
music-review book-store history-archive developer-docs python-tutorial open-source-project local-council
community-forum sports-results film-festival art-gallery research-lab medical-center law-review farmers-market
health-food-store pharmacy-school savings-bank home-insurance job-board online-learning article
archive docs wiki forum about contact help press"""


class UrlModel(NamedTuple):
    logp: dict[str, float]  # of known words
    unknown: float  # log probability of a run of letters that is no known word, before its length counts
    longest: int
    log_odds: dict[str, float]  # block against allow
    prior: float


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule for the host or a parent domain whose path starts the given one, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # later ones are longer and take over
        domain, _, rest = r.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return rule, verdict


def page_words(pages: DataFrame, html: str = "html", min_share: float = MIN_SHARE) -> list:
    """(word, n, total) of the words of at least min_share of all words in the pages' running text."""
    text = F.regexp_replace(F.lower(F.col(html)), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # one row on the right; at most 1 / min_share rows remain
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total"))), F.col("n") >= F.col("total") * min_share).collect()


def url_sample(pages: DataFrame, url: str = "url", hosts: int = SAMPLE) -> list[tuple[str, str]]:
    """(host, smallest path) of at most so many hosts, chosen by hash from all; the fold that held_out() tells is left out."""
    host, path = parts(F.col(url))
    names = pages.select(host.alias("host"), path.alias("path")).where("host <> ''").where(~held_out(F.col("host")))
    names = names.groupBy("host").agg(F.min("path").alias("path"))
    return [(r.host, r.path) for r in names.orderBy(F.xxhash64("host"), "host").limit(hosts).collect()]


def _odds(named: list[Counter], found: list[Counter]) -> dict[str, float]:
    """Log odds of words, bad against good: a class's words are those of its URLs, and its names add to their own words."""
    every = named[0] + named[1] + found[0] + found[1]
    sums, spread = [c.total() + SMOOTH for c in found], SMOOTH / every.total()
    share = [{w: (names[w] + urls[w] + spread * n) / total for w, n in every.items()} for names, urls, total in zip(named, found, sums)]
    return {w: math.log(share[0][w] / share[1][w]) for w in every}


def fit(block: Iterable[str], allow: Iterable[str], corpus: Iterable[tuple[str, int, int]] = (), urls: Iterable[tuple[str, str]] = ()) -> UrlModel:
    """A model from labelled names (a bounded list), corpus word counts and unlabelled URLs (host, path)."""
    named = [Counter(LETTERS.findall(" ".join(names).lower())) for names in (block, allow)]
    seeds = named[0] + named[1]
    share = {w: 0.5 * n / seeds.total() for w, n in seeds.items()}
    for word, n, total in corpus:
        share[word] = share.get(word, 0.0) + 0.5 * n / total
    logp = {w: math.log(p) for w, p in share.items()}
    model = UrlModel(logp, math.log(0.5 * MIN_SHARE), max(map(len, logp), default=1), _odds(named, [Counter(), Counter()]), 0.0)
    cache: dict[str, list[str]] = {}
    found, hosts = [Counter(), Counter()], [1, 1]
    for host, path in urls:
        words = set(name_words(host, model, cache) + name_words(path, model, cache))
        p = block_probability(words, model)
        if p >= SURE or p <= 0.5:
            found[p <= 0.5].update(words)
            hosts[p <= 0.5] += 1
    if not any(found):
        return model
    return model._replace(log_odds=_odds(named, found), prior=math.log(hosts[0] / hosts[1]))


def segment(run: str, model: UrlModel) -> list[str]:
    """The most probable split of a run of letters (Viterbi); of equal splits the one with the longest last word."""
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        score, start = -math.inf, end - 1
        for at in range(max(0, end - model.longest), end):
            word = run[at:end]
            p = best[at] + model.logp.get(word, model.unknown - 3.0 * len(word))
            if p > score:
                score, start = p, at
        best.append(score)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def name_words(name: str, model: UrlModel, cache: dict[str, list[str]] | None = None) -> list[str]:
    """Words of a host or path: runs of letters, split further where they are no known word."""
    out = []
    for run in LETTERS.findall(name.lower()):
        if cache is None:
            out += segment(run, model)
            continue
        if run not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[run] = segment(run, model)
        out += cache[run]
    return out


def block_probability(words: Iterable[str], model: UrlModel) -> float:
    """Words outside the classifier's vocabulary say nothing."""
    z = model.prior + sum(model.log_odds.get(w, 0.0) for w in words)
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def judge_urls(pages: DataFrame, model: UrlModel, rules: dict[str, str], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, score, words) of each row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, list[str]] = {}

    @F.arrow_udf("struct<score:double,words:string>")
    def bayes(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        m, scores, texts = shared.value, [], []
        for host, path in zip(hosts.to_pylist(), paths.to_pylist()):
            words = name_words(host, m, memo) + name_words(path, m, memo)
            scores.append(block_probability(words, m))
            texts.append(" ".join(words))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(texts, pa.string())], ["score", "words"])

    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_b", bayes("host", "path"))
    method = F.when(F.col("_b.score") >= 0.5, "block").otherwise("allow")
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("_b.score").alias("score"), F.col("_b.words").alias("words"))
