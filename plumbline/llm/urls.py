"""URL filters: names of hosts are split into words, and a naive Bayes classifier judges hosts and paths."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import join_counted, lower_ascii, read
from plumbline.plans.durable import cut_lineage

#: The rules of the query, and the words from which the classifier starts.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BLOCK_WORDS = (
    "ad ads adult bet bets betting bingo bonus casino cheap cialis click crypto deals dating discount download escort farm free "
    "gambling jackpot loan loans lottery pharma pill pills poker porn prize promo replica sex slot slots spam torrent track tracker "
    "tracking viagra warez win winner xxx"
).split()
LONGEST_WORD = 24
#: A name is a first example of block if words of the list make up this share of its letters, and counted words the rest.
LISTED_SHARE = 0.75
#: A path of numbers says nothing of its own: a run of digits is one token.
NUMBER = "#"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is ``host/path``; it fits subdomains of its host too."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    fits = []
    for verdict, rule in ordered:
        name, slash, rest = rule.partition("/")
        fits.append(((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest)))
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return pick([r[1] for r in ordered]), pick([r[0] for r in ordered])


def letters(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), r"[^\p{L}]+"), lambda w: w != "")


def segment_names(names: DataFrame, counts: DataFrame, seeds: Sequence[str] = BLOCK_WORDS) -> DataFrame:
    """(name, words, listed): each distinct name split into the words that make it likeliest under unigram counts, and whether
    words of the list make it up, or nearly so with counted words as the rest: an ordinary name that holds one is not listed.

    Parts of a name of 2 to 24 letters are joined to the words counted in the corpus, so no dictionary is sent around; Viterbi
    runs on the words found for one name. A stretch that no word covers costs more than any word, the more the longer it is, and less in one piece.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = F.sequence(F.lit(1), F.length("name"))
    ends = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("start") + 1))
    parts = names.select("name", F.explode(starts).alias("start")).select("name", "start", F.explode(ends).alias("n_letters"))
    parts = parts.select("name", F.expr("substring(name, start, n_letters)").alias("word"))
    found = parts.join(counts.withColumnRenamed("n", "times"), "word", "left").groupBy("name").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("times").isNotNull(), F.struct("word", "times")))).alias("known")
    )
    seeded = {w: 1 for w in seeds}

    def viterbi(name: str, known: dict[str, int]) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                part = name[start:end]
                times = known.get(part, 0) + seeded.get(part, 0)
                cost = math.log(total + len(seeded) + 1) - math.log(times) if times else (math.log(total + len(seeded) + 1) + 3) * len(part) + 1
                options.append((round(best[start][0] + cost, 9), start))
            best.append(min(options))
        words, end = [], len(name)
        while end:
            start = best[end][1]
            words.append(name[start:end])
            end = start
        return words[::-1]

    def is_listed(name: str, words: list[str], known: dict[str, int]) -> bool:
        explained = all(w in seeded or w in known for w in words)
        return explained and sum(len(w) for w in words if w in seeded) >= LISTED_SHARE * len(name)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = [dict(k or {}) for k in batch["known"]]
            words = [viterbi(n, k) for n, k in zip(batch["name"], known, strict=True)]
            listed = [is_listed(n, w, k) for n, w, k in zip(batch["name"], words, known, strict=True)]
            yield pd.DataFrame({"name": batch["name"], "words": words, "listed": listed})

    return found.mapInPandas(split, "name string, words array<string>, listed boolean")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(id, host, path, rule, verdict, score, host_words) of each row; score is the classifier's probability of block.

    1. Words are counted over all paths and page titles. 2. Each distinct run of letters in a host is segmented. 3. Hosts with a
    name made up of the starting list's words, or nearly, are the first examples of block, all others of allow; a multinomial naive Bayes model counts, over
    all pages, the words of hosts and the tokens of paths in both classes. 4. Each page is scored by its tokens; a rule that
    fits decides before the score.

    Null and malformed URLs have empty host and path and no token: the verdict is allow with score 0, since nothing speaks
    against them. Repeated rows and ties are judged alike (equal odds: allow); an empty table gives no rows. Rows are matched
    by hosts and tokens that are counted first, so frequent ones are no hot spots.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(id).alias("__id"), host.alias("host"), path.alias("path"))
    title = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1) if html else F.lit("")
    said = pages.select(F.explode(F.concat(letters(title), letters(path))).alias("word"))
    counts = cut_lineage(said.filter(F.length("word").between(2, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    # distinct hosts and paths, with the number of pages of each
    pairs = cut_lineage(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages")))
    hosts = pairs.groupBy("host").agg(F.count(F.lit(1)).alias("paths"), F.sum("pages").alias("pages"))
    in_hosts = hosts.select("host", "pages", F.posexplode_outer(letters(F.col("host"))).alias("at", "name"))
    segmented = segment_names(in_hosts.select("name").filter("name IS NOT NULL").distinct(), counts)
    named = in_hosts.join(segmented, "name", "left")
    worded = named.groupBy("host", "pages").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "words"))), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("host_words"),
        F.coalesce(F.bool_or("listed"), F.lit(False)).alias("bad"),
    )
    known_hosts = cut_lineage(worded.join(hosts.select("host", "paths"), "host"))
    n_pairs = pairs.count()
    by_path = join_counted(pairs, known_hosts.select("host", "bad", "paths"), ["host"], "paths", n_pairs)
    path_tokens = F.filter(F.split(F.regexp_replace(lower_ascii(F.col("path")), r"\p{Nd}+", f" {NUMBER} "), rf"[^\p{{L}}{NUMBER}]+"), lambda w: w != "")
    of_path = by_path.select("host", "path", "pages", "bad", F.explode(F.transform(path_tokens, lambda w: F.concat(F.lit("/"), w))).alias("token"))
    of_host = known_hosts.select("host", "pages", "bad", F.explode("host_words").alias("token"))
    weight = lambda bad: F.coalesce(F.sum(F.when(F.col("bad") == bad, F.col("pages"))), F.lit(0))
    tokens = cut_lineage(
        of_path.select("token", "pages", "bad").union(of_host.select("token", "pages", "bad"))
        .groupBy("token").agg(weight(True).alias("block"), weight(False).alias("allow"), F.count(F.lit(1)).alias("n"))
    )
    sums = tokens.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1)), F.sum("n")).first()
    block, allow, different, n_tokens = (x or 0 for x in sums)
    classes = known_hosts.agg(F.sum(F.when(F.col("bad"), F.col("pages"))), F.sum(F.when(~F.col("bad"), F.col("pages")))).first()
    prior = math.log(((classes[0] or 0) + 1) / ((classes[1] or 0) + 1))
    odds = F.log((F.col("block") + 1) / F.lit(float(block + different + 1))) - F.log((F.col("allow") + 1) / F.lit(float(allow + different + 1)))
    weighed = tokens.select("token", "n", odds.alias("odds"))
    host_odds = join_counted(of_host.select("host", "token"), weighed, ["token"], "n", n_tokens).groupBy("host").agg(F.sum("odds").alias("host_odds"))
    path_odds = join_counted(of_path.select("host", "path", "token"), weighed, ["token"], "n", n_tokens).groupBy("host", "path").agg(F.sum("odds").alias("path_odds"))
    judged_hosts = cut_lineage(known_hosts.join(host_odds, "host", "left").select("host", "paths", "host_words", "host_odds"))
    total_pages = pairs.agg(F.sum("pages")).first()[0] or 0
    judged = join_counted(pairs.join(path_odds, ["host", "path"], "left"), judged_hosts, ["host"], "paths", n_pairs)
    evidence = F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)) + F.lit(prior)
    no_token = F.col("host_odds").isNull() & F.col("path_odds").isNull()
    scored = judged.select("host", "path", "pages", "host_words", F.when(no_token, 0.0).otherwise(1 / (1 + F.exp(-F.round(evidence, 6)))).alias("score"))
    joined = join_counted(rows, cut_lineage(scored), ["host", "path"], "pages", total_pages)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return joined.select(F.col("__id").alias(id), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score", "host_words")


def op4_url_filter(spark: SparkSession, path: str) -> DataFrame:
    """A verdict on every page's URL; see :func:`judge_urls`."""
    return judge_urls(read(spark, path, "pages").select("page_id", "url", "html"))
