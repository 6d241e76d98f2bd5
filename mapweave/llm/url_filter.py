"""URL filters: host rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule is (verdict, host, path): it fits its host and all subdomains where
the url's path starts with the rule's; the longest rule wins. Where none
fits, the vocabulary decides. Its terms have weights, and a url whose distinct
terms weigh ``LIMIT`` or more is rejected: a strict term weighs as much alone,
of soft ones it takes several. A term counts only between boundaries, that is
next to anything but a letter or digit.

The automaton scans every url whole, with query and fragment, in Python; the
parsing and the rules are Spark expressions. Nothing is shuffled. A vocabulary
may come from a table (term, weight), of at most ``MOST_TERMS`` rows.

Defined results: a null or empty url, or one without ``://``, has an empty
host and path and no rule; a null url has the verdict allow, one without
``://`` is scanned whole like any other; urls of any length are scanned whole;
of rules of one length the last by (length, rule) order wins; repeated rows
and null keys stay; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import ascii_lower

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LIMIT = 2.0
MOST_TERMS = 1_000_000
STRICT = (
    "porn", "porno", "xxx", "hentai", "milf", "camgirl", "camgirls", "nudes", "escort", "escorts", "casino", "casinos-online", "sportsbook", "roulette", "blackjack", "baccarat",
    "viagra", "cialis", "levitra", "phentermine", "tramadol", "warez", "keygen", "keygens", "crackz", "serialz",
)
SOFT = (
    "bet", "bets", "betting", "poker", "slots", "jackpot", "bingo", "lotto", "lottery", "gambling", "wager", "odds", "spins", "bonus", "free", "win", "winner", "adult", "dating", "singles",
    "sexy", "nude", "erotic", "fetish", "webcam", "cams", "loan", "loans", "payday", "mortgage", "refinance", "forex", "pills", "pharmacy", "meds", "steroids", "diet", "torrent", "torrents",
    "crack", "cracked", "nulled", "serial", "hack", "hacks", "cheats", "cheap", "replica", "discount", "clearance",
)
VOCABULARY = {**dict.fromkeys(SOFT, LIMIT / 2), **dict.fromkeys(STRICT, LIMIT)}


def parse_url(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def count_terms(texts: Sequence[str], automaton, vocabulary: Mapping[str, float], limit: float = LIMIT) -> tuple[list[int], list[int], list[float]]:
    """Per text: hits of terms that weigh the limit alone, other distinct terms, and the weight of all distinct terms."""
    strict, soft, weights = [], [], []
    for text in texts:
        low, hits, seen = text.lower(), 0, set()
        for end, term in automaton.iter(low):
            start = end - len(term) + 1
            if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                hits += vocabulary[term] >= limit
                seen.add(term)
        strict.append(hits)
        soft.append(sum(vocabulary[t] < limit for t in seen))
        weights.append(float(sum(vocabulary[t] for t in seen)))
    return strict, soft, weights


def build_automaton(vocabulary: Mapping[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in vocabulary:
        out.add_word(term, term)
    out.make_automaton()
    return out


def read_vocabulary(terms: DataFrame) -> dict[str, float]:
    """(term, weight) -> the vocabulary in lower case; of a term that repeats the largest weight, null terms and weights left out."""
    rows = terms.where("term <> '' and weight is not null").groupBy(F.lower("term").alias("term")).agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary may have {MOST_TERMS} terms at most")
    return {r["term"]: float(r["weight"]) for r in rows}


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: Mapping[str, float] | DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, n_strict, n_soft, weight."""
    held = read_vocabulary(vocabulary) if isinstance(vocabulary, DataFrame) else dict(VOCABULARY if vocabulary is None else vocabulary)

    @F.pandas_udf("strict int, soft int, weight double")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(held) if held else None
        for urls in batches:
            strict, soft, weight = count_terms(urls.fillna("").tolist(), automaton, held, limit) if held else ([0] * len(urls),) * 3
            yield pd.DataFrame({"strict": strict, "soft": soft, "weight": weight})

    host, path = parse_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), terms(F.col("url")).alias("n"))
    by_terms = F.when(F.col("n.weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_terms).alias("verdict"), F.col("n.strict").alias("n_strict"), F.col("n.soft").alias("n_soft"), F.col("n.weight").alias("weight"))
