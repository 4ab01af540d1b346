"""URL filter: host and path rules, else a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontamination import LOWER, UPPER

#: (rule, verdict); a rule is a host and a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: One of these terms blocks a url; of the soft ones it takes several different ones. English, German, French, Spanish.
STRICT = (
    "casino", "casinos", "porn", "porno", "pornos", "pornographie", "pornografia", "xxx", "nsfw", "viagra", "cialis", "levitra", "escort", "escorts", "hentai",
    "camgirl", "camgirls", "sexcam", "sexcams", "sexshop", "gambling", "betting", "jackpot", "torrent", "torrents", "warez", "keygen", "phishing", "malware",
    "gluecksspiel", "spielautomaten", "sportwetten", "pokies", "apuestas", "tragaperras", "ruleta", "prostitutas", "putas", "nutten", "huren", "putes",
)
SOFT = (
    "win", "winner", "bet", "bets", "poker", "slots", "slot", "roulette", "bonus", "free", "gratis", "gratuit", "kostenlos", "cheap", "billig", "barato", "pills",
    "adult", "adulte", "adultos", "erotik", "erotica", "erotique", "sexy", "sex", "sexe", "sexo", "nude", "dating", "rencontre", "citas", "loan", "loans",
    "kredit", "payday", "crypto", "prize", "lottery", "lotto", "loteria", "hot", "cams", "deal", "deals", "hack", "hacks", "crack", "cracked", "spins", "wetten",
)
SEVERAL = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def _fits(host: Column, path: Column, rule: str) -> Column:
    rule_host, _, rest = rule.partition("/")
    return ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """The automaton of the terms, made once in a worker."""
    found = ahocorasick.Automaton()
    for sure, terms in ((False, soft), (True, strict)):
        for term in terms:
            found.add_word(term, (term, sure))
    found.make_automaton()
    return found


def vocabulary_hit(url: str, strict: tuple[str, ...], soft: tuple[str, ...], several: int) -> bool:
    """Whether a url, percent-decoded and lower-cased, has a strict term, or so many different soft ones, at word bounds."""
    url = (unquote(url) if "%" in url else url).lower()
    seen = set()
    for end, (term, sure) in automaton(strict, soft).iter(url):
        start = end - len(term) + 1
        if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
            if sure:
                return True
            seen.add(term)
            if len(seen) >= several:
                return True
    return False


def vocabulary_hits(strict: tuple[str, ...], soft: tuple[str, ...], several: int):
    """A function of a url column; see vocabulary_hit. Null urls have no hit."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in arrays:
            yield pa.array([url is not None and vocabulary_hit(url, strict, soft, several) for url in urls.to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean")


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    several: int = SEVERAL,
) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins and gives the verdict.
    Where none fits, the vocabulary judges the percent-decoded url: block on a strict term or on `several` different soft
    ones, at word bounds, else allow. Null urls and urls without `://` have empty host and path, no rule, and are judged by
    their text (null: allow). Urls of any length are judged whole, in time that grows with their length. Repeated rows are
    judged each, ids may be null and of any type, other columns are ignored, whatever their names, an empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
    ).select("id", "url", host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    none = F.lit(None).cast("string")
    pick = lambda value: reduce(lambda rest, r: F.when(_fits(F.col("host"), F.col("path"), r[0]), F.lit(value(r))).otherwise(rest), reversed(ordered), none)
    rows = rows.select(
        "*", pick(lambda r: r[0]).alias("rule"), pick(lambda r: r[1]).alias("ruled"),
        vocabulary_hits(tuple(strict), tuple(soft), several)(F.col("url")).alias("hit"),
    )
    verdict = F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
