"""URL filters: host rules, then a weighted vocabulary found with an Aho-Corasick automaton.

Rules are (verdict, host and path prefix); a rule fits its host and every subdomain if the
url's path starts with the rule's path, and the longest fitting rule decides. Any other url is
searched for the terms of a vocabulary, strict ones and soft ones with a weight each. A term counts once, where it is a
whole run of ASCII letters and digits (boundaries on both sides; any other character, also one beyond ASCII, is a boundary) of
the url with A-Z lower-cased. One strict term blocks; so do SOFT_TERMS different soft terms whose weights add up
to SOFT_WEIGHT. The vocabulary is a parameter: a file of `term weight` lines (`strict` as the weight of a strict term) or two collections.

Defined results: a null url and a url without :// have an empty host and path, fit no rule and
are judged by the vocabulary alone (null: allowed).
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import field, with_columns

# The rules that the contract names.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Terms of sites that no corpus wants: one is enough. Words with an innocent meaning in a language of the corpus are soft.
STRICT = tuple(
    "porn porno pornhub pornstar xxx xvideos xnxx xhamster redtube youporn hentai milf camgirl camgirls livecam livecams webcamsex sexcam sexcams sexchat"
    " escorts callgirl callgirls onlyfans fetish bdsm cumshot blowjob gangbang casino casinos kasino onlinecasino jackpot sportsbook bookmaker"
    " warez keygen keygens crackz serialz nulled viagra cialis levitra tramadol xanax phentermine".split()
)
#: Soft terms and their weights; SOFT_TERMS different ones of SOFT_WEIGHT together block.
SOFT = (
    dict.fromkeys("sex sexy nude nudes naked adult erotic erotik escort dating hookup singles poker slots roulette blackjack betting bets bet gambling lottery bingo".split(), 1.0)
    | dict.fromkeys("torrent torrents crack cracked serial serials cheats hacks proxy pills pharmacy drugs steroids payday loan loans forex clickbait replica".split(), 1.0)
    | dict.fromkeys("ads ad adserver banner popup popunder track tracker tracking affiliate sponsored promo redirect doorway spam".split(), 0.75)
    | dict.fromkeys("free cheap buy discount win bonus vip hot cash credit earn".split(), 0.5)
)
SOFT_TERMS, SOFT_WEIGHT = 2, 1.5

RESULT = [
    field("host", T.StringType()),
    field("path", T.StringType()),
    field("rule", T.StringType()),
    field("verdict", T.StringType()),
    field("n_strict", T.LongType()),
    field("n_soft", T.LongType()),
    field("soft_weight", T.DoubleType()),
]
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [len(rest) if (k := rest.find(c)) < 0 else k for c in "/?#"]
    host_end, path_end = min(ends), min(ends[1:])
    return rest[:host_end].translate(_LOWER), rest[host_end:path_end] if host_end < path_end else ""


def fitting_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    fit = []
    for verdict, rule in rules:
        rule_host, slash, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
            fit.append((len(rule), rule, verdict))
    return max(fit)[1:] if fit else None


def read_vocabulary(spark, path: str) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict terms, soft terms with weights) of a file of `term weight` lines; # starts a comment. A vocabulary is read whole: it has one line a term."""
    strict, soft = [], {}
    for (line,) in spark.read.text(path).toLocalIterator():
        words = line.split("#")[0].lower().split()
        if len(words) == 2 and words[1] == "strict":
            strict.append(words[0])
        elif words:
            soft[words[0]] = float(words[1]) if len(words) > 1 else 1.0
    return tuple(strict), soft


def automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in dict(soft).items():
        found.add_word(term, (weight, term))
    for term in strict:
        found.add_word(term, (None, term))
    found.make_automaton()
    return found


_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def count_terms(found: ahocorasick.Automaton, url: str) -> tuple[int, int, float]:
    """Different strict terms, different soft terms, and the soft ones' weight, that stand alone in the url."""
    text = url.translate(_LOWER)
    terms = {}
    for end, (weight, term) in found.iter(text):
        start = end + 1 - len(term)
        if (start == 0 or text[start - 1] not in _INSIDE) and (end + 1 == len(text) or text[end + 1] not in _INSIDE):
            terms[term] = weight
    soft = [w for w in terms.values() if w is not None]
    return len(terms) - len(soft), len(soft), round(sum(soft), 6)


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_terms: int = SOFT_TERMS, soft_weight: float = SOFT_WEIGHT) -> DataFrame:
    """pages with RESULT's columns."""

    def make():
        found = automaton(strict, soft)

        def work(batch: pa.RecordBatch) -> list:
            out = [[] for _ in RESULT]
            for url in batch.column(batch.schema.get_field_index(url_col)).to_pylist():
                host, path = split_url(url)
                rule = fitting_rule(host, path, rules)
                n_strict, n_soft, weight = count_terms(found, url or "")
                verdict = rule[1] if rule else "block" if n_strict or (n_soft >= soft_terms and weight >= soft_weight) else "allow"
                for column, value in zip(out, (host, path, rule and rule[0], verdict, n_strict, n_soft, weight), strict=True):
                    column.append(value)
            return out

        return work

    return with_columns(pages.withColumn(url_col, F.col(url_col).cast("string")), RESULT, make)
