"""URL filter: a weighted vocabulary found with Aho-Corasick, under rules for hosts and paths.

URLs are searched A-Z lower-cased and with percent escapes of ASCII characters decoded.  A term counts where it stands
between characters that are no ASCII letters or digits, in its listed form or its regular plural.  Strict terms weigh
enough alone: one rejects a URL.  Soft terms reject it when several different ones stand in it; a term and its plural are
one.  Rules come first: of the rules that fit, the longest decides.
"""

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Vocabulary (fixed values): terms that reject alone, and terms that reject together, by their weight.
STRICT = (
    "adultfriendfinder", "backpage", "bestiality", "blowjob", "brazzers", "camgirl", "camwhore", "casino", "chaturbate",
    "creampie", "cumshot", "deepthroat", "erotica", "escort", "fetlife", "gambling", "gangbang", "gloryhole", "handjob",
    "hardcore-sex", "hentai", "incest", "keygen", "link-farm", "livejasmin", "malware", "masturbation", "milf", "onlyfans",
    "phishing", "porn", "porno", "pornhub", "pornstar", "pornography", "ransomware", "redtube", "rule34", "sexcam", "sexchat",
    "sextoy", "slot-machine", "sportsbet", "spam-farm", "spankbang", "stripclub", "swinger", "threesome", "trojan-horse",
    "upskirt", "viagra", "cialis", "levitra", "warez", "webcam-girl", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
SOFT = {
    "adult": 1.0, "affiliate": 0.5, "babe": 1.0, "baccarat": 1.0, "betting": 1.0, "bet": 1.0, "bikini": 1.0, "blackjack": 1.0,
    "bonus": 0.5, "bookmaker": 1.0, "bride": 0.5, "cam": 0.5, "cash": 0.5, "cheap": 0.5, "cheat": 0.5, "clickbait": 0.5,
    "coupon": 0.5, "crack": 1.0, "cracked": 1.0, "credit": 0.5, "dating": 1.0, "debt": 0.5, "diet": 0.5, "discount": 0.5,
    "drug": 0.5, "erotic": 1.0, "exploit": 0.5, "farm": 0.5, "fetish": 1.0, "forex": 0.5, "free": 0.5, "giveaway": 0.5,
    "hack": 0.5, "hacked": 0.5, "hookup": 1.0, "hot": 0.5, "jackpot": 1.0, "kinky": 1.0, "leaked": 0.5, "lingerie": 1.0,
    "loan": 1.0, "lolita": 1.0, "lottery": 1.0, "lotto": 1.0, "mature": 0.5, "mortgage": 0.5, "naked": 1.0, "nsfw": 1.0,
    "nude": 1.0, "offer": 0.5, "payday": 1.0, "pharmacy": 1.0, "pill": 1.0, "pirate": 0.5, "pirated": 1.0, "playboy": 1.0,
    "poker": 1.0, "prescription": 0.5, "promo": 0.5, "prize": 0.5, "proxy": 0.5, "rapidshare": 0.5, "replica": 1.0, "rolex": 1.0,
    "roulette": 1.0, "scam": 0.5, "seduce": 1.0, "serial": 0.5, "sex": 1.0, "sexy": 1.0, "slot": 1.0, "spam": 1.0,
    "steroid": 1.0, "stripper": 1.0, "supplement": 0.5, "sweepstake": 1.0, "teen": 0.5, "topless": 1.0, "torrent": 0.5,
    "tramadol": 1.0, "unblocked": 0.5, "virus": 0.5, "voyeur": 1.0, "wager": 1.0, "webcam": 1.0, "weightloss": 0.5, "win": 0.5,
    "winner": 0.5, "xanax": 1.0,
}


def forms(term: str) -> tuple[str, ...]:
    """A term and its regular plural."""
    if not term[-1].isalpha() or term.endswith("s") and not term.endswith("ss"):
        return (term, f"{term}es") if term.endswith("us") else (term,)
    if term.endswith("y") and term[-2] not in "aeiou":
        return term, f"{term[:-1]}ies"
    return term, f"{term}es" if term.endswith(("s", "x", "z", "ch", "sh")) else f"{term}s"


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = tuple(SOFT.items())
    soft_terms: int = 2

    @property
    def listed(self) -> dict[str, tuple[str, float | None]]:
        """Every form, with its term and the term's weight; none for strict terms, which win."""
        soft = {f: (t, w) for t, w in self.soft for f in forms(t)}
        return soft | {f: (t, None) for t in self.strict for f in forms(t)}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def _folded(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(_folded(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule for the host or a domain above it whose path starts the URL's; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


_BOUND = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _automaton(vocabulary: Vocabulary):
    import ahocorasick

    a = ahocorasick.Automaton()
    for form, (term, weight) in vocabulary.listed.items():
        a.add_word(form, (len(form), term, weight))
    a.make_automaton()
    return a


_ESCAPE = re.compile("%([2-7][0-9a-fA-F])")


def searched(url: str | None) -> str:
    """The text that is searched: escapes of ASCII characters decoded once, A-Z lower-cased."""
    text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url) if url and "%" in url else url or ""
    return text.translate({ord(u): l for u, l in zip(_UPPER, _LOWER)})


def term_hits(url: str | None, automaton) -> tuple[int, int, float]:
    """Number of strict terms, of different soft terms, and the sum of the latter's weights."""
    strict, soft = set(), {}
    text = searched(url)
    for last, (size, term, weight) in automaton.iter(text):
        first = last - size + 1
        if (first and text[first - 1] in _BOUND) or (last + 1 < len(text) and text[last + 1] in _BOUND):
            continue
        if weight is None:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), len(soft), float(sum(soft[t] for t in sorted(soft)))


def _counted(vocabulary: Vocabulary):
    @F.pandas_udf("strict int, soft int, weight double")
    def count(urls: pd.Series) -> pd.DataFrame:
        a = _automaton(vocabulary)
        return pd.DataFrame([term_hits(u, a) for u in urls], columns=["strict", "soft", "weight"]).astype(
            {"strict": "int32", "soft": "int32", "weight": "float64"})
    return count


def judge(pages: DataFrame, rules: list[Rule] = (), vocabulary: Vocabulary = Vocabulary(), id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``(<id>, host, path, rule, verdict, strict_terms, soft_terms, soft_weight)`` for every row.

    The whole URL is searched.  Null URLs and URLs without ``://`` have an empty host and path; their terms still
    count (a null has none and is allowed unless a rule says otherwise, which none can).  Repeated rows repeat; an empty
    table gives an empty result.
    """
    df = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"))
    df = df.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url")),
                         "_hits": _counted(vocabulary)("_url")})
    rejected = (F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= vocabulary.soft_terms)
    host, path = F.col("host"), F.col("path")
    return df.select(
        F.col("_id").alias(id_col), "host", "path", fitting_rule(host, path, rules, lambda r: r.name).alias("rule"),
        F.coalesce(fitting_rule(host, path, rules, lambda r: r.verdict),
                   F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        F.col("_hits.strict").alias("strict_terms"), F.col("_hits.soft").alias("soft_terms"),
        F.col("_hits.weight").alias("soft_weight"))


def without_blocked(pages: DataFrame, rules: list[Rule] = (), vocabulary: Vocabulary = Vocabulary(),
                    url_col: str = "url") -> DataFrame:
    """The rows, with all their columns, whose URL is allowed.

    Null URLs and URLs without ``://`` are judged by their terms alone; repeated rows are judged alike.  An empty table
    gives an empty result.
    """
    hits = _counted(vocabulary)(pages[url_col])
    rejected = (hits["strict"] > 0) | (hits["soft"] >= vocabulary.soft_terms)
    verdict = F.coalesce(fitting_rule(host_of(pages[url_col]), path_of(pages[url_col]), rules, lambda r: r.verdict),
                         F.when(rejected, "block").otherwise("allow"))
    return pages.where(verdict == "allow")


def judge_sql(rules: list[Rule], vocabulary: Vocabulary = Vocabulary(), table: str = "pages") -> str:
    """The result of :func:`judge` in SQL: one pattern per term in place of the automaton."""
    def fold(x):
        return f"translate({x}, '{_UPPER}', '{_LOWER}')"

    def stands(term):
        found = "|".join(f.replace(".", "[.]") for f in forms(term) if vocabulary.listed[f][0] == term)
        return f"regexp_matches(u, '(^|[^a-z0-9])({found})([^a-z0-9]|$)')::int"

    def rule(value):
        whens = "\n".join(
            f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{value(r)}'"
            for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True))
        return f"case {whens} end"

    soft = [(t, w) for t, w in vocabulary.soft if vocabulary.listed[t][1] is not None]
    return f"""
with parts as (select page_id, {fold("coalesce(url_decode(url), '')")} as u,
    coalesce({fold("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from {table}),
hits as (select *, {" + ".join(map(stands, vocabulary.strict))} as strict_terms,
    {" + ".join(stands(t) for t, _ in soft)} as soft_terms,
    {" + ".join(f"{w!r}::double * {stands(t)}" for t, w in soft)} as soft_weight from parts)
select page_id, host, path, {rule(lambda r: r.name)} as rule,
  coalesce({rule(lambda r: r.verdict)}, case when strict_terms > 0 or soft_terms >= {vocabulary.soft_terms}
    then 'block' else 'allow' end) as verdict,
  strict_terms, soft_terms, soft_weight from hits"""
