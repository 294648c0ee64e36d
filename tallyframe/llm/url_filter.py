"""URL filters: rules by host and path, and a weighted vocabulary where no rule speaks.

One Aho-Corasick automaton per Python process finds all vocabulary terms of a URL in one pass. A
match counts only between boundaries (no ASCII letter or digit on either side). One strict term
rejects; soft terms reject when the weights of the distinct ones found reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.grouped import others, packed

# The default vocabulary.
STRICT_TERMS = (
    "porn", "porno", "pornography", "xxx", "hentai", "milf", "camgirl", "camgirls", "escort-service",
    "sex-video", "sex-videos", "warez", "keygen", "torrent-crack", "viagra", "cialis",
)
SOFT_TERMS = {
    "adult": 1.0, "sex": 1.0, "sexy": 1.0, "nude": 1.0, "nudes": 1.0, "erotic": 1.0, "escort": 1.0,
    "fetish": 1.0, "casino": 1.0, "poker": 1.0, "slots": 1.0, "betting": 1.0, "jackpot": 1.0,
    "payday": 1.0, "loan": 0.5, "loans": 0.5, "pills": 1.0, "pharmacy": 0.5, "crack": 0.5,
    "torrent": 1.0, "download": 0.5, "free": 0.5, "cheap": 0.5, "replica": 1.0,
}


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with all its subdomains, and paths from ``path`` on."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Vocabulary:
    """Lower-case terms. ``limit``: summed weight of distinct soft terms that rejects."""

    strict: Sequence[str] = STRICT_TERMS
    soft: Mapping[str, float] = field(default_factory=lambda: dict(SOFT_TERMS))
    limit: float = 2.0


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(
    pages: DataFrame, rules: Sequence[Rule], vocabulary: Vocabulary = Vocabulary(), url_col: str = "url"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``strict_hits``, ``soft_hits``;
    columns of these names are replaced.

    The rule with the longest host and path that fits decides; ties go to the longer host. Without one, the vocabulary does. A null URL or one without ``://`` has an empty host and
    path, which no rule fits; its text, if any, is still searched for terms. A null is allowed.
    """
    outputs = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    carried = others(pages, *outputs)
    url = F.col(url_col).cast("string").alias("url")
    rows = pages.select(packed(carried), url)
    rows = rows.select("row", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        own = (F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")
        fits = own & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    found = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), _terms(vocabulary)(F.col("url")).alias("found"))
    heavy = F.col("found.weight") >= vocabulary.limit
    by_terms = F.when((F.size("found.strict") > 0) | heavy, "block").otherwise("allow")
    return found.select(
        *[F.col("row")[c].alias(c) for c in carried],
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_terms).alias("verdict"),
        F.col("found.strict").alias("strict_hits"),
        F.col("found.soft").alias("soft_hits"),
    )


def _terms(vocabulary: Vocabulary):
    """An Arrow UDF: the distinct strict and soft terms of a URL, sorted, and the soft weight."""
    strict, soft = set(vocabulary.strict), dict(vocabulary.soft)

    def search(automaton, url: str | None) -> dict:
        hard, light = set(), set()
        if url:
            text = url.lower()
            for end, term in automaton.iter(text):
                start = end - len(term) + 1
                if not (_joins(text, start - 1) or _joins(text, end + 1)):
                    (hard if term in strict else light).add(term)
        return {"strict": sorted(hard), "soft": sorted(light), "weight": sum(soft[t] for t in sorted(light))}

    kind = pa.struct([("strict", pa.list_(pa.string())), ("soft", pa.list_(pa.string())), ("weight", pa.float64())])

    @F.arrow_udf("strict array<string>, soft array<string>, weight double")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in strict | set(soft):
            automaton.add_word(term, term)
        if len(automaton):
            automaton.make_automaton()
        for urls in batches:
            found = [search(automaton, u if len(automaton) else None) for u in urls.to_pylist()]
            yield pa.array(found, kind)

    return terms


def _joins(text: str, place: int) -> bool:
    return 0 <= place < len(text) and text[place].isascii() and text[place].isalnum()
