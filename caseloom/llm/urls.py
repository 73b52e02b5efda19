"""URL filter: host and path rules, and a weighted vocabulary found with an Aho-Corasick automaton."""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from caseloom.llm.base import add_columns, as_bytes

# What a rule list says. (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# One strict term rejects a url; of the soft terms it takes several different ones.
STRICT = ("casino", "porn", "xxx", "spam", "viagra", "escort", "pills", "bets", "adult")
SOFT = ("cheap", "free", "win", "bonus", "track", "ads", "deal", "deals", "click", "promo", "farm", "offer", "prize")
SOFT_HITS = 2


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host, A-Z lower-cased, and path; both empty for null and for urls without ``://``."""
    at = url.find(b"://") if url else -1
    if at < 0:
        return b"", b""
    rest = url[at + 3 :]
    ends = [i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find(b"/")
    host, path = (rest, b"") if slash < 0 else (rest[:slash], rest[slash:])
    return host.lower(), path


class Rules:
    """The longest rule whose host is the url's host or a parent of it and whose path begins the url's path."""

    def __init__(self, rules):
        self.by_host: dict[bytes, list[tuple[bytes, str, str]]] = {}
        for verdict, text in rules:
            host, slash, path = text.encode().partition(b"/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, text, verdict))

    def find(self, host: bytes, path: bytes) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        while host:
            for start, text, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or len(text) > best[0]):
                    best = (len(text), text, verdict)
            host = host.partition(b".")[2]
        return best[1:] if best else (None, None)


class Vocabulary:
    def __init__(self, strict, soft, soft_hits: int):
        self.soft_hits = soft_hits
        self.machine = ahocorasick.Automaton()
        for weight, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.machine.add_word(term.lower(), (term.lower(), weight))
        self.machine.make_automaton()

    def count(self, url: str) -> tuple[int, int]:
        """Distinct strict and soft terms that stand between characters that are not letters or digits."""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url)
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        for last, (term, weight) in self.machine.iter(low):
            first = last - len(term) + 1
            if (first == 0 or not low[first - 1].isalnum()) and (last + 1 == len(low) or not low[last + 1].isalnum()):
                found[weight].add(term)
        return len(found["strict"]), len(found["soft"])


def filter_urls(
    df: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = SOFT_HITS, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with host, path, rule, verdict, n_strict and n_soft.

    A fitting rule decides; else one strict term or ``soft_hits`` different soft terms block, and the rest is allowed.
    Null, empty and malformed urls have empty host and path, no terms unless their text holds them, and are judged like
    others. Columns of these names are replaced; rows are independent and nothing is shuffled. Rules and terms are
    parameters, a list that an editor keeps, and go to the tasks with the code.
    """

    def make():
        by_rule, vocabulary = Rules(rules), Vocabulary(strict, soft, soft_hits)

        def compute(urls):
            rows = []
            for value in urls:
                data = value.as_py()
                host, path = split_url(data)
                rule, verdict = by_rule.find(host, path)
                n_strict, n_soft = vocabulary.count(data.decode("utf-8", "replace")) if data else (0, 0)
                if verdict is None:
                    verdict = "block" if n_strict or n_soft >= soft_hits else "allow"
                rows.append((host.decode("utf-8", "replace"), path.decode("utf-8", "replace"), rule, verdict, n_strict, n_soft))
            return [*zip(*rows, strict=True)] if rows else [[]] * 6

        return compute

    ddl = "host string, path string, rule string, verdict string, n_strict long, n_soft long"
    return add_columns(df, [as_bytes(url)], ddl, make, keep)
