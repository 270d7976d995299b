"""URL filter: block and allow rules, and a logistic regression for the rest.

The regression's features are character n-grams of host and path, hashed into ``WIDTH``
places; it is trained on the driver from a small labelled table of urls (at most
``MOST_ROWS`` rows).

The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z in lower
case; the path goes on from there up to "?", "#" or the end. A rule ("net/de/") fits its
host and all subdomains if the path starts with the rule's path; the longest rule that
fits decides, a blocking one among equals.

Edge cases: a null url or one without "://" has empty host and path, fits no rule, and is
judged by the regression's bias; equal rows get equal verdicts; an empty training table
lets everything pass; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .numeric import minimize, sigmoid

WIDTH = 1 << 16
NGRAMS = (3, 4, 5)
#: A url is blocked from this probability on.
THRESHOLD = 0.5
MOST_ROWS = 10_000
#: (verdict, rule)
RULES = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)

# Topics of unwanted and of harmless sites, and words that stand beside either.
_BAD = "casino poker slots betting bets gambling roulette porn xxx adult erotic escort viagra pills meds pharmacy warez torrent crack keygen malware phishing payday replica jackpot spam".split()
_GOOD = (
    "wiki news docs blog university library science school museum weather recipes health research journal archive forum travel sports music garden "
    "github code data maps photo books city bank hotel farm shop store kitchen history church theater software engineering football chess"
).split()
_BESIDE = "online club zone best top deal hub live box now world shop farm free my the win go 24 net pro".split()
_FORMS = ("{w}", "{w}{a}", "{a}{w}", "{w}-{a}", "{a}-{w}")
_SUB, _TLD = ("", "www.", "m.", "blog.", "static."), ("com", "net", "org", "example.com", "example.org", "example.net")
_PATHS = ("", "/", "/index.html", "/en/{n}", "/de/{n}.html", "/a/b", "/page/{n}/", "/files/{n}-guide")


def training_table(seed: int = 5) -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block), made by rule.

    Both kinds of sites have the same forms, neighbours, domains and paths, so that only the topic tells them apart;
    names of syllables or letters, of no topic, are harmless.
    """
    rng = random.Random(seed)

    def url(name: str) -> str:
        path = rng.choice(_PATHS).format(n=rng.randrange(1000))
        return f"http{rng.choice(['', 's'])}://{rng.choice(_SUB)}{name}.{rng.choice(_TLD)}{path}"

    out = []
    for label, topics in ((1, _BAD), (0, _GOOD)):
        for w in topics:
            for form in _FORMS:
                out += [(url(form.format(w=w, a=a)), label) for a in rng.sample(_BESIDE, 5 if "{a}" in form else 2)]
    syllables = [c + v + e for c in "bcdfghklmnprstvwz" for v in "aeiou" for e in ("", "n", "r", "s", "t")] + "th the ing ou er ti".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for i in range(900):
        if i % 3:
            name = rng.choice(["", "-"]).join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))
        else:
            name = "".join(rng.choices(letters, k=rng.randrange(2, 10)))
        out.append((url(name), 0))
    return [(u, label) for u, label in out if label or not any(w in u for w in _BAD)]


_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def parts(url: str | None) -> tuple[str, str]:
    """(host, path)"""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = _HOST.match(rest)[0]
    return host.translate(_UPPER), _PATH.match(rest[len(host) :])[0]


def places(host: str, path: str) -> set[int]:
    """Numbers of the hashed n-grams."""
    out = set()
    for kind, s in (("h", f"^{host}$"), ("p", f"{path}$")):
        for n in NGRAMS:
            out.update(zlib.crc32((kind + s[i : i + n]).encode()) % WIDTH for i in range(len(s) - n + 1))
    return out


def train(rows: list[tuple[str, int]], l2: float = 0.03) -> np.ndarray | None:
    """Weights of the n-grams, then the bias, which isn't shrunk."""
    if len(rows) > MOST_ROWS:
        raise ValueError(f"the labelled table has {len(rows)} rows; at most {MOST_ROWS} are read on the driver")
    if not rows:
        return None
    grams = [sorted(places(*parts(url))) for url, _ in rows]
    at = np.concatenate([np.array(g, np.int64) for g in grams])
    row = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    y = np.array([label for _, label in rows], float)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, w[at], len(rows)) + w[WIDTH]
        miss = sigmoid(z) - y
        grad = np.append(np.bincount(at, miss[row], WIDTH) + l2 * w[:WIDTH], miss.sum())
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * l2 * (w[:WIDTH] ** 2).sum()), grad

    return minimize(loss, np.zeros(WIDTH + 1))


def probability(host: str, path: str, weights: np.ndarray | None) -> float:
    if weights is None:
        return 0.0
    return float(sigmoid(weights[list(places(host, path))].sum() + weights[WIDTH]))


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The (verdict, rule) that decides, if any."""
    fits = []
    for verdict, rule in rules:
        rule_host, slash, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fits.append((len(rule), verdict == "block", verdict, rule))
    return max(fits)[2:] if fits else None


def judge(pages: DataFrame, rows: list[tuple[str, int]] | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability) of every row of pages (page_id, url)."""
    weights = train(training_table() if rows is None else rows)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u in b.column(1):
                host, path = parts(u.as_py())
                fit = rule_for(host, path, rules)
                p = probability(host, path, weights)
                out.append((host, path, fit and fit[1], fit[0] if fit else ("block" if p >= THRESHOLD else "allow"), p))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.string()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["page_id", "host", "path", "rule", "verdict", "probability"],
            )

    return pages.select("page_id", "url").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, probability double"
    )
