"""URL filters: longest-rule verdicts, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrabrook.llm.common import LOWER, UPPER

# The rules of the query, as verdict and host with path.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

# What the labelled table is made of. Stems of hosts to block, by kind; stems of
# hosts to allow, by topic; suffixes and paths, which both classes share.
BLOCKED_STEMS = (
    "porn porno xxx sex sexcam nude erotic hentai escort milf fetish adult hookup camgirl "
    "casino poker betting roulette jackpot slots gamble bingo lottery sportbet blackjack "
    "viagra cialis pharma pills steroid painkiller weightloss testosterone "
    "warez crack keygen torrent serialkey nulled pirated "
    "malware phishing trojan ransom keylogger botnet hackedaccount loginverify accountverify "
    "spam linkfarm backlink bulkmail freemoney getrich payday cryptodouble "
    "adserver adclick popunder tracker trackpixel clickbait doubleads banneradvert affiliateads"
).split()
ALLOWED_STEMS = (
    "news zeitung journal gazette tribune presse noticias weather wetter climate forecast "
    "university college school academy campus library bibliothek museum archive gallery theatre opera "
    "science physics chemistry biology astronomy geology maths research institute laboratory "
    "hospital clinic health nurse dentist medicine pharmacy wellness nutrition yoga "
    "recipe cooking kitchen bakery restaurant cafe coffee wine cheese chocolate brewery "
    "garden flower forest farm animal bird horse dog fishing beekeeping "
    "travel hotel hostel reisen viajes voyage airline railway ferry camping hiking mountain beach "
    "football tennis cycling running swimming chess sailing hockey basketball athletics "
    "music piano guitar jazz choir orchestra radio podcast cinema film photo painting poetry books novel "
    "software docs manual wiki forum blog code compiler database server network linux python hardware robot "
    "bank insurance invoice tax accounting mortgage pension economy market trade business consulting "
    "city council government ministry parliament court police embassy passport statistics "
    "furniture carpenter plumber electric roofing bicycle car motor tyre garage shop store fashion shoes jewel toys "
    "church history heritage genealogy language dictionary translate essex sussex middlesex analysis title glass class"
).split()
SUFFIXES = "org net info edu io dev eu de fr es it nl pl se fi no dk at ch pt gr cz ro ie co.uk org.uk com.br com.au co.nz co.jp ca in mx ar za".split()
FRONTS = ["", "www.", "m.", "blog.", "shop.", "en."]
BESIDES = ["", "-online", "-world", "24", "best-", "my", "-club", "-x", "the-", "-hub", "-plus", "top-"]
PATHS = ["/", "/en/{n}", "/de/{n}.html", "/fr/{n}?page=2", "/es/{n}/", "/index.php?id={n}", "/article/{n}", "/2021/05/{n}", "/view/{n}#top", "/account/{n}", "/download/{n}.zip", "/play/{n}", "/watch/{n}", "/en/about", "/category/{n}/page/3"]
#: Consonants and vowels of invented names, which stand for hosts that no list knows.
SOUNDS = ["b c d f g h k l m n p r s t v w z th st br tr gr pl ch sh".split(), "a e i o u ai ea ou io er an in on en".split()]


def labelled_urls(blocked: int = 16, allowed: int = 6, invented: int = 900, seed: int = 19) -> list[tuple[str, int, str]]:
    """A small labelled table by rule: url, label (1 blocks) and stem, so many URLs for each stem and so many invented names."""
    rnd = random.Random(seed)

    def url(stem: str) -> str:
        beside = rnd.choice(BESIDES)
        name = beside + stem if beside and not beside.startswith("-") and not beside.isdigit() else stem + beside
        return f"{rnd.choice(['https', 'http'])}://{rnd.choice(FRONTS)}{name}.{rnd.choice(SUFFIXES)}{rnd.choice(PATHS).format(n=rnd.randint(1, 9999))}"

    def name() -> str:
        return "".join(rnd.choice(SOUNDS[i % 2]) for i in range(rnd.randint(2, 7)))

    rows = [(url(s), 1, s) for s in BLOCKED_STEMS for _ in range(blocked)] + [(url(s), 0, s) for s in ALLOWED_STEMS for _ in range(allowed)]
    rows += [(url(s), 0, s) for s in (name() for _ in range(invented))]
    return rows


def parts_of(url: str | None) -> tuple[str, str]:
    """Host, lower-cased in A-Z, and path of a URL; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([i for c in "?#" if (i := rest.find(c)) >= 0], default=len(rest))
    return host.translate(str.maketrans(UPPER, LOWER)), rest[:stop]


def host_path(url: Column) -> tuple[Column, Column]:
    """The same as columns."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.char_length(raw) + 1, F.lit(2**31 - 1)), r"\A[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(texts: list[bytes], salt: int, sizes: tuple[int, ...], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams of texts with marked ends, from flat arrays, repeats included."""
    flat = np.frombuffer(b"".join(b"<" + t + b">" for t in texts), np.uint8).astype(np.uint64)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # characters from here to the text's end
    rows, found = [], []
    h = np.full(len(flat), salt, np.uint64)
    for n in range(1, max(sizes) + 1):
        ok = len(flat) - n + 1
        if ok <= 0:
            break
        h = (h[:ok] ^ flat[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in sizes:
            at = np.flatnonzero(left[:ok] >= n)
            rows.append(row[at])
            found.append((h[at] % np.uint64(dims)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class UrlModel:
    """Logistic regression on hashed character n-grams of host and path: Adam steps with L2, in numpy."""

    def __init__(self, sizes: tuple[int, ...] = (3, 4, 5), dims: int = 1 << 16):
        self.sizes, self.dims = sizes, dims
        self.weight, self.bias = np.zeros(dims), 0.0

    def features(self, hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature), each feature once a row, in order of row."""
        utf8 = lambda texts: [t.encode("utf-8", "replace") for t in texts]
        a, b = grams(utf8(hosts), 1, self.sizes, self.dims), grams(utf8(paths), 2, self.sizes, self.dims)
        key = np.unique(np.r_[a[0], b[0]] * self.dims + np.r_[a[1], b[1]])
        return key // self.dims, key % self.dims

    def fit(self, rows: list[tuple[str, int]], steps: int = 200, rate: float = 0.05, l2: float = 1e-5) -> UrlModel:
        """Both classes weigh the same, whatever their numbers of rows."""
        if not rows:
            return self
        who, flat = self.features(*zip(*(parts_of(r[0]) for r in rows), strict=True))
        y = np.array([r[1] for r in rows], float)
        share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        scale = 1 / np.sqrt(np.maximum(np.bincount(who, minlength=len(y)), 1))
        first, second = np.zeros(self.dims + 1), np.zeros(self.dims + 1)
        for t in range(1, steps + 1):
            z = np.bincount(who, self.weight[flat], len(y)) * scale + self.bias
            d = (1 / (1 + np.exp(-z)) - y) * share
            grad = np.append(np.bincount(flat, (d * scale)[who], self.dims) + l2 * self.weight, d.sum())
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            self.weight -= step[:-1]
            self.bias -= step[-1]
        return self

    def calibrate(self, rows: list[tuple[str, int, str]], folds: int = 5, allowed: float = 0.99) -> UrlModel:
        """Shift the bias so that this share of allowed URLs with stems left out of training score below 0.5."""
        margins = []
        for k in range(folds):
            away = [zlib.crc32(r[2].encode()) % folds == k for r in rows]
            part = UrlModel(self.sizes, self.dims).fit([r for r, out in zip(rows, away, strict=True) if not out])
            held = [r for r, out in zip(rows, away, strict=True) if out and not r[1]]
            if held:
                margins.append(part.margin(*zip(*(parts_of(r[0]) for r in held), strict=True)))
        if margins:
            self.bias -= max(0.0, float(np.quantile(np.concatenate(margins), allowed))) + 1e-6
        return self

    def margin(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        who, flat = self.features(hosts, paths)
        return np.bincount(who, self.weight[flat], len(hosts)) / np.sqrt(np.maximum(np.bincount(who, minlength=len(hosts)), 1)) + self.bias

    def score(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-self.margin([host], [path])[0])))


@functools.cache
def default_model() -> UrlModel:
    rows = labelled_urls()
    return UrlModel().fit(rows).calibrate(rows)


def runs_of(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of rows that hold at most this many characters, or one row."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: UrlModel | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; without one the model does, blocking at
    a score of 0.5 or more; where a rule decides the score is null, for such
    rows never reach the model. By default the model is fitted on the driver to
    the small table of labelled_urls. A null url or one without ``://`` has
    empty host and path, which the model scores like any other; very long urls
    are scored whole, in slices of bounded size. Rows repeat as in pages, an
    empty table gives an empty result, and other columns are not read.
    """
    model = model or default_model()
    address = F.coalesce(pages[url], F.lit(""))
    host, path = host_path(address)
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in batches:
            out = np.full(len(h), np.nan)
            at = np.flatnonzero(h.notna().to_numpy())
            hosts, paths = h.iloc[at].tolist(), p.iloc[at].tolist()
            for s in runs_of([len(a) + len(b) for a, b in zip(hosts, paths, strict=True)]):
                out[at[s]] = 1 / (1 + np.exp(-model.margin(hosts[s], paths[s])))
            yield pd.Series(out).where(h.notna().reset_index(drop=True))

    judged = rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    open_host = F.when(F.col("hit").isNull(), F.col("host"))
    judged = judged.withColumn("score", score(open_host, F.when(F.col("hit").isNull(), F.col("path"))))
    judged = judged.withColumn("score", F.when(F.col("hit").isNull(), F.col("score")))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
