"""Secret scan: fixed patterns, and a randomness test battery for what no pattern knows.

The battery takes every run of 20 or more characters of the usual encodings. It infers the narrowest encoding (hex,
base32, base36, base62, base64 or its URL form) and makes three tests of it:

- chi-squared uniformity: are the symbols drawn evenly from the alphabet;
- runs: does the run change as often as even draws do (halves of the alphabet, classes of characters);
- serial correlation: are neighbours independent.

Each test is made from both sides. Against even draws it has a p-value, and a run that one of the three refutes
(Bonferroni over the three) is no secret. Against ordinary text (words, capitals, numbers) it has a likelihood ratio,
of symbols, of class changes and of neighbours: how much better even draws explain what the test looks at. Under
ordinary text such a ratio is 1 on average, and so is the mean of the three however they depend on each other; so its
inverse is a p-value (Markov's bound). It falls exponentially with length by itself, and Benjamini-Hochberg over all
runs of a document keeps the expected share of ordinary runs among the reported ones below `FDR`.

Scanning runs in the task that reads the text, without a shuffle, over the whole text. Null and empty texts have no
spans. Repeated rows are scanned each for itself. Columns besides the text pass
through, but for one named as the result.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.texts import python_tasks

KINDS = ("assign", "access", "hex", "random")
#: What is looked for. A match that is too short is dropped, but its characters are used up.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"), ("hex", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER),
    ("base36", DIGITS + UPPER), ("base62", DIGITS + UPPER + LOWER), ("base64", DIGITS + UPPER + LOWER + "+/"),
    ("base64url", DIGITS + UPPER + LOWER + "-_"),
)

_PLACES = [(name, {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS]

MIN_RUN = 20
REFUTED = 0.01
FDR = 0.01
#: How often neighbours change class in names and other ordinary text, and how often two are a plain pair.
CHANGE_RATE, PLAIN_RATE = 0.15, 0.5
#: Letters in a thousand of text, rounded over some European languages, and their frequent pairs: fixed values.
LETTERS = dict(zip(LOWER, (
    85, 15, 32, 45, 145, 14, 18, 30, 75, 3, 6, 45, 26, 80, 66, 25, 6, 66, 68, 72, 38, 12, 9, 3, 9, 7)))
PAIRS = frozenset(
    "al an ar as at au ch ci co de di du ea ec ed ei el em en er es et ge ha he hi ic ie il in io is it la le li ll lo "
    "ma me mi na nd ne ng ns nt om on or os ou ra re ri ro se si so st ta te th ti to tr ue un ur us ve".split())
#: Kinds of ordinary runs: shares of small letters, capitals, digits and signs.
ORDINARY = ((0.80, 0.10, 0.05, 0.05), (0.05, 0.80, 0.05, 0.10), (0.10, 0.10, 0.60, 0.20))
SIGNS = "+/-_"

Span = tuple[int, int, str]


def chi_squared_tail(x: float, freedom: int) -> float:
    """Upper tail by the cube-root approximation."""
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(2 * spread))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(places: list[int], size: int) -> float:
    """Chi-squared over parts of the alphabet, as many as leave five symbols each, eight at most."""
    n, parts = len(places), max(2, min(8, len(places) // 5))
    seen, share = [0] * parts, [0] * parts
    for p in range(size):
        share[p * parts // size] += 1
    for p in places:
        seen[p * parts // size] += 1
    return chi_squared_tail(sum((o - n * s / size) ** 2 / (n * s / size) for o, s in zip(seen, share)), parts - 1)


def runs(places: list[int], size: int) -> float:
    """Runs of symbols in the upper and lower half of the alphabet, given how many are in each."""
    upper = [2 * p >= size for p in places]
    n, a = len(upper), sum(upper)
    b = n - a
    if not a or not b:
        return 0.0
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    found = 1 + sum(x != y for x, y in zip(upper, upper[1:]))
    return two_sided((found - mean) / math.sqrt(variance)) if variance > 0 else 0.0


def serial_correlation(places: list[int]) -> float:
    n = len(places)
    mean = sum(places) / n
    away = [p - mean for p in places]
    total = sum(x * x for x in away)
    if not total:
        return 0.0
    return two_sided((sum(x * y for x, y in zip(away, away[1:])) / total + 1 / n) * math.sqrt(n))


def infer(run: str) -> tuple[str, list[int], str] | None:
    """The narrowest encoding, the symbols' places in its alphabet, and the alphabet."""
    used = set(run)
    for name, places in _PLACES:
        if used <= places.keys():
            return name, [places[c] for c in run], "".join(places)
    return None


def randomness(run: str) -> float:
    """The battery's p-value under even, independent draws; 0 for what no encoding explains."""
    known = infer(run)
    if known is None:
        return 0.0
    _, places, size = known[0], known[1], len(known[2])
    return min(1.0, 3 * min(uniformity(places, size), runs(places, size), serial_correlation(places)))


def _kind(c: str) -> int:
    return 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3


def changes(a: str, b: str) -> bool:
    """Whether neighbours are of different classes; Aa counts as no change."""
    return _kind(a) != _kind(b) and (_kind(a), _kind(b)) != (1, 0)


def plain(a: str, b: str) -> bool:
    """Whether neighbours are usual in ordinary text: a frequent pair of letters, two digits, or next to a sign."""
    return a in SIGNS or b in SIGNS or (a in DIGITS and b in DIGITS) or (a + b).lower() in PAIRS


def _symbol_shares() -> list[dict[str, float]]:
    total = sum(LETTERS.values())
    return [
        {c: small * LETTERS[c] / total for c in LOWER} | {c: large * LETTERS[c.lower()] / total for c in UPPER}
        | dict.fromkeys(DIGITS, digit / len(DIGITS)) | dict.fromkeys(SIGNS, sign / len(SIGNS))
        for small, large, digit, sign in ORDINARY]


_LOG_SHARES = [{c: math.log(share) for c, share in shares.items()} for shares in _symbol_shares()]
#: Of each encoding, how often even draws change class and make a plain pair.
_EVEN = {name + alphabet[0] + alphabet[-1]: tuple(
    sum(f(a, b) for a in alphabet for b in alphabet) / len(alphabet) ** 2 for f in (changes, plain))
    for name, alphabet in ENCODINGS}


def log_mean(logs: list[float]) -> float:
    """The logarithm of the mean of numbers given by their logarithms."""
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs) / len(logs))


def _rates(even: float, usual: float, hits: int, n: int) -> float:
    """Log-likelihood ratio of `hits` of `n` under two rates."""
    return hits * math.log(even / usual) + (n - hits) * math.log((1 - even) / (1 - usual))


def evidence(run: str) -> tuple[float, float, float]:
    """Logarithms of how much better even draws explain the run than ordinary text: symbols, class changes, neighbours."""
    name, _, alphabet = infer(run)
    n = len(run)
    symbols = -n * math.log(len(alphabet)) - log_mean([sum(map(shares.__getitem__, run)) for shares in _LOG_SHARES])
    even = _EVEN[name + alphabet[0] + alphabet[-1]]
    neighbours = list(zip(run, run[1:]))
    return (symbols, *(
        _rates(rate, usual, sum(f(a, b) for a, b in neighbours), n - 1)
        for f, rate, usual in zip((changes, plain), even, (CHANGE_RATE, PLAIN_RATE))))


def ordinary(run: str) -> float:
    """The battery's p-value under ordinary text; 1 for what no encoding explains."""
    return 1.0 if infer(run) is None else math.exp(min(0.0, -log_mean([*evidence(run)])))


def discoveries(chances: list[float], rate: float = FDR) -> set[int]:
    """Benjamini-Hochberg: which of the chances are small enough together."""
    order = sorted(range(len(chances)), key=chances.__getitem__)
    last = max((k for k, i in enumerate(order, 1) if chances[i] <= rate * k / len(order)), default=0)
    return set(order[:last])


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    small = text.lower()
    if any(h in small for h in ASSIGN_HINTS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans


def scan(text: str | None) -> list[Span]:
    """All spans of a text in order of start, then of KINDS."""
    if not text:
        return []
    spans = base_spans(text)
    # No longer pattern can match where no word is long enough.
    if max(map(len, text.split()), default=0) >= MIN_RUN:
        spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
        candidates = []
        for m in RUN.finditer(text):
            a, b = m.span()
            if not any(s <= a and b <= e for s, e, _ in spans):
                candidates.append((a, b, m[0]))
        reported = discoveries([ordinary(run) for _, _, run in candidates])
        spans += [(a, b, "random") for i, (a, b, run) in enumerate(candidates)
                  if i in reported and randomness(run) >= REFUTED]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """`docs` with an array of structs kind, start, end (code points, end exclusive), in order."""
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{k}:{a}:{b}" for a, b, k in scan(t)] for t in texts], dtype=object)

    def parse(span):
        part = F.split(span, ":")
        return F.struct(part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))

    python_tasks(docs)
    return docs.withColumn(into, F.transform(found(text), parse))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of spans of some kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
