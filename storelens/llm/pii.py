"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Spans. Base spans (email, ip, card, phone) follow four fixed patterns with
   their checks and always stay. Candidates are what else looks like one: base
   matches that failed their check, the parts of number runs that swallowed
   their neighbours, obfuscated and non-ASCII addresses, IPv6, national phone
   numbers, shorter card numbers.
2. Labelers of three sorts vote yes, no or nothing on every span: regex
   (format, check, edges), gazetteer (issuers, calling codes, domains) and
   context (words before it in four languages, numbers beside it).
3. Expectation-maximisation, per kind, on the counts of all vote patterns of the
   whole corpus: how often each labeler says yes on true and on false spans, and
   every pattern's probability. Base spans are known to be true.
4. Those probabilities are the soft labels of a logistic classifier per kind, on
   the votes, the span's shape and hashed words beside it. It is fitted on at
   most SAMPLE_SPANS spans, picked by hash. Candidates that it accepts are added
   where they overlap no base span, from left to right.

Scale: one pass over the texts writes the spans of every document (no texts) to
the shared folder; votes are grouped counts (at most 3^6 patterns a kind), and a
second pass over the spans gives the result. Nothing is shuffled but counts.
"""

from __future__ import annotations

import ipaddress
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storelens.llm.common import text_or_empty
from storelens.session import cut_lineage

#: The kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("format", "check", "edges", "gazetteer", "context", "neighbours")
#: Spans, at most, on which the classifiers are fitted, and the probability at which a candidate is added.
SAMPLE_SPANS = 20_000
ACCEPT = 0.5
#: Votes of pseudo spans behind every labeler's reliability (right, wrong), so that few spans do not decide; those of
#: "check" are many, as what breaks the rule of its kind is none.
RIGHT, WRONG = np.array([8.0, 98.0, 8.0, 8.0, 8.0, 8.0]), 2.0
#: Pseudo spans of either label behind a classifier.
PSEUDO = 8.0
STEPS = 100
#: Buckets of hashed context words, and characters looked at before and behind a span.
WORD_BUCKETS = 32
BEFORE, BEHIND = 48, 24

# Base patterns. Emails are searched from their "@" and numbers as whole runs, which finds the same spans as
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
DIGIT_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS_RUN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of further candidates.
AT = re.compile(r"[ ]?[\[({<][ ]?(?:at|AT|@)[ ]?[\])}>][ ]?| (?:at|AT) (?=[A-Za-z0-9-]+ (?:dot|DOT) )")
HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[({<][ ]?(?:dot|DOT|\.)[ ]?[\])}>][ ]?| (?:dot|DOT) )[A-Za-z0-9-]+)+")
WIDE_HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9.])")
INTERNATIONAL = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")
NATIONAL = re.compile(
    r"(?<![0-9+.(\w-])(?:\([0-9]{2,5}\)[ ]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|00[1-9][0-9]?[ ./-][0-9 ./-]{6,16}[0-9]"
    r"|0[1-9][0-9]{1,4}[ /-][0-9][0-9 ]{4,10}[0-9])(?![\w.-])"
)
CARD_GROUPS = re.compile(r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}|[0-9]{13,19}")
ANY_SIGN = re.compile(r"[0-9@]|::| (?:dot|DOT) |[\[({<] ?(?:at|AT) ?[\])}>]")
WORD = re.compile(r"[^\W\d_]+")

# Gazetteers (fixed values). Calling codes of one and two digits, and the first two digits of those of three.
CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91"
    " 92 93 94 95 98".split()
)
CALLING_STEMS = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Issuer ranges of card numbers: first and last prefix.
ISSUERS = (("4", "4"), ("51", "55"), ("2221", "2720"), ("34", "34"), ("37", "37"), ("300", "305"), ("36", "36"), ("38", "39"),
           ("6011", "6011"), ("644", "649"), ("65", "65"), ("3528", "3589"), ("62", "62"), ("50", "50"), ("56", "58"))
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro mobi app dev cloud online site shop store xyz".split())
#: Words that announce a kind, in English, German, French and Spanish, and words that announce another number.
CUES = (
    frozenset("email mail mailto contact write kontakt schreiben courriel contacter écrire correo contacto escribir".split()),
    frozenset("ip address host server login adresse rechner serveur dirección servidor".split()),
    frozenset("card credit visa mastercard amex payment kreditkarte karte zahlung carte bancaire paiement tarjeta crédito pago".split()),
    frozenset(
        "phone tel telephone call mobile cell fax whatsapp telefon anruf handy mobil rufnummer téléphone appeler portable"
        " teléfono llamar móvil".split()
    ),
)
OTHER_CUES = frozenset(
    "version isbn issn order invoice section chapter page ref reference id token key hash sha md serial article number rev"
    " build release bestellung rechnung seite kapitel commande facture page chapitre pedido factura página capítulo".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in address.split("."))


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its check) of every match of the base patterns, by kind and place."""
    out = []
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append((EMAIL, start, host.end(), True))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            address = ".".join(parts[i : i + 4])
            out.append((IP, start, start + len(address), _octets(address)))
            start += len(address) + 1
    for run in DIGIT_RUN.finditer(text):
        digits = len(run[0]) - run[0].count(" ") - run[0].count("-")
        if digits >= 13:
            out.append((CARD, run.start(), run.end(), 16 <= digits <= 19 and luhn(_digits(run[0]))))
    for run in PLUS_RUN.finditer(text):
        out.append((PHONE, run.start(), run.end(), 8 <= len(_digits(run[0])) <= 15))
    return out


def candidates(text: str, matches: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans that may be personal data and are no base spans."""
    out = []
    cuts = sorted(s for kind, s, _, passed in matches if kind == IP or (passed and kind == CARD))
    for kind, start, end, passed in matches:
        if passed:
            continue
        if kind == CARD:
            out += [(CARD, m.start(), m.end()) for m in CARD_GROUPS.finditer(text, start, end) if _alone(text, m)]
        elif kind == PHONE:  # without what another kind has found in the run
            cut = bisect_left(cuts, start)
            m = INTERNATIONAL.match(text, start, min(end, cuts[cut]) if cut < len(cuts) else end)
            out.append((PHONE, start, m.end() if m else end))
        else:
            out.append((kind, start, end))
    for m in AT.finditer(text):
        start, host = m.start(), HOST.match(text, m.end())
        while start and text[start - 1] in LOCAL:
            start -= 1
        if host and start < m.start():
            out.append((EMAIL, start, host.end()))
    at = text.find("@")
    while at >= 0:  # addresses with letters other than ASCII
        start, host = at, WIDE_HOST.match(text, at + 1)
        while start and (text[start - 1] in LOCAL or text[start - 1].isalnum()):
            start -= 1
        if host and start < at and not text[start : host.end()].isascii():
            out.append((EMAIL, start, host.end()))
        at = text.find("@", at + 1)
    if ":" in text:
        out += [(IP, m.start(), m.end()) for m in COLONS.finditer(text) if _version6(m[0])]
    out += [(IP, m.start(), m.end()) for m in DEFANGED.finditer(text)]
    out += [(PHONE, m.start(), m.end()) for m in NATIONAL.finditer(text)]
    taken = sorted((s, e) for _, s, e, passed in matches if passed)
    starts, ends = [s for s, _ in taken], list(itertools.accumulate((e for _, e in taken), max, initial=0))
    return sorted({c for c in out if ends[bisect_left(starts, c[2])] <= c[1]})  # meets no base span


def _alone(text: str, m: re.Match) -> bool:
    return not (text[m.start() - 1 : m.start()].isdigit() or text[m.end() : m.end() + 1].isdigit())


def _version6(address: str) -> bool:
    try:
        ipaddress.IPv6Address(address)
    except ValueError:
        return False
    return sum(map(bool, address.split(":"))) >= 3


def _vote(yes: bool, no: bool = True) -> str:
    return "+" if yes else "-" if no else "0"


def _format(kind: int, span: str) -> str:
    if kind == EMAIL:
        return _vote("@" in span or "(" in span or "[" in span, no=False)
    if kind == IP:
        return _vote(":" in span or all(len(p) <= 3 for p in span.split(".")))
    if kind == CARD:
        return _vote(bool(CARD_GROUPS.fullmatch(span)))
    return _vote(bool(INTERNATIONAL.fullmatch(span) or NATIONAL.fullmatch(span)))


def _check(kind: int, span: str, digits: str) -> str:
    if kind == EMAIL:
        return _vote(not (".." in span or span.startswith((".", "-")) or "-." in span or ".-" in span or span.endswith("-")))
    if kind == IP:
        return _vote(":" in span or _octets(re.sub(r"[\[\]()]", "", span)))
    if kind == CARD:
        return _vote(len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1)
    return _vote(8 <= len(digits) <= 15 and len(set(digits)) > 2)


def _gazetteer(kind: int, span: str, digits: str) -> str:
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        return _vote(last in TOP_DOMAINS or (len(last) == 2 and last.isalpha()), no=not last.isalpha())
    if kind == IP:
        return _vote(not span.startswith(("0.", "127.", "255.")), no=True)
    if kind == CARD:
        return _vote(any(a <= digits[: len(a)] <= b for a, b in ISSUERS))
    code = digits.removeprefix("00")
    if not span.startswith(("+", "00")):
        return "0"
    return _vote(code[:1] in CALLING or code[:2] in CALLING or code[:2] in CALLING_STEMS)


def _context(kind: int, words: list[str]) -> str:
    return _vote(any(w in CUES[kind] for w in words), no=any(w in OTHER_CUES for w in words))


def describe(kind: int, text: str, start: int, end: int) -> tuple[str, list[int]]:
    """Votes of the labelers on a span (a character each), and its features: shape, then two hashed words beside it."""
    span, before, behind = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + BEHIND]
    digits = _digits(span)
    words, after = WORD.findall(before.lower())[-5:], WORD.findall(behind.lower())[:1]
    near = max(sum(map(str.isdigit, before[-16:])), sum(map(str.isdigit, behind[:16])))
    joined = before[-1:].isalnum() or behind[:1].isalnum() or before[-1:] == "_" or behind[:1] == "_"
    votes = (
        _format(kind, span) + _check(kind, span, digits) + _vote(not joined) + _gazetteer(kind, span, digits)
        + _context(kind, words) + _vote(near == 0, no=near >= 6)
    )
    marks = [c in span for c in "+(@[:"]
    shape = [min(len(span), 64), min(len(digits), 32), sum(map(span.count, " -.")), *map(int, marks)]
    return votes, shape + [crc32(w.encode()) % WORD_BUCKETS for w in (words[-1] if words else "", after[0] if after else "")]


SHAPES = 8
SPANS = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:string,features:array<int>>>"


def find(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """All base spans and candidates of a text, described."""
    if not ANY_SIGN.search(text):
        return []
    matches = base_matches(text)
    base = [(k, s, e, True) for k, s, e, passed in matches if passed]
    more = [(*c, False) for c in candidates(text, matches)]
    return [(k, s, e, b, *describe(k, text, s, e)) for k, s, e, b in sorted([*base, *more])]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end", "base", "votes", "features")
    kind = pa.list_(
        pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()),
                   ("features", pa.list_(pa.int32()))])
    )
    for batch in batches:
        found = [[dict(zip(names, s, strict=True)) for s in find(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])


class Reliabilities:
    """Per kind: the share of true spans, and how often each labeler says yes on true and on false spans."""

    def __init__(self) -> None:
        self.share = np.full(len(KINDS), 0.5)
        self.yes = np.array([[RIGHT, np.full(len(LABELERS), WRONG)]] * len(KINDS)) / (RIGHT + WRONG)

    def true(self, kind: int, votes: np.ndarray) -> np.ndarray:
        """Probability of being true for rows of votes (1, -1, 0)."""
        odds = np.log(self.share[kind] / (1 - self.share[kind])) * np.ones(len(votes))
        yes = np.log(self.yes[kind])
        no = np.log(1 - self.yes[kind])
        odds += (votes > 0) @ (yes[0] - yes[1]) + (votes < 0) @ (no[0] - no[1])
        return 1 / (1 + np.exp(-odds))


def as_numbers(votes: list[str]) -> np.ndarray:
    return np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in v] for v in votes], dtype=float).reshape(-1, len(LABELERS))


def fit_reliabilities(patterns: list[tuple[int, bool, str, int]]) -> Reliabilities:
    """EM on the number of spans of every (kind, base, votes); base spans are true."""
    out = Reliabilities()
    for kind in range(len(KINDS)):
        mine = sorted(p for p in patterns if p[0] == kind)
        if not mine:
            continue
        votes, n = as_numbers([p[2] for p in mine]), np.array([p[3] for p in mine], dtype=float)
        known = np.array([p[1] for p in mine])
        for _ in range(STEPS):
            true = np.where(known, 1.0, out.true(kind, votes))
            for side, weight in enumerate((n * true, n * (1 - true))):
                said_yes, said_no = weight @ (votes > 0), weight @ (votes < 0)
                prior = (RIGHT, WRONG) if side == 0 else (WRONG, RIGHT)
                out.yes[kind, side] = (said_yes + prior[0]) / (said_yes + said_no + RIGHT + WRONG)
            out.share[kind] = ((n * true)[~known].sum() + WRONG) / (n[~known].sum() + 2 * WRONG)
    return out


def vectors(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Rows of the classifier: one, votes, scaled shape, and the two words' buckets as indicators."""
    words = np.zeros((len(votes), 2 * WORD_BUCKETS))
    for i in range(2):
        words[np.arange(len(votes)), i * WORD_BUCKETS + features[:, SHAPES + i]] = 1
    return np.concatenate([np.ones((len(votes), 1)), votes, features[:, :SHAPES] / [64, 32, 4, 1, 1, 1, 1, 1], words], axis=1)


def fit_classifier(votes: np.ndarray, features: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier with soft labels (ridge 1), by Newton steps.

    PSEUDO spans with all votes yes, and as many with all votes no, hold its direction where spans are few or one-sided.
    """
    ends = np.concatenate([np.ones((1, len(LABELERS))), -np.ones((1, len(LABELERS)))])
    middle = features.mean(0).astype(int) if len(features) else np.zeros(SHAPES + 2, dtype=int)
    x = np.concatenate([vectors(votes, features), vectors(ends, np.array([middle, middle]))])
    x[-2:, -2 * WORD_BUCKETS :] = 0
    y, weight = np.concatenate([true, [1.0, 0.0]]), np.concatenate([np.ones(len(true)), [PSEUDO, PSEUDO]])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - w)
    return w


def train(spans: DataFrame) -> np.ndarray:
    """Classifier weights (a row per kind) from the spans (kind, base, votes, features, key) of the whole corpus."""
    counted = spans.groupBy("kind", "base", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3^6 patterns a kind
    reliable = fit_reliabilities([tuple(r) for r in counted])
    total = max(1, sum(r["n"] for r in counted))
    picked = F.pmod("key", F.lit(1 << 40)) < int(min(1.0, 0.8 * SAMPLE_SPANS / total) * 2**40)
    rows = spans.filter(picked).orderBy("key", "kind", "votes", "features").limit(SAMPLE_SPANS).collect()
    out = []
    for kind in range(len(KINDS)):
        mine = [r for r in rows if r["kind"] == kind]
        votes = as_numbers([r["votes"] for r in mine])
        features = np.array([r["features"] for r in mine], dtype=int).reshape(-1, SHAPES + 2)
        true = np.where([r["base"] for r in mine], 1.0, reliable.true(kind, votes)) if mine else np.zeros(0)
        out.append(fit_classifier(votes, features, true))
    return np.array(out)


def decide(found: list[dict], weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a document by kind and start: accepted candidates are added where none overlap."""
    base = [(s["kind"], s["start"], s["end"]) for s in found if s["base"]]
    more = [s for s in found if not s["base"]]
    if not more:
        return base, base
    x = vectors(as_numbers([s["votes"] for s in more]), np.array([s["features"] for s in more], dtype=int))
    p = 1 / (1 + np.exp(-(x * weights[[s["kind"] for s in more]]).sum(1)))
    added, free = [], -1
    for start, end, kind, chance in sorted((s["start"], s["end"], s["kind"], c) for s, c in zip(more, p, strict=True)):
        if chance >= ACCEPT and start >= free:
            added.append((kind, start, end))
            free = end
    return base, sorted(base + added)


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The numbers count base spans; base_sha256 is the hash of these as
    kind:start:end by kind and start (code points, end exclusive), joined by
    commas; spans lists them and those that the method adds in the same way.
    A null or empty text has none. Every text is searched whole, in time linear in
    its length but for the sorting of its spans. Equal rows give equal results;
    repeated rows count each time in the votes, and ties of the sample's hash go by
    kind, votes and features. Null ids stay null; an empty table gives no rows; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    found = cut_lineage(source.mapInArrow(_find, f"doc_id {id_type}, found {SPANS}"))
    spans = found.select("doc_id", F.inline("found")).withColumn("key", F.xxhash64("doc_id", "kind", "start", "end"))
    weights = train(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decide(f.as_py(), weights) for f in batch.column("found")]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in made], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([sha256(_text_of(base).encode()).hexdigest() for base, _ in made], pa.string())
            everything = pa.array([_text_of(spans) for _, spans in made], pa.string())
            added = pa.array([len(spans) - len(base) for base, spans in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, everything, added], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)
    return found.mapInArrow(run, f"doc_id {id_type}, {kinds}, base_sha256 string, spans string, n_added bigint")
