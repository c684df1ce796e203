"""Personal data by weak supervision.

Candidates (strict matches and looser look-alikes) get votes from regex, gazetteer and context labelers. The
votes of the whole corpus are counted by pattern; expectation-maximisation over the counts estimates how
reliable each labeler is and how likely each pattern is personal data. A logistic span classifier learns from
those likelihoods, with the votes and the span's own look (length, signs, word before, place) as features, and decides
about the candidates that the strict patterns alone don't settle. Candidates are addresses, numbers, names, identity
and account numbers, and secrets such as keys, tokens and passwords.
"""

from __future__ import annotations

import ipaddress
import itertools
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "name", "identity", "account", "secret")
BASE_KINDS = KINDS[:4]
ADDED = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]

# Gazetteers and context words.
TOP_DOMAINS = frozenset("com net org edu gov mil int info io de fr es it uk nl eu us ca au ch at pl se".split())
GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica"
    " thomas sarah anna maria peter paul laura julia marie jean pierre hans carlos jose juan ana lucia klaus sophie".split()
)
TITLES = frozenset("mr mrs ms dr prof herr frau madame monsieur señor señora sr sra".split())
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "hf_", "npm_", "eyJ")


@dataclass(frozen=True)
class Lists:
    """The gazetteers. Pass larger ones to ``fit`` and ``annotated``; they go to every task."""

    top_domains: frozenset[str] = TOP_DOMAINS
    given_names: frozenset[str] = GIVEN_NAMES
    key_prefixes: tuple[str, ...] = KEY_PREFIXES


LISTS = Lists()
_CONTACT = r"phone|tel|telephone|mobile|cell|fax|call|contact|e-?mail|mailto|write|reach|card|visa|mastercard|amex|pay(?:ment)?|ip|server|host|dear|name"
FOR = re.compile(rf"(?i)\b(?:{_CONTACT}|ssn|social security(?: number)?|identity|iban|account|bank)\b\W*$")
FOR_SECRET = re.compile(
    r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|password|api[ _-]?key|access[ _-]?key|private[ _-]?key|(?<![a-z])key|bearer|credentials?|authorization)"
    r"(?: is)?\W{0,4}$"
)
AGAINST = re.compile(
    r"(?i)(?:\b(?:order|invoice|isbn|issn|version|serial|model|part|page|pages|ref|item|sku|doi|build|license|licence|section|hash|commit|sha-?[0-9]*|md5|checksum|digest|etag|uuid|no)\b|#)\W*$"
)

_RUN = re.compile(r"\+?[0-9][0-9\x20().-]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_GROUP = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_NATIONAL = re.compile(r"\(?[0-9]{3,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
_AT, _DOT, _LABEL = r" ?[\[(] ?at ?[\])] ?", r" ?(?:\[dot\]|\(dot\)| dot ) ?", r"[A-Za-z0-9-]{1,63}"
#: A plain "at" needs a spelt dot; beside one in brackets the dot may be a plain one.
_SPELT = re.compile(rf"([A-Za-z0-9._+-]{{1,64}})(?: ?(?:\[at\]|\(at\)| at ) ?{_LABEL}(?:{_DOT}{_LABEL}){{1,8}}|{_AT}{_LABEL}(?:(?:\.|{_DOT}){_LABEL}){{1,8}})", re.I)
_SPELT_SIGNS = (" dot ", "dot]", "dot)", "at]", "at)", "at ]", "at )")
_TITLE = re.compile(r"[DFHMPS][A-Za-zñ]{1,7}(?=\.? [A-Z])")
_IDENTITY = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{16,}(?:\.[A-Za-z0-9_-]{8,})*=*")
_VALUE = re.compile(r"""[:=]\s{0,2}["']?([^\s"',;<>]{6,256})""")
_LETTERS, _HEX = re.compile(r"[a-z]{5}"), frozenset("0123456789abcdef")
_BEGIN, _END = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,30}PRIVATE KEY-----")
_NAMED = re.compile(r"\b((?i:mr|mrs|ms|dr|prof|herr|frau|madame|monsieur|señor|señora|sr|sra))\.? ([A-Z][a-zà-ÿ]{1,30})(?: ([A-Z][a-zà-ÿ]{1,30}))?\b")


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool
    valid: int  # the kind's own check: 1 passed, -1 failed, 0 none
    known: int  # the gazetteer's vote


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str, lists: Lists) -> Iterator[Candidate]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            known = 1 if m[0].rpartition(".")[2].lower() in lists.top_domains else -1
            yield Candidate("email", start, done, True, 0, known)
        at = text.find("@", max(done, at + 1))


def _numbers(text: str) -> Iterator[Candidate]:
    for run in _RUN.finditer(text):
        a, b = run.span()
        m = _ACCOUNT.match(text, a - 2) if a > 1 and text[a - 1].isupper() else None
        if m:
            flat = m[0].replace(" ", "")
            ok = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
            yield Candidate("account", *m.span(), False, 1 if ok else -1, 0)
        if b - a < 7:
            continue
        for m in _IDENTITY.finditer(text, a, b):
            area, group, serial = m[0].split("-")
            ok = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
            yield Candidate("identity", *m.span(), False, 1 if ok else -1, 0)
        for m in _CHAIN.finditer(text, a, b):
            at, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                ok = all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) < 5 else p.lstrip("0") or 0) <= 255 for p in four)
                yield Candidate("ip", at, end, ok, 1 if ok else -1, 0)
                at = end + 1
        taken = []
        for m in _CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19:
                ok = luhn(digits)
                if ok:
                    taken.append(m.span())
                yield Candidate("card", *m.span(), ok and len(digits) >= 14, 1 if ok else -1, 1 if digits[0] in "3456" else -1)
                if not ok:  # a whole group of digits inside may be one
                    for part in _GROUP.finditer(text, *m.span()):
                        if part.span() != m.span() and luhn(part[0]):
                            taken.append(part.span())
                            yield Candidate("card", *part.span(), False, 1, 1 if part[0][0] in "3456" else -1)
        m = _PHONE.match(text, a, b)
        if m and 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield Candidate("phone", *m.span(), True, 1, 0)
            taken = sorted([*taken, m.span()])
        at = a - (text[a - 1 : a] == "(")
        for start, end in [*taken, (b, b)]:  # national numbers between what is settled
            for m in _NATIONAL.finditer(text, at, max(at, start)):
                closed = ("(" in m[0]) == (")" in m[0])
                yield Candidate("phone", *m.span(), False, 1 if closed else -1, 0)
            at = max(at, end)
    if "::" in text or text.count(":") > 6:
        for m in _COLONS.finditer(text):
            try:
                ok = ipaddress.IPv6Address(m[0]) is not None
            except ValueError:
                ok = False
            groups = [g for g in m[0].split(":") if g]
            if groups:
                yield Candidate("ip", *m.span(), False, 1 if ok else -1, 1 if len(groups) > 2 and len(m[0]) > 8 else -1)


def _words(text: str, lists: Lists) -> Iterator[Candidate]:
    lower = text.lower()
    if any(sign in lower for sign in _SPELT_SIGNS):
        for m in _SPELT.finditer(text):
            known = re.split(r"[^A-Za-z0-9-]+", m[0].strip("[]() "))[-1].lower() in lists.top_domains
            yield Candidate("email", *m.span(), False, 0, 1 if known else -1)
    done = 0
    for title in _TITLE.finditer(text):
        m = _NAMED.match(text, title.start()) if title[0].lower() in TITLES and title.start() >= done else None
        if m:
            done = m.end()
            yield Candidate("name", *m.span(), False, 0, 1 if m[2].lower() in lists.given_names else -1 if not m[3] else 0)


def _made_up(value: str) -> int:
    """1 if letters and digits alternate at least three times, as in random strings; -1 if it holds a word; else 0.

    Hexadecimal strings hold no words, but as likely are digests: 0.
    """
    if _HEX.issuperset(value.lower()):
        return 0
    if _LETTERS.search(value):
        return -1
    kinds = [c.isdigit() for c in value if c.isalnum()]
    return int(sum(x != y for x, y in zip(kinds, kinds[1:])) >= 3)


def _secrets(text: str, lists: Lists) -> Iterator[Candidate]:
    """Private key blocks, values given to words such as password, and opaque strings of letters and digits."""

    def candidate(start: int, end: int, introduced: bool = False) -> Candidate:
        value = text[start:end]
        made_up = _made_up(value[:256])
        if introduced:  # a password may be hexadecimal or hold words, but plain words are talk about one
            made_up = 1 if any(map(str.isdigit, value)) else -1
        return Candidate("secret", start, end, False, made_up, 1 if value.startswith(lists.key_prefixes) else 0)

    if "-----BEGIN " in text:
        ends = [m.end() for m in _END.finditer(text)]
        done = 0
        for m in _BEGIN.finditer(text):
            at = bisect_left(ends, m.end())
            if m.start() >= done and at < len(ends):
                done = ends[at]
                yield Candidate("secret", m.start(), done, False, 1, 1)
    given = [m.span(1) for m in _VALUE.finditer(text) if FOR_SECRET.search(text[max(0, m.start() - 24) : m.start()])]
    yield from (candidate(a, b, True) for a, b in given)
    starts = [a for a, _ in given]
    for m in _OPAQUE.finditer(text):
        at = bisect_left(starts, m.start() + 1)
        if not (at and given[at - 1][1] > m.start()) and not m[0].isdigit() and any(map(str.isdigit, m[0])):
            yield candidate(*m.span())


def candidates(text: str | None, lists: Lists = LISTS) -> list[Candidate]:
    """Strict matches (base) and look-alikes of a whole text, by start, then kind."""
    text = text or ""
    if not text:
        return []
    found = [*_emails(text, lists), *_numbers(text), *_words(text, lists), *_secrets(text, lists)]
    return sorted(found, key=lambda c: (c.start, KINDS.index(c.kind), c.end))


LABELERS = ("strict pattern", "own check", "gazetteer", "context for", "context against", "stands alone")


def votes(text: str, c: Candidate) -> tuple[int, ...]:
    """One vote for each labeler: 1 personal data, -1 not, 0 abstains."""
    before = text[max(0, c.start - 24) : c.start]
    around = text[max(0, c.start - 1) : c.start] + text[c.end : c.end + 1]
    glued = any(x.isalnum() or x in ("/" if c.kind == "secret" else "_=\"'/") for x in around)
    return (
        1 if c.base else 0,
        c.valid,
        c.known,
        1 if (FOR_SECRET if c.kind == "secret" else FOR).search(before) else 0,
        -1 if AGAINST.search(before) else 0,
        -1 if glued else 0,
    )


def look(text: str, c: Candidate) -> str:
    """What the span itself and its neighbours look like, in few values: length, signs, the word before, place in the line."""
    value = text[c.start : min(c.end, c.start + 256)]
    size = min(3, (c.end - c.start).bit_length() - 3) if c.end - c.start >= 8 else 0
    signs = 2 * any(map(str.isdigit, value)) + any(map(str.isalpha, value))
    before = text[max(0, c.start - 24) : c.start]
    word = re.search(r"(\w+)\W*$", before)
    near = zlib.crc32(word[1].lower().encode()) % 15 + 1 if word else 0
    return f"l{size}.s{signs}.w{near}.p{int(not before or before.endswith(chr(10)))}"


def pattern(text: str, c: Candidate) -> str:
    """``kind:votes:look`` of a candidate."""
    return f"{c.kind}:{''.join('-0+'[v + 1] for v in votes(text, c))}:{look(text, c)}"


@dataclass(frozen=True)
class Model:
    """Labelers' reliabilities and the span classifier's weights by feature."""

    reliability: dict[str, tuple[float, ...]]
    weights: dict[str, float]

    def probability(self, found: str) -> float:
        z = self.weights.get("", 0.0) + sum(self.weights.get(f, 0.0) for f in features(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(found: str) -> list[str]:
    kind, marks, seen = found.split(":")
    return [kind, *(f"{i}{m}" for i, m in enumerate(marks) if m != "0"), *(f"{kind}.{x}" for x in seen.split("."))]


def estimate(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], dict[str, tuple[float, ...]]]:
    """Likelihood of each ``kind:votes`` and each labeler's accuracy by kind, by expectation-maximisation over counts.

    A labeler is right with one probability whatever the truth, and says nothing by abstaining, so that those
    which know only one answer count too. Both answers are equally likely beforehand. Each accuracy starts as
    if 19 of 20 made-up votes were right, and stays within 0.05 and 0.97, so that one labeler against another decides nothing.
    """
    by_votes: Counter = Counter()
    for k, c in counts.items():
        by_votes[k.rpartition(":")[0]] += c
    names = sorted(by_votes)
    n = np.array([by_votes[k] for k in names], float)
    kind = np.array([KINDS.index(k.partition(":")[0]) for k in names])
    marks = np.array([["-0+".index(m) - 1 for m in k.partition(":")[2]] for k in names], float)
    right = np.full((len(KINDS), marks.shape[1]), 0.95)
    p = np.full(len(names), 0.5)
    for _ in range(rounds):
        new = 1 / (1 + np.exp(-np.clip((marks * np.log(right / (1 - right))[kind]).sum(axis=1), -30, 30)))
        agreed, voted = np.full(right.shape, 19.0), np.full(right.shape, 20.0)
        np.add.at(agreed, kind, ((marks > 0) * new[:, None] + (marks < 0) * (1 - new)[:, None]) * n[:, None])
        np.add.at(voted, kind, (marks != 0) * n[:, None])
        right = np.clip(agreed / voted, 0.05, 0.97)
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return dict(zip(names, p.tolist(), strict=True)), {name: tuple(right[:, i].tolist()) for i, name in enumerate(LABELERS)}


def classifier(counts: dict[str, int], likely: dict[str, float], ridge: float = 1.0) -> dict[str, float]:
    """Weights of a logistic classifier over pattern features, trained on the likelihoods."""
    names = sorted(counts)
    columns = sorted({f for k in names for f in features(k)} | {""})
    place = {c: i for i, c in enumerate(columns)}
    x = np.zeros((len(names), len(columns)))
    for i, k in enumerate(names):
        x[i, [place[f] for f in ("", *features(k))]] = 1.0
    y, n = np.array([likely[k.rpartition(":")[0]] for k in names]), np.array([counts[k] for k in names], float)
    w = np.zeros(len(columns))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (n * (p - y)) + ridge * w)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(columns, w.tolist(), strict=True))


def fit(docs: DataFrame, text: str = "text", lists: Lists = LISTS) -> Model:
    """Estimate reliabilities and train the classifier on the candidates of all texts.

    Only counts by pattern reach the driver, whatever the corpus' size: at most 8 kinds times 144 possible votes times
    512 looks, in practice some thousands. Without a candidate the model adds nothing to the strict matches.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(pattern(t, c) for c in candidates(t, lists))
        yield pd.DataFrame({"pattern": pd.Series([*seen], dtype=object), "n": pd.Series([*seen.values()], dtype="int64")})

    found = docs.select(F.col(text).alias("text")).mapInPandas(count, "pattern string, n long")
    counts = {r.pattern: r.n for r in found.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return Model({}, {"": -30.0})
    likely, reliability = estimate(counts)
    return Model(reliability, classifier(counts, likely))


def annotated(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.9, lists: Lists = LISTS) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 and spans of each whole text.

    The counts and the digest (of ``kind:start:end``, comma-joined) are of the strict matches, which all are
    in ``spans`` too; the classifier adds look-alikes of at least ``threshold`` that overlap no strict match
    or earlier added one. Positions are code points, ends exclusive. Null texts count as empty. Columns
    named like the added ones are replaced; no row is dropped.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])

    def spans_of(t: str | None) -> str:
        found = candidates(t, lists)
        base = [c for c in found if c.base]
        starts, reach = [c.start for c in base], [0, *itertools.accumulate((c.end for c in base), max)]
        all_, added = list(base), 0
        for c in found:  # by start: what overlaps begins before c ends and reaches beyond its start
            if c.base or max(added, reach[bisect_left(starts, c.end)]) > c.start:
                continue
            if model.probability(pattern(t, c)) >= threshold:
                all_.append(c)
                added = c.end
        all_.sort(key=lambda c: (c.start, KINDS.index(c.kind), c.end))
        joined = lambda cs: ",".join(f"{c.kind}:{c.start}:{c.end}" for c in cs)
        return f"{joined(base)}|{joined(all_)}"

    @F.pandas_udf("string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([spans_of(t) for t in part], dtype=object)

    base = F.split_part("spans", F.lit("|"), F.lit(1))
    return (
        docs.withColumn("spans", both(F.col(text)))  # a name that docs no longer have
        .withColumns({f"n_{k}": F.regexp_count(base, F.lit(f"{k}:")).cast("long") for k in BASE_KINDS})
        .withColumns({"base_sha256": F.sha2(base, 256), "spans": F.split_part("spans", F.lit("|"), F.lit(2))})
        .select(*docs.columns, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans")
    )


def _masked(text: str | None, spans: str | None) -> str | None:
    if not text or not spans:
        return text
    out, done = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",")):
        start, end = int(a), int(b)
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def masked(annotated_docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return annotated_docs.withColumn(text, mask(F.col(text), F.col(spans)))
