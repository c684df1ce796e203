"""Toxicity: a weighted lexicon, learned from labelled texts and matched by an Aho-Corasick automaton.

Texts are folded first (case, accents, look-alike letters, digits and signs put for letters; i and l are one
letter). A sign in or beside a word is read in the way that makes an entry, if one does. The lexicon has
words, their regular inflections, and beginnings that several toxic words share, each with the log of how
much more often it stands in toxic texts. Every word counts its heaviest entry; harmless phrases, given and
learned, cancel what stands in them. The sums, divided by the text's length in several ways, go through a
logistic curve fitted on the same labelled texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.llm.common import small_batches
from crowdlake.operators.materialize import materialize

#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = dict(zip("авекмнорстухіѕјԁԛԝαβεηικνορτυχωɡıł", "abekmhopctyxisjdqwabehiknoptuxwgil", strict=True))
LOOKALIKES |= dict(  # Cyrillic, Armenian, phonetic and crossed letters, and others
    "ӏl һh ѵv єe ҽe гr пn ьb яr ґr ҟk ҍb աw եt ցg գq զq էt յj հh ոn ռn ղn մu սu օo քp ժd վy ɑa əe ɛe ƒf ɦh ɩi ɪi ʝj ʟl ʍm ɱm ɴn ɲn ɾr ʀr ʂs ƽs"
    " ƭt ʋv ɯw ᴡw ʏy ƴy ʐz ƶz øo đd ħh ŧt ƀb ɓb ɗd ɠg γy σo δd πn ςc ϳj נj ×x ∂d €e £l ¢c ¡i".split()
)
#: Digits put for letters. They are letters in any word that has a letter.
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
#: Signs put for letters. They may as well end a word; until that is settled, a capital stands for them.
SIGNS = {"!": "i", "|": "i", "+": "t", "$": "s", "@": "a"}
#: Lengths of the word beginnings that may become entries.
BEGINNINGS = range(4, 11)
#: Endings that make another form of a word of at least four letters.
ENDINGS = ("s", "es", "y", "ic", "ish", "ly", "ness", "like", "e", "en", "er", "et")
#: Phrases in which a word that is often an insult is none.
ORDINARY = (
    "class clown", "circus clown", "clown fish", "clown loach", "pond scum", "soap scum", "scum line",
    "trash bag", "trash bags", "trash bin", "trash bins", "trash can", "trash cans", "trash collection",
    "trash pickup", "take out the trash", "taking out the trash", "recycle the trash",
    "pathetic fallacy", "stupid mistake", "the idiot by", "winner and loser", "winners and losers",
)

_UNSEEN = [i for i in (*range(0x10000), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000)) if unicodedata.category(chr(i)) in ("Cf", "Me")]
_BLOCKS = (0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE00, 0xFE10), (0xFE20, 0xFE30), (0x180B, 0x1810), (0xE0100, 0xE01F0)
_FOLD = {i: None for a, b in _BLOCKS for i in range(a, b)} | dict.fromkeys((*_UNSEEN, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0))
_FOLD |= {ord(a): b for a, b in LOOKALIKES.items()}
# i and l are one letter, since 1, ! and | stand for both.
_SPACES = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord("i"): "l"}
_SPACES |= {i: " " for i in (*range(0xA0, 0xC0), *range(0x2010, 0x2070), *range(0x3000, 0x3040)) if not chr(i).isalnum()}
_PUT = re.compile(r"(?<=[a-z])[0-9!|+$@]+|(?<![0-9!|+$@])[0-9!|+$@]++(?=[a-z])")
_TO_LETTERS = str.maketrans(SUBSTITUTES | {c: x.replace("i", "l").upper() for c, x in SIGNS.items()})
_SIGN = re.compile("[LTSA]")
_BEFORE_LETTERS = re.compile("[LTSA]++(?! |$)")
_LEFT = dict.fromkeys(map(ord, "LTSA"), " ")
_SIGNED = re.compile("(?<= )[^ LTSA]*+[LTSA][^ ]*")


def folded(text: str | None) -> str:
    """Lower case, without accents, look-alikes and substitutes; words between single or more spaces.

    i and l are both l. Capitals are signs that may be letters or not; :func:`plain` or :meth:`Model.settled` decides.
    """
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).lower().translate(_FOLD)
    t = _PUT.sub(lambda m: m[0].translate(_TO_LETTERS), t)
    return " " + t.translate(_SPACES) + " "


def plain(t: str) -> str:
    """A folded text whose signs are letters if a letter follows, else spaces. Its length stays."""
    return _BEFORE_LETTERS.sub(lambda m: m[0].lower(), t).translate(_LEFT) if _SIGN.search(t) else t


def entry(term: str) -> str:
    """An entry in the folded letters, with its spaces at the ends."""
    return " " * term.startswith(" ") + " ".join(plain(folded(term)).split()) + " " * term.endswith(" ")


def terms_of(word: str) -> list[str]:
    """The entries that could match a word: its beginnings, and itself as a whole."""
    return [" " + word[:k] for k in BEGINNINGS if k <= len(word)] + [f" {word} "]


@dataclass(frozen=True)
class Model:
    """Entries with weights, harmless phrases, and the logistic curve over :func:`features`."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    curve: tuple[float, ...] = ()
    prior: float = 0.0
    automaton: list = field(default_factory=list, compare=False)

    def matcher(self):
        if not self.automaton:
            terms: dict[str, float] = {}
            for term, w in self.weights.items():
                e = entry(term)
                terms[e] = max(w, terms.get(e, w))
            a = ahocorasick.Automaton()
            for term, w in terms.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                p = f" {entry(phrase)} "
                a.add_word(p, (len(p), -1.0))
            a.make_automaton()
            begun = sorted({len(t) - 1 for t in terms if not t.endswith(" ")})
            self.automaton.extend((a, terms, begun, max(map(len, terms), default=0)))
        return self.automaton[0]

    def settled(self, text: str) -> str:
        """A folded text with each sign read as the letter or the end of a word that makes the heaviest entry."""
        return plain(_SIGNED.sub(self._read, text)) if _SIGN.search(text) else text

    def _read(self, m: re.Match) -> str:
        self.matcher()
        _, terms, begun, longest = self.automaton
        word, letters = m[0], m[0].lower()
        signs = [i for i, c in enumerate(word) if c in "LTSA"]
        found = []
        ends = [*signs, len(word)]
        for k, a in enumerate([0, *(i + 1 for i in signs)]):
            for b in (a + n for n in begun if a + n <= len(word)):
                if w := terms.get(" " + letters[a:b]):
                    found.append((-w, a, -b, False))
            for i in range(k, len(ends)):
                b = ends[i]
                if b - a > longest:
                    break
                if b > a and (w := terms.get(f" {letters[a:b]} ")):
                    found.append((-w, a, -b, True))
        out = list(word)
        for _, a, b, whole in sorted(found):
            b = -b
            rims = [i for i in (a - 1, b if whole else -1) if 0 <= i < len(out)]
            if " " not in out[a:b] and all(out[i] in "LTSA " for i in rims):
                out[a:b] = letters[a:b]
                for i in rims:
                    out[i] = " "
        return "".join(out)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def __setstate__(self, state):
        self.__dict__.update(state, automaton=[])

    def hits(self, text: str) -> dict[int, float]:
        """Weight of the heaviest entry at each matched word of a folded text, by position."""
        text = self.settled(text)
        best: dict[int, float] = {}
        harmless = []
        if self.weights:
            for end, (n, w) in self.matcher().iter(text):
                at = end - n + 1
                if w < 0:
                    harmless.append((at, end))
                elif w > best.get(at, 0.0):
                    best[at] = w
        places = sorted(best) if harmless else []
        for a, b in harmless:
            for at in places[bisect_left(places, a) : bisect_left(places, b)]:
                best.pop(at, None)
        return best

    def features(self, text: str | None) -> list[float]:
        t = self.settled(folded(text))
        n, found = len(t.split()), self.hits(t)
        s = sum(found.values())
        top = max(found.values(), default=0.0)
        return [s / (n + 5), s / math.sqrt(n + 5), math.log1p(s), math.log1p(n), math.log1p(len(found)), top, float(bool(found))]

    def score(self, text: str | None) -> float:
        if not self.curve:
            return self.prior
        z = self.curve[-1] + sum(c * (x - m) / s for c, x, m, s in zip(self.curve, self.features(text), self.mean, self.scale, strict=False))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _counts(wanted: frozenset[str] | None):
    """Texts and occurrences of each term (or of the wanted ones) in a partition's toxic and other texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, words = (Counter(), Counter()), (Counter(), Counter())
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                seen: Counter = Counter()
                parts = Counter(plain(folded(text)).split())
                words[y]["\0"] += sum(parts.values())
                for word, n in parts.items():
                    for term in terms_of(word):
                        if wanted is None or term in wanted:
                            seen[term] += n
                words[y].update(seen)
                texts[y].update(seen.keys())
                texts[y]["\0"] += 1
        terms = [*(texts[0].keys() | texts[1].keys())]
        cols = {"term": pd.Series(terms, dtype=object), "texts0": [texts[0][t] for t in terms], "texts1": [texts[1][t] for t in terms]}
        yield pd.DataFrame(cols | {"words0": [words[0][t] for t in terms], "words1": [words[1][t] for t in terms]})

    return run


_COUNTED = "term string, texts0 long, texts1 long, words0 long, words1 long"


def _totals(df: DataFrame) -> DataFrame:
    return df.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("texts0", "texts1", "words0", "words1")])


def _phrases(model: Model):
    """Two-word phrases around matched words, with their toxic and other texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b["text"], b["toxic"], strict=True):
                t = model.settled(folded(text))
                found = set()
                for at in model.hits(t):
                    after = t[at : at + 80].split()[:2]
                    before = t[max(0, at - 40) : at + 1].split()[-1:] + after[:1]
                    found |= {" ".join(p) for p in (after, before) if len(p) == 2}
                seen[y].update(found)
        phrases = [*(seen[0].keys() | seen[1].keys())]
        yield pd.DataFrame({"phrase": pd.Series(phrases, dtype=object), "texts0": [seen[0][p] for p in phrases], "texts1": [seen[1][p] for p in phrases]})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(clear: dict[str, float], least_words: int = 3) -> dict[str, float]:
    """Entries from the clear terms (whole words and beginnings with their weights).

    Words stay and bring their inflections. A beginning stays if at least ``least_words`` different clear words have
    it and no longer clear beginning is that of the same words: one word proves nothing of others that begin alike.
    """
    words = [t.strip() for t in clear if t.endswith(" ")]
    having = {t: frozenset(w for w in words if w.startswith(t.strip())) for t in clear if not t.endswith(" ")}
    longest: dict[frozenset, str] = {}
    for t, group in having.items():
        if len(group) >= least_words:
            longest[group] = max(t, longest.get(group, ""), key=len)
    out = {t: clear[t] for t in longest.values()}
    for w in words:
        for form in (w, *(w + entry(e) for e in ENDINGS if len(w) >= 4)):
            out[f" {form} "] = max(clear[f" {w} "], out.get(f" {form} ", 0.0))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20000, max_terms: int = 5000, min_texts: int = 6,
    exceptions: tuple[str, ...] = ORDINARY,
) -> Model:
    """Learn from documents (doc_id, text) with labels (doc_id, toxic), on at most ``sample_rows`` labelled ids.

    The sample takes the ids of least hash. Null ids and labels are skipped; of contradicting labels of an id
    the toxic one holds. An entry needs ``min_texts`` toxic texts, and must be clearly (4 standard errors)
    and at least e times as frequent there; of the ``max_terms`` clearest, :func:`lexicon` makes the entries. At most
    ``max_terms`` harmless phrases, those of most clean texts, are learned beside ``exceptions``. Without both classes there
    is no lexicon and every score is the share of toxic labels (0 without labels).
    Only the lexicon, the phrases and seven numbers for each sampled text reach the driver.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("toxic", (F.col("toxic") > 0).cast("int"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # At most sample_rows ids: broadcast, so that no text is shuffled.
    texts = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    toxic = _totals(texts.where("toxic = 1").mapInPandas(_counts(None), _COUNTED)).where(F.col("texts1") >= min_texts)
    candidates = frozenset(r.term for r in toxic.select("term").collect())
    counted = {r.term: r for r in _totals(texts.mapInPandas(_counts(candidates | {"\0"}), _COUNTED)).collect()}
    total = counted.pop("\0", None)
    n0, n1 = (total.texts0, total.texts1) if total else (0, 0)
    if not n0 or not n1:
        return Model({}, prior=n1 / (n0 + n1) if n0 + n1 else 0.0)
    clear = []
    for term, r in counted.items():
        p0, p1 = (r.texts0 + 0.5) / (n0 + 1), (r.texts1 + 0.5) / (n1 + 1)
        z = (p1 - p0) / math.sqrt(p0 * (1 - p0) / n1 + p1 * (1 - p1) / n1)
        lift = math.log((r.words1 + 0.5) / (total.words1 + 1)) - math.log((r.words0 + 0.5) / (total.words0 + 1))
        if z > 4 and lift > 1:
            clear.append((z, term, lift))
    weights = lexicon({term: lift for _, term, lift in sorted(clear, key=lambda x: (-x[0], x[1]))[:max_terms]})
    model = Model(weights, exceptions)
    phrases = texts.mapInPandas(_phrases(model), "phrase string, texts0 long, texts1 long").groupBy("phrase")
    harmless = phrases.agg(F.sum("texts0").alias("n0"), F.sum("texts1").alias("n1")).where("n1 = 0 and n0 >= 5")
    learned = [r.phrase for r in harmless.orderBy(F.desc("n0"), "phrase").limit(max_terms).collect()]
    model = Model(weights, (*exceptions, *sorted(learned)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["toxic"], "x": [model.features(t) for t in b["text"]]})

    # In the order of their values: the fit does not depend on how the rows were dealt.
    got = sorted((r.y, *r.x) for r in texts.mapInPandas(rows, "y int, x array<double>").collect())
    y, x = np.array([r[0] for r in got], float), np.array([r[1:] for r in got], float)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    curve = _logistic(np.c_[(x - mean) / scale, np.ones(len(x))], y)
    return Model(weights, model.exceptions, tuple(mean), tuple(scale), tuple(curve), float(y.mean()))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is at least 0.5) of each whole text.

    Null texts are scored as empty ones. Columns named like the added ones are replaced; no row is dropped.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([model.score(t) for t in part], dtype="float64")

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
