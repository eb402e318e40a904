"""Operator 2: toxicity by a weighted lexicon, learnt from labelled documents.

Texts are folded first: lower case, look-alike letters to Latin ones, and digits and signs to
the letters they stand for. The lexicon holds folded words and word beginnings with
log-odds weights, learnt from labelled documents; one Aho-Corasick automaton finds all of
them, and the exception phrases (an entry with its neighbours, as clean documents use it)
whose matches don't count. The weights of the matches, by themselves and for the text's length, are
turned into a score by a logistic curve fitted on the same documents.

Learning reads a bounded sample of labelled documents (Learning.toxic_docs and clean_docs are the
bounds; of a text over max_chars it reads stretches of `stretch` characters, evenly spaced over the whole);
scoring reads every whole text. Only the text of a document counts for its score.

Defined results: a null or empty text has no match and gets the score of no match; a
document whose labels conflict is toxic to learning, and of several texts of one doc_id it reads the
least; documents without labels are only scored; without labels of both kinds the lexicon is empty and every score is the
curve's value without matches; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fingerprints import sub_batches

# Signs to the letters that they stand for or look like.
_FOLDS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ℓ": "i", "ɑ": "a", "ɡ": "g",
}
FOLD = str.maketrans(_FOLDS | {chr(0xFF41 + k): _FOLDS.get(chr(97 + k), chr(97 + k)) for k in range(26)} | dict.fromkeys("\u200b\u200c\u200d\xad", ""))
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


@dataclass(frozen=True)
class Learning:
    """Bounds of the sample, and what an entry needs: support in toxic documents, log-odds, and a
    share of the toxic documents that fewer than `covers` earlier entries are in."""

    toxic_docs: int = 1500
    clean_docs: int = 4500
    max_chars: int = 8000
    stretch: int = 200
    beginnings: tuple[int, int] = (4, 8)
    min_support: int = 5
    min_log_odds: float = 3.0
    covers: int = 4
    least_share: float = 0.005
    max_entries: int = 2000
    cut: float = 0.7


@dataclass
class Lexicon:
    """entries: folded text to (weight, whole word). curve: intercept, matches, matches for the length."""

    entries: dict[str, tuple[float, bool]] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)


class Matcher:
    """One automaton over entries and exceptions."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, None
        if lexicon.entries:
            self.automaton = ahocorasick.Automaton()
            for key, (weight, whole) in lexicon.entries.items():
                self.automaton.add_word(key, (len(key), weight, whole))
            for phrase in lexicon.exceptions:
                self.automaton.add_word(phrase, (len(phrase), None, True))
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries that stand as words or word beginnings, outside exceptions."""
        if self.automaton is None:
            return []
        found, excepted = [], []
        for last, (size, weight, whole) in self.automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if (start and folded[start - 1].isalnum()) or (whole and end < len(folded) and folded[end].isalnum()):
                continue
            (excepted if weight is None else found).append((start, end, weight))
        excepted.sort(key=lambda x: x[0])
        starts, furthest = [s for s, _, _ in excepted], list(accumulate((e for _, e, _ in excepted), max))
        best: dict[int, tuple[int, int, float]] = {}
        for m in found:  # entries that begin alike count once, with the largest weight
            within = bisect_right(starts, m[0])
            if not (within and furthest[within - 1] >= m[1]) and (m[0] not in best or best[m[0]][2] < m[2]):
                best[m[0]] = m
        return list(best.values())

    def inputs(self, text: str) -> tuple[float, float]:
        """The weight of all matches, and that weight for the length of the text in words."""
        total = sum(w for _, _, w in self.matches(fold(text)))
        if not total:
            return 0.0, 0.0
        words = 1 + text.count(" ")
        return math.log1p(total), math.log1p(100 * total / (words + 20))

    def score(self, text: str) -> float:
        a, b, c = self.lexicon.curve
        x, y = self.inputs(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x + c * y))))


def features(text: str, beginnings: tuple[int, int]) -> set[tuple[str, bool]]:
    """The folded words of a text, and their beginnings of the given lengths."""
    low, high = beginnings
    words = set(_WORD.findall(fold(text)))
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in range(low, min(high, len(w) - 1) + 1)}


def learn(toxic: list[str], clean: list[str], p: Learning = Learning()) -> Lexicon:
    """Entries chosen greedily, each for the toxic documents that few earlier ones cover."""
    toxic = list(dict.fromkeys(toxic))  # copies would pass for support
    if not toxic or not clean:
        return Lexicon()
    holders: dict[tuple[str, bool], list[int]] = {}
    for i, text in enumerate(toxic):
        for f in features(text, p.beginnings):
            holders.setdefault(f, []).append(i)
    holders = {f: h for f, h in holders.items() if len(h) >= min(p.min_support, max(1, len(toxic) // 20))}
    in_clean: Counter = Counter()
    for text in clean:
        in_clean.update(f for f in features(text, p.beginnings) if f in holders)
    odds = {f: math.log((len(h) + 0.5) / (len(toxic) + 1)) - math.log((in_clean[f] + 0.5) / (len(clean) + 1)) for f, h in holders.items()}
    left = {f: set(h) for f, h in holders.items() if odds[f] >= p.min_log_odds}
    need, least = [p.covers] * len(toxic), max(min(3, len(toxic)), math.ceil(p.least_share * len(toxic)))
    entries: dict[str, tuple[float, bool]] = {}
    while left and len(entries) < p.max_entries:
        # most newly covered, by weight; then the longer, and a whole word
        f = max(left, key=lambda f: (len(left[f]) * odds[f], len(f[0]), f[1], f[0]))
        new = left.pop(f)
        if len(new) < least:
            break
        entries[f[0]] = (odds[f], f[1])
        for i in new:
            need[i] -= 1
        done = {i for i in new if not need[i]}
        # what begins an entry, or begins with it, is the same evidence
        left = {g: h - done for g, h in left.items() if not g[0].startswith(f[0]) and not f[0].startswith(g[0])}
    lexicon = Lexicon(entries)
    # exceptions: phrases around an entry that several clean documents have and no toxic one
    matcher = Matcher(lexicon)
    around = lambda texts: Counter(x for t in texts for x in set(_phrases(matcher, t)))
    in_toxic = around(toxic)
    lexicon.exceptions = {x for x, n in around(clean).items() if n >= 3 and not in_toxic[x]}
    lexicon.curve = _fit(Matcher(lexicon), toxic, clean)
    return lexicon


def _phrases(matcher: Matcher, text: str) -> list[str]:
    folded, out = fold(text), []
    for start, end, _ in matcher.matches(folded):
        while end < len(folded) and folded[end].isalnum():
            end += 1
        before, after = re.search(r"[^\W_]+\W+$", folded[max(0, start - 40) : start]), re.match(r"\W+[^\W_]+", folded[end : end + 40])
        out += [folded[start - len(before[0]) : end]] if before else []
        out += [folded[start : end + len(after[0])]] if after else []
    return out


def _fit(matcher: Matcher, toxic: list[str], clean: list[str]) -> tuple[float, float, float]:
    """A logistic curve by Newton's method, with both kinds weighed alike and a ridge."""
    x = np.array([(1.0, *matcher.inputs(t)) for t in [*toxic, *clean]])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    each = np.where(y == 1, 0.5 / len(toxic), 0.5 / len(clean)) * 1000
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.1, x.T @ (each * (y - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id):
    """Whether the crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, p: Learning = Learning()) -> Lexicon:
    """The lexicon of a bounded sample: the first labelled documents in the order of a hash."""
    order = F.xxhash64(F.lit(11), F.col("label_id"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    sample = known.filter("toxic = 1").orderBy(order, "label_id").limit(p.toxic_docs).union(known.filter("toxic = 0").orderBy(order, "label_id").limit(p.clean_docs))
    pieces, n = p.max_chars // p.stretch, F.length("text")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(F.col("text"), F.floor(i * n / pieces).cast("int") + 1, F.lit(p.stretch)))
    read = F.when(n <= p.max_chars, F.col("text")).otherwise(F.array_join(spaced, " "))
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", read.alias("text"), "toxic")
    found = sorted(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect(), key=lambda r: r["doc_id"])  # toxic_docs + clean_docs rows at most
    return learn([r["text"] for r in found if r["toxic"] == 1], [r["text"] for r in found if r["toxic"] == 0], p)


def score(docs: DataFrame, lexicon: Lexicon, p: Learning = Learning(), score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """All columns of docs with the score and the prediction; columns of these names are replaced."""
    docs = docs.drop(score_name, predicted_name)
    columns = docs.columns
    at = columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # max_entries entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in sub_batches(batches, columns[at]):
            scores = [matcher.score(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, score_name])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_name, T.DoubleType())])
    return docs.mapInArrow(run, schema).withColumn(predicted_name, F.when(F.col(score_name) >= p.cut, 1).otherwise(0))


def reject(docs: DataFrame, labels: DataFrame, p: Learning = Learning()) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    scored = score(docs, learn_from(docs, labels, p), p, "__score", "__toxic")
    return scored.filter("__toxic = 0").drop("__score", "__toxic")
