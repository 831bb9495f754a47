"""Toxicity: noisy-channel deobfuscation, then a score of the restored words.

1. A character trigram model is counted over every word of every document.
2. A stretch of text spans a lattice: each character may stand for itself, for the letters it
   imitates, for a separator, or for one more repetition, and a blank for a word edge or for
   a separator. Viterbi over the last two emitted letters finds the likeliest intended words.
   A token of letters without a doubled one has a single path and stands as it is, and so does
   one without letters. Blanks enter where letters run on over them: in runs of single
   characters, and wherever the text without its blanks spells a strong entry across one.
3. Evidence of a word is the best smoothed log odds among the word and its prefixes, learnt
   from labelled documents; words count as typed and as restored.
4. Two document features, the strongest evidence and the sum of strong evidence, go through
   a logistic function that is fitted on the other half of the labelled sample.

The fit reads at most ``max_fit_rows`` labelled rows, those with the smallest id hashes;
rows of one near-copy group count once. Entries whose odds speak for the label are all kept:
their number is bounded by the words of those rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import crc_mod, fresh, sigmoid
from trackledger.llm.quality import pick_labels

MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
STRONG = 2.0
CACHE_TOKENS = 150_000
#: Letters that a character commonly imitates.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
COST_IMITATE, COST_SEPARATOR, COST_REPEAT, COST_LONE_SEPARATOR, COST_BLANK = 1.0, 1.5, 0.5, 6.0, 1.5

#: Classes of the character model: 0 word edge, then letters; digits and the rest share one each.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöùúûüýÿœß"
SYMBOLS = 64
DIGIT, OTHER = 62, 63
CLASS_OF = np.full(0x110000, OTHER, np.uint8)
for _i, _c in enumerate(LETTERS):
    CLASS_OF[ord(_c)] = _i + 1
CLASS_OF[ord("0") : ord("9") + 1] = DIGIT
for _c in " \t\n\r\x0b\x0c":
    CLASS_OF[ord(_c)] = 0

#: Runs of four or more single characters between blanks.
_SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
_REPEAT = re.compile(r"(.)\1+")
_WORD = re.compile(r"[^\W\d_]+")


def trigram_counts(text: str) -> np.ndarray:
    """Counts of class trigrams in the text, word edges included."""
    codes = CLASS_OF[np.frombuffer(f"  {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
    edge = codes == 0
    keep = np.ones(len(codes), bool)
    keep[2:] = ~(edge[2:] & edge[1:-1] & edge[:-2])
    codes = codes[keep]
    return np.bincount(codes[:-2] * (SYMBOLS * SYMBOLS) + codes[1:-1] * SYMBOLS + codes[2:], minlength=SYMBOLS**3)


def count_trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Corpus counts over all documents; at most 64**3 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for pdf in batches:
            held: list[str] = []
            size = 0
            for t in pdf["t"]:
                if t:
                    held.append(t)
                    size += len(t)
                if size > 1 << 20:
                    total += trigram_counts("  ".join(held))
                    held, size = [], 0
            if held:
                total += trigram_counts("  ".join(held))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    parts = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "at long, n long")
    total = np.zeros(SYMBOLS**3, np.float64)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["at"]] = r["n"]
    return total


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with the bigram and the uniform distribution."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2 = c3.sum(axis=0)
    p2 = (c2 + 0.5) / (c2.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def options(c: str, inner: bool) -> list[tuple[str, float]]:
    """What an observed character may stand for, with the channel cost; "" is a separator."""
    if c.isalpha():
        return [(c, 0.0)]
    if c.isspace():
        return [(" ", 0.0), ("", COST_BLANK)]
    out = [(x, COST_IMITATE) for x in LOOKALIKES.get(c, "")]
    return [*out, ("", COST_SEPARATOR if inner or not out else COST_LONE_SEPARATOR)]


def viterbi(token: str, cost: np.ndarray) -> str:
    """Likeliest intended words, blanks between them, of a stretch of text under the model ``cost``."""
    state: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last = len(token) - 1
    for i, c in enumerate(token):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(key, value, path, nxt=nxt):
            if key not in nxt or value < nxt[key][0]:
                nxt[key] = (value, path)

        choices = options(c, 0 < i < last)
        again = i and token[i - 1] == c and c.isalpha()
        for (a, b), (value, path) in state.items():
            for letter, channel in choices:
                if not letter:
                    offer((a, b), value + channel, path)
                    continue
                k = int(CLASS_OF[ord(letter)])
                offer((b, k), value + channel + float(cost[a, b, k]), (letter, path))
                if again and b == k:
                    offer((a, b), value + COST_REPEAT, path)
        state = nxt
    best = min(state.items(), key=lambda kv: kv[1][0] + float(cost[kv[0][0], kv[0][1], 0]))[1][1]
    out = []
    while best is not None:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


def parts_of(token: str) -> list[str]:
    """Letter runs of a lower-case token."""
    return [token] if token.isalpha() else _WORD.findall(token)


def keys_of(word: str) -> list[str]:
    """Entries a word can match: itself and its prefixes of four to seven letters."""
    return ["=" + word, *[word[:n] for n in range(4, min(8, len(word) + 1))]]


def trimmed(token: str) -> str:
    """The token without characters at its ends that can be separators only."""
    a, b = 0, len(token)
    while a < b and not token[a].isalpha() and token[a] not in LOOKALIKES:
        a += 1
    while a < b and not token[b - 1].isalpha() and token[b - 1] not in LOOKALIKES:
        b -= 1
    return token[a:b]


def open_paths(token: str) -> bool:
    """Whether the lattice of a token holds more than one path and some letter as typed."""
    if token.isalpha():
        return _REPEAT.search(token) is not None
    return any(map(str.isalpha, token))


@dataclass
class Restorer:
    """Deobfuscates stretches of text; words as typed always stay candidates."""

    cost: np.ndarray

    def candidates(self, stretch: str) -> list[str]:
        words = parts_of(stretch)
        inner = trimmed(stretch)
        if open_paths(inner):
            words = [*words, *(w for w in viterbi(inner, self.cost).split() if w not in words)]
        return words


def tokens_of(text: str) -> set[str]:
    """Distinct lower-case tokens, and runs of four or more single characters, blanks kept."""
    words = text.lower().split()
    return {*words, *spaced_runs(" ".join(words))}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spaced_runs(low: str) -> list[str]:
    """Runs of four or more single characters in a text with single blanks."""
    blank = code_points(low) == 32
    # Three blanks, each two places after the last, or no run can be there.
    return _SPACED.findall(low) if (blank[:-4] & blank[2:-2] & blank[4:]).any() else []


#: Letters that look alike share a code; repeats and characters without a code are left out.
def alike_codes() -> np.ndarray:
    """Code per code point: 1 to 26 for a letter and what imitates it, 0 for characters to leave out."""
    codes = np.zeros(0x110000, np.uint8)
    for i in range(26):
        codes[ord("a") + i] = i + 1
    for c, letters in LOOKALIKES.items():
        codes[ord(c)] = codes[ord(letters[0])]
    codes[ord("l")] = codes[ord("i")]
    return codes


ALIKE = alike_codes()
GRAM = 4


def grams(codes: np.ndarray) -> np.ndarray:
    """Numbers of the GRAM consecutive codes that begin at each place."""
    n = max(0, len(codes) - GRAM + 1)
    wide = codes.astype(np.int32)
    out = wide[:n].copy()
    for j in range(1, GRAM):
        out <<= 5
        out |= wide[j : j + n]
    return out


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Places of the codes that are neither 0 nor a repetition of the code before."""
    at = np.flatnonzero(codes)
    held = codes[at]
    return at[np.concatenate(([True], held[1:] != held[:-1]))] if len(at) else at


class SplitFinder:
    """Stretches in which a strong entry of four letters or more runs on over a blank."""

    def __init__(self, odds: dict[str, float]):
        words = sorted({k.lstrip("=") for k, v in odds.items() if v >= STRONG})
        self.first = np.zeros(32**GRAM, bool)
        self.words: dict[int, set[bytes]] = {}
        for w in words:
            codes = ALIKE[code_points(w)]
            codes = codes[squeezed(codes)]
            if len(codes) >= GRAM:
                gram = int(grams(codes)[0])
                self.first[gram] = True
                self.words.setdefault(gram, set()).add(codes.tobytes())

    def stretches(self, low: str) -> set[str]:
        """Stretches of a lower-case text whose words stand a single blank apart."""
        codes = ALIKE[code_points(low)]
        at = squeezed(codes)
        packed = codes[at]
        found = set()
        gram = grams(packed)
        for i in np.flatnonzero(self.first[gram]).tolist():
            for word in self.words[int(gram[i])]:
                last = i + len(word) - 1
                if last < len(at) and packed[i : last + 1].tobytes() == word and " " in low[at[i] : at[last]]:
                    a = low.rfind(" ", 0, at[i]) + 1
                    b = low.find(" ", at[last])
                    found.add(low[a : b if b >= 0 else None])
        return found


@dataclass
class ToxicModel:
    cost: np.ndarray
    odds: dict[str, float]
    logit: np.ndarray
    cache: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.finder = SplitFinder(self.odds)
        self.heads = {k.lstrip("=")[:4] for k in self.odds}
        #: Entries with repetitions left out: what a word of letters can be restored to begins with one.
        self.bare = {_REPEAT.sub(r"\1", k.lstrip("=")) for k in self.odds}
        self.lengths = sorted({len(k) for k in self.bare})

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def worth(self, word: str) -> float:
        """Best odds of the entries that the word matches."""
        if word[:4] not in self.heads:
            return 0.0
        return max(0.0, *(self.odds.get(key, 0.0) for key in keys_of(word)))

    def may_reach(self, token: str) -> bool:
        """Whether some path of the token can lead to an entry; only words of letters are ruled out."""
        if not token.isalpha():
            return True
        bare = _REPEAT.sub(r"\1", token)
        return any(bare[:n] in self.bare for n in self.lengths)

    def evidence(self, token: str) -> float:
        best = self.worth(token) if token.isalpha() else max([0.0, *map(self.worth, parts_of(token))])
        inner = trimmed(token)
        if open_paths(inner) and self.may_reach(inner):
            best = max([best, *map(self.worth, viterbi(inner, self.cost).split())])
        return best

    def features(self, text: str | None) -> tuple[float, float]:
        words = (text or "").lower().split()
        low = " ".join(words)
        tokens = {*words, *spaced_runs(low), *self.finder.stretches(low)}
        if len(self.cache) > CACHE_TOKENS:
            self.cache.clear()
        cache = self.cache
        top = strong = 0.0
        for t in tokens:
            e = cache.get(t)
            if e is None:
                e = cache[t] = self.evidence(t)
            if e:
                top = max(top, e)
                if e >= STRONG:
                    strong += e
        return top, math.log1p(strong)

    def score(self, texts) -> np.ndarray:
        x = np.array([(1.0, *self.features(t)) for t in texts]).reshape(-1, 3)
        return sigmoid(x @ self.logit)


def sketch(text: str) -> int:
    """Smallest hash among the five-word shingles: copies and most near copies share it."""
    words = text.lower().split()
    return min(
        (xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))),
    ) >> 1


def count_entries(rows: DataFrame, cost: np.ndarray) -> DataFrame:
    """Documents per entry, label and half: ``(entry, y, half, n)``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(cost)

        def flush(counts: Counter) -> pd.DataFrame:
            keys = list(counts)
            frame = {n: [k[i] for k in keys] for i, n in enumerate(("entry", "y", "half"))}
            return pd.DataFrame(frame | {"n": [counts[k] for k in keys]})

        counts: Counter = Counter()
        for pdf in batches:
            for text, y, half in zip(pdf["text"], pdf["y"], pdf["half"], strict=True):
                found = {k for t in tokens_of(text or "") for w in restorer.candidates(t) for k in keys_of(w)}
                counts.update((k, int(y), int(half)) for k in found)
                if len(counts) > 200_000:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    parts = rows.mapInPandas(count, "entry string, y int, half int, n long")
    return parts.groupBy("entry", "y", "half").agg(F.sum("n").alias("n"))


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps of a ridge logistic regression with an intercept."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str,
    text_col: str,
    label_col: str,
    modulus: int,
    held_out: int,
    max_fit_rows: int,
) -> ToxicModel:
    cost = log_probabilities(count_trigrams(docs, text_col))
    picked = pick_labels(labels, id_col, label_col, crc_mod(F.col(id_col), modulus) == held_out, max_fit_rows)
    sketched = F.pandas_udf(lambda s: pd.Series([sketch(t or "") for t in s], dtype="int64"), "long")
    # Bounded by max_fit_rows, so this side may be broadcast at any input size.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.select("text", "y", sketched("text").alias("sketch")).groupBy("sketch").agg(F.max(F.struct("y", "text"))["text"].alias("text"), F.max("y").alias("y"))
    rows = rows.select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), F.pmod("sketch", F.lit(2)).cast("int").alias("half"))
    rows = rows.persist()
    try:
        counts = count_entries(rows, cost)
        docs_of = {(r["y"], r["half"]): r["count"] for r in rows.groupBy("y", "half").count().collect()}
        wide = counts.groupBy("entry").agg(
            *[F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]
        )
        size = {(y, h): docs_of.get((y, h), 0) for y in (0, 1) for h in (0, 1)}

        def value(halves: tuple[int, ...]) -> Column:
            """Smoothed log odds; entries that few documents bear out weigh less."""
            n0, n1 = (sum(F.col(f"n{y}{h}") for h in halves) for y in (0, 1))
            s0, s1 = (sum(size[y, h] for h in halves) for y in (0, 1))
            odds = F.log((n1 + 0.5) / F.lit(s1 + 1.0)) - F.log((n0 + 0.5) / F.lit(s0 + 1.0))
            return F.when(n1 >= 3, odds * n1 / (n1 + 3.0)).otherwise(0.0)

        valued = wide.select("entry", value((0,)).alias("first"), value((0, 1)).alias("both")).where("first > 0.5 or both > 0.5")
        kept = valued.collect()  # words of at most max_fit_rows documents

        def odds(column: str) -> dict[str, float]:
            return {r["entry"]: r[column] for r in kept if r[column] > 0.5}

        half = ToxicModel(cost, odds("first"), np.zeros(3))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = [half.features(t) for t in pdf["text"]]
                yield pd.DataFrame({"top": [a for a, _ in x], "strong": [b for _, b in x], "y": pdf["y"]})

        got = rows.where("half = 1").select("text", "y").mapInPandas(measure, "top double, strong double, y int").collect()
        got = sorted((r["y"], r["top"], r["strong"]) for r in got)  # equal sums whatever the order of rows
        x = np.array([(1.0, top, strong) for _, top, strong in got]).reshape(-1, 3)
        y = np.array([y for y, *_ in got], float)
        return ToxicModel(cost, odds("both"), fit_logit(x, y))
    finally:
        rows.unpersist()


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 4,
    held_out: int = 2,
    into: str = "score",
    max_fit_rows: int = MAX_FIT_ROWS,
) -> DataFrame:
    """``docs`` with a score in [0, 1] in ``into``: how likely label 1 is.

    Ids whose CRC-32 leaves ``held_out`` modulo ``modulus`` never train. Null and empty
    texts have no evidence and get the lowest score; rows are scored one by one, so repeated
    rows repeat; an empty table stays empty; without labels every score is 0.5. Only the
    named columns are read; a column named ``into`` is replaced.
    """
    model = train(
        docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, modulus=modulus, held_out=held_out,
        max_fit_rows=max_fit_rows,
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 64**3 costs and the entries of the fit rows

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series(model.score(texts), dtype="float64")
        model.cache.clear()  # the worker process goes on to other tasks

    return docs.withColumn(into, score(docs[text_col]))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``docs`` without the rows that score at or over the threshold."""
    score = fresh(docs, "toxicity_score")
    return score_toxicity(docs, labels, into=score, **settings).where(F.col(score) < threshold).drop(score)
