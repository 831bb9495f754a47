"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A batch of texts is cut at white space into words; the words not met before are laid end
to end as one flat symbol array. Each round looks up every adjacent pair, takes the best
rank per word by a segmented minimum, merges the leftmost such pair of every word at once
(all of them where the merged piece cannot enable a better pair, so that order cannot
matter), and compacts the arrays; words without a pair leave. The rounds end when no word
is left. Finished words are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NEVER = np.int64(1) << 40
CACHE_WORDS = 200_000
SEGMENT_CHARS = 1 << 20


class PieceModel:
    """Vocabulary tables of a SentencePiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only BPE models with identity normalisation are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        self.kind = np.array([p.type for p in proto.pieces])
        self.n = len(self.names)
        self.unk = int(np.flatnonzero(self.kind == 2)[0])
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unk_surface = proto.trainer_spec.unk_surface or " ⁇ "
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        scores = np.array([p.score for p in proto.pieces], np.float64)
        order = {s: r for r, s in enumerate(sorted(set(scores[list(normal.values())]), reverse=True))}
        # Symbols: pieces first, then characters that occur in pieces without being one, then "any other".
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbol[c] = self.n + len(symbol) - len(normal)
        self.other = self.n + len(symbol) - len(normal)
        self.char_symbol = np.full(0x110000, self.other, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char_symbol[ord(p)] = i
        base = self.base = self.other + 1
        pairs = [
            (symbol[p[:k]] * base + symbol[p[k:]], i, order[scores[i]])
            for p, i in normal.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.pair, self.merged, self.rank = (np.ascontiguousarray(table[:, i]) for i in range(3))
        # A merge is orderless when every pair its result takes part in ranks strictly behind it.
        own = np.full(base, NEVER)
        own[self.merged] = self.rank
        best = np.full(base, NEVER)
        np.minimum.at(best, self.pair // base, self.rank)
        np.minimum.at(best, self.pair % base, self.rank)
        self.orderless = best > own
        several = [p for p in normal if len(p) > 1]
        self.space_leads = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in several)
        self.newline_alone = not any("\n" in p for p in several)
        if not self.space_leads:
            raise ValueError("pieces that go on over white space are not supported")
        self.text_of = [str(i) for i in range(self.n)]
        self.bytes_of = [
            bytes([self.byte_of[i]]) if k == 6 else b"" if k == 3 else self.unk_surface.encode() if k == 2
            else p.replace(SPACE, " ").encode()
            for i, (p, k) in enumerate(zip(self.names, self.kind.tolist(), strict=True))
        ]
        self.words: dict[str, tuple[int, ...]] = {}

    # -- encoding ---------------------------------------------------------------------

    def merge_rounds(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each (non-empty, already escaped) word."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.char_symbol[flat].astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        char = np.arange(len(flat))
        rank, into = np.full(len(sym), NEVER), np.zeros(len(sym), np.int64)
        self.look_up(np.arange(len(sym)), sym, word, rank, into)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(first, len(sym)))
            low = np.repeat(np.minimum.reduceat(rank, first), length)
            over = low == NEVER
            if over.any():
                done.append((word[over], sym[over], char[over]))
                stay = ~over
                sym, word, char, rank, into, low = (x[stay] for x in (sym, word, char, rank, into, low))
                if not len(sym):
                    break
            best = np.flatnonzero(rank == low)
            owner = word[best]
            leftmost = np.concatenate(([True], owner[1:] != owner[:-1]))
            run = np.concatenate(([True], (np.diff(best) != 1) | leftmost[1:]))
            run_start = np.maximum.accumulate(np.where(run, best, 0))
            take = best[leftmost | (self.orderless_words(best, into, leftmost) & ((best - run_start) % 2 == 0))]
            sym[take] = into[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, word, char, rank, into = (x[keep] for x in (sym, word, char, rank, into))
            at = take - np.arange(len(take))  # where the merged symbols stand now
            self.look_up(np.concatenate((at, at[at > 0] - 1)), sym, word, rank, into)
        if not done:
            return []
        word, sym, char = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((char, word))
        word, sym, char = word[order], sym[order], char[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words)))
        ids, bounds = sym.tolist(), [0, *ends.tolist()]
        spans = list(zip(bounds, bounds[1:], strict=False))
        if (sym < self.n).all():
            return [tuple(ids[a:b]) for a, b in spans]
        out = []
        for a, b in spans:
            got: list[int] = []
            for i, s in zip(char[a:b].tolist(), ids[a:b], strict=True):
                got += [s] if s < self.n else self.fallback(chr(flat[i]))
            out.append(tuple(got))
        return out

    def look_up(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, into: np.ndarray) -> None:
        """Refresh rank and result of the pairs that start at ``at``."""
        rank[at] = NEVER
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        if not len(at) or not len(self.pair):
            return
        key = sym[at] * self.base + sym[at + 1]
        found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[found] == key
        rank[at[hit]], into[at[hit]] = self.rank[found[hit]], self.merged[found[hit]]

    def orderless_words(self, best: np.ndarray, into: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
        """For each best pair: whether all best pairs of its word merge into orderless pieces."""
        fine = self.orderless[into[best]]
        start = np.flatnonzero(leftmost)
        return np.repeat(np.logical_and.reduceat(fine, start), np.diff(np.append(start, len(best))))

    def fallback(self, c: str) -> list[int]:
        if not self.byte_id:
            return [self.unk]
        return [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]

    def split(self, text: str, lead: bool) -> list[str]:
        """Words no piece reaches across, escaped; ``lead``: the text starts the document."""
        plain = SPACE not in text and self.newline_alone
        if plain:
            parts = text.replace("\n", " \n").split(" ")
            if "" not in parts and (lead and self.dummy_prefix):
                return [p if p[0] == "\n" else SPACE + p for p in parts]
        escaped = (SPACE if lead and self.dummy_prefix else "") + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", escaped)

    def learn(self, words: set[str]) -> None:
        """Encode the words that the bounded table lacks."""
        missing = [w for w in words if w not in self.words]
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        for a in range(0, len(missing), 50_000):
            part = missing[a : a + 50_000]
            self.words.update(zip(part, self.merge_rounds(part), strict=True))

    def segments(self, text: str, size: int = SEGMENT_CHARS) -> Iterator[list[str]]:
        """Words of the text, a bounded stretch at a time; cuts stand before single spaces."""
        at, lead = 0, True
        while at < len(text):
            end = at + size
            while 0 < end < len(text):
                end = text.find(" ", end)
                if end < 0 or text[end - 1] not in (" ", SPACE):
                    break
                end += 1
            end = len(text) if end < 0 or end > len(text) else end
            yield self.split(text[at:end], lead)
            at, lead = end, False

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words in self.segments(text):
            known = set(words)
            self.learn(known)
            out += chain.from_iterable(self.words[w] if w in self.words else self.merge_rounds([w])[0] for w in words)
        return out

    # -- decoding ---------------------------------------------------------------------

    def decode(self, ids: Iterable[int], lead: bool = True) -> str:
        """Text of the ids: white space restored, the dummy prefix dropped, byte pieces joined to
        characters, bytes that form none replaced one by one."""
        ids = list(ids)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != 3), None) if lead else None
        drop = bool(self.dummy_prefix and first is not None and self.names[first].startswith(SPACE))
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "single_byte_replacement")
        return text[1:] if drop else text


def _one_by_one(error: UnicodeDecodeError):
    return ("�", error.start + 1)


def _register() -> None:
    import codecs

    codecs.register_error("single_byte_replacement", _one_by_one)


_register()


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def digest_texts(model: PieceModel, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
    """(number of ids, SHA-256 of the joined ids, SHA-256 of the decoded text) per text."""
    texts = [t or "" for t in texts]
    split = [model.split(t, True) if t and len(t) <= SEGMENT_CHARS else None for t in texts]
    seen: set[str] = set()
    seen.update(*filter(None, split))
    model.learn(seen)
    for t, own in zip(texts, split, strict=True):
        count, ids_hash, text_hash, lead = 0, hashlib.sha256(), hashlib.sha256(), True
        for words in [own] if own else model.segments(t):
            if not own:
                model.learn(set(words))
            try:
                ids = list(chain.from_iterable(map(model.words.__getitem__, words)))
            except KeyError:  # the table was emptied meanwhile
                model.learn(set(words))
                ids = list(chain.from_iterable(map(model.words.__getitem__, words)))
            ids_hash.update(((b"" if lead else b",") + ",".join(map(model.text_of.__getitem__, ids)).encode()) if ids else b"")
            text_hash.update(model.decode(ids, lead).encode("utf-8", "surrogatepass"))
            count, lead = count + len(ids), False
        yield count, ids_hash.hexdigest(), text_hash.hexdigest()


def bounded_lists(texts: Iterable[str | None], chars: int = 2 * SEGMENT_CHARS) -> Iterator[list[str | None]]:
    """The texts in order, in lists of bounded total length (or of one text)."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, model_path: str, *, text_col: str = "text", into: str = "pieces") -> DataFrame:
    """``docs`` with a struct column ``into`` of the token count and the two digests.

    Null texts count as empty (no ids). Rows are independent: repeated rows repeat, an
    empty table stays empty. A column named ``into`` is replaced, others are kept. The model file must lie at ``model_path`` on every executor.
    """

    @F.pandas_udf(SCHEMA)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for texts in batches:
            rows = [r for part in bounded_lists(texts) for r in digest_texts(model, part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(into, digests(docs[text_col]))


def encode_column(docs: DataFrame, model_path: str, *, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids themselves in ``into`` (null text: no ids)."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(model_path)
        for texts in batches:
            yield pd.Series([model.encode(t or "") for t in texts], dtype=object)

    return docs.withColumn(into, ids(docs[text_col]))


def decode_column(tokens: DataFrame, model_path: str, *, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``tokens`` with the decoded text in ``into`` (null ids: empty text)."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load(model_path)
        for lists in batches:
            yield pd.Series([model.decode(i if i is not None else ()) for i in lists], dtype=object)

    return tokens.withColumn(into, text(tokens[ids_col]))
