"""Token counts by offset-mapped attribution.

A whole document is encoded once. Token ends are running sums of the tokens' byte lengths,
mapped to character positions; the sorted section starts are searched for each token's
first and last character, which is the interval join. A token inside one section counts
there; a token across a boundary is allocated by a rule:

* ``start``: to the section of its first character,
* ``end``: to the section of its last character,
* ``majority``: to the section that holds most of its characters, the earliest among equals.

Every token counts exactly once, so section counts add up to the document's. A character
that several tokens share (bytes of one character) belongs to each of those tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "end", "majority")
ROWS_AT_ONCE = 50_000


class Encoder:
    """A rank-file byte-level BPE and the byte length of each of its tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and character after the last one of every token."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        if text.isascii() or not len(ids):
            return starts, ends
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def line_starts(text: str) -> np.ndarray:
    """Starts of the lines; a line break belongs to the line it ends."""
    out, at = [0], text.find("\n") + 1
    while at and at < len(text):
        out.append(at)
        at = text.find("\n", at) + 1
    return np.array(out, np.int64)


def allocate(first: np.ndarray, after: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens allocated, crossing tokens that touch) per section.

    ``bounds`` holds the sorted section starts and the end of the text; an empty section
    gets no token.
    """
    n = len(bounds) - 1
    a = np.searchsorted(bounds[:-1], first, side="right") - 1
    b = np.searchsorted(bounds[:-1], after - 1, side="right") - 1
    owner = b.copy() if rule == "end" else a.copy()
    across = np.flatnonzero(a != b)
    touched = np.zeros(n, np.int64)
    if len(across):
        length = b[across] - a[across] + 1
        token = np.repeat(across, length)
        section = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + a[token]
        overlap = np.minimum(after[token], bounds[section + 1]) - np.maximum(first[token], bounds[section])
        touched += np.bincount(section[overlap > 0], minlength=n)
        if rule == "majority":
            order = np.lexsort((section, -overlap, token))
            lead = np.concatenate(([True], token[order][1:] != token[order][:-1]))
            owner[token[order][lead]] = section[order][lead]
    return np.bincount(owner, minlength=n), touched


FIELDS = ("section", "char_start", "char_end", "n_tokens", "n_crossing")


def count_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_cols: Sequence[str] = ("text",),
    lines: bool = True,
    rule: str = "majority",
) -> DataFrame:
    """One row per document and section: ``id_col, section, char_start, char_end, n_tokens, n_crossing``.

    With ``lines`` the sections are the lines of the text; without, they are the fields in
    ``text_cols``, joined by line breaks (a break belongs to the field before it). Null
    texts count as empty; a document without characters has one empty section (or one per
    field). Rows are independent: repeated rows and null ids repeat; an empty table stays
    empty. ``n_crossing`` counts tokens across a boundary that touch the section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [f"t{i}" for i in range(len(text_cols))]
    # Ids travel as text: pandas would turn whole numbers beside nulls into floats.
    frame = docs.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).alias(n) for c, n in zip(text_cols, names, strict=True)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load(ranks_path, pattern)
        held: list[tuple] = []
        rows = 0
        for pdf in batches:
            for key, *texts in pdf[["id", *names]].itertuples(index=False, name=None):
                texts = [t if isinstance(t, str) else "" for t in texts]
                text = "\n".join(texts)
                if lines:
                    starts = line_starts(text)
                else:
                    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[:-1]]))).astype(np.int64)
                bounds = np.append(starts, len(text))
                tokens, touched = allocate(*encoder.spans(text), bounds, rule)
                held.append((key, bounds, tokens, touched))
                rows += len(starts)
                if rows >= ROWS_AT_ONCE:
                    yield assemble(held)
                    held, rows = [], 0
        if held:
            yield assemble(held)

    kind = docs.select(id_col).schema[0].dataType
    out = frame.mapInPandas(count, "id string, section long, char_start long, char_end long, n_tokens long, n_crossing long")
    return out.select(F.col("id").cast(kind).alias(id_col), *FIELDS)


def assemble(held: list[tuple]) -> pd.DataFrame:
    keys, bounds, tokens, touched = zip(*held, strict=True)
    sizes = [len(t) for t in tokens]
    key = pd.Series(keys, dtype=object)
    return pd.DataFrame(
        {
            "id": key.repeat(sizes).reset_index(drop=True),
            "section": np.concatenate([np.arange(n) for n in sizes]),
            "char_start": np.concatenate([b[:-1] for b in bounds]),
            "char_end": np.concatenate([b[1:] for b in bounds]),
            "n_tokens": np.concatenate(tokens),
            "n_crossing": np.concatenate(touched),
        }
    )
