"""Two tokenizers over the same texts, and how their tokens lie on each other. A small helper without Spark."""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Words whose tokens a worker remembers; beyond that it starts anew.
CACHED_WORDS = 400_000
#: Longer words aren't remembered.
LONG_WORD = 64


@dataclass(frozen=True)
class Coder:
    """A tokenizer that encodes a space and a text, for many texts at once, and the bytes of each of its tokens."""

    encode: Callable[[list[str]], list[Sequence[int]]]
    tokens: list[bytes]


def byte_level_coder(ranks_file: str, pattern: str) -> Coder:
    """A byte-level vocabulary as ranks. Names of special tokens in a text are plain text."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return Coder(lambda texts: [encode(" " + t) for t in texts], tokens)


def piece_coder(model_file: str) -> Coder:
    """A sentencepiece model that adds a space itself. No piece may have a space within or after other
    characters, so that a single space between other characters is a place to cut."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if piece.strip("▁") and "▁" in piece[1:]:
            raise ValueError(f"piece {piece!r} has a space after other characters")
        tokens.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Coder(lambda texts: model.encode(texts, num_threads=1), tokens)


def words_of(text: str) -> list[str]:
    """The text cut at every single space between two characters that aren't white space."""
    out: list[str] = []
    joined: list[str] = []
    for word in text.split(" "):
        if not joined:
            joined = [word]
        elif word and not word[0].isspace() and joined[-1] and not joined[-1][-1].isspace():
            out.append(" ".join(joined))
            joined = [word]
        else:
            joined.append(word)
    out.append(" ".join(joined))
    return out


class _Side:
    def __init__(self, coder: Coder):
        self.coder = coder
        self.sizes = np.array([len(t) for t in coder.tokens], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def add(self, words: list[str]) -> list[bool]:
        """Remember the tokens of words; for each whether they spell a space and the word."""
        found = self.coder.encode(words)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), np.int32, int(counts.sum()))
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        spell = self.coder.tokens.__getitem__
        return [b"".join(map(spell, f)) == b" " + w.encode() for w, f in zip(words, found)]

    def of(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the tokens of all words, their ends in bytes, and the first token of each text."""
        first, counts = self.first[words], self.first[words + 1] - self.first[words]
        last = np.cumsum(counts)
        ids = self.ids[np.arange(last[-1] if len(last) else 0) + np.repeat(first - last + counts, counts)]
        return ids, np.cumsum(self.sizes[ids]), np.concatenate([[0], last])[ends]


@dataclass(frozen=True)
class Aligned:
    """Tokens of some texts one after the other, and what lies on what. `rows_*` are the offsets of texts in the arrays;
    `group_*` is the number of a token's group among all groups of these texts."""

    a: np.ndarray
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    rows_a: np.ndarray
    rows_b: np.ndarray
    overlaps: np.ndarray  # per text
    link_a: np.ndarray
    link_b: np.ndarray
    rows_links: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    rows_groups: np.ndarray


class TokenPair:
    """Encodes texts with two tokenizers and aligns the tokens by bytes."""

    def __init__(self, a: Coder, b: Coder, cached: int = CACHED_WORDS):
        self.sides = _Side(a), _Side(b)
        self.cached = cached
        self.known: dict[str, int] = {}
        self.spelled: list[bool] = []

    def _words(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the remembered words of all texts and the offsets of the texts; those without tokens have none."""
        if len(self.spelled) > self.cached:
            self.known, self.spelled = {}, []
            for side in self.sides:
                side.clear()
        known = self.known
        cut = [words_of(t) if t else [] for t in texts]
        new = list(dict.fromkeys(w for words in cut for w in words if w not in known))
        if new:
            known.update(zip(new, range(len(self.spelled), len(self.spelled) + len(new))))
            spelled = [side.add(new) for side in self.sides]
            self.spelled += [x and y for x, y in zip(*spelled)]
        get, spelled_all = known.__getitem__, np.array(self.spelled, bool)
        numbers = [np.fromiter(map(get, words), np.int64, len(words)) for words in cut]
        numbers = [n if spelled_all[n].all() else n[:0] for n in numbers]
        for word in new:
            if len(word) > LONG_WORD:
                del known[word]
        ends = np.cumsum([0, *map(len, numbers)])
        return (np.concatenate(numbers) if numbers else np.zeros(0, np.int64)), ends

    def align(self, texts: Sequence[str | None]) -> Aligned:
        words, ends = self._words(texts)
        (a, ends_a, rows_a), (b, ends_b, rows_b) = (side.of(words, ends) for side in self.sides)
        n = len(texts)
        doc_a, doc_b = np.repeat(np.arange(n), np.diff(rows_a)), np.repeat(np.arange(n), np.diff(rows_b))
        start_a, start_b = ends_a - self.sides[0].sizes[a], ends_b - self.sides[1].sizes[b]
        left = pd.DataFrame({"at": start_a, "doc": doc_a, "token": np.arange(len(a))})
        right = pd.DataFrame({"at": start_b, "doc": doc_b, "token": np.arange(len(b))})
        # The token of the other side that covers a token's start; texts have tokens of both sides or none.
        over_a = pd.merge_asof(left, right, on="at", by="doc")["token_y"].to_numpy(np.int64)
        over_b = pd.merge_asof(right, left, on="at", by="doc")["token_y"].to_numpy(np.int64)
        # Union: a pair that starts together was found from both sides.
        later = np.flatnonzero(start_a[over_b] < start_b)
        overlaps = np.diff(rows_a) + np.bincount(doc_b[later], minlength=n)
        one, two = np.flatnonzero(ends_b[over_a] == ends_a), later[ends_a[over_b[later]] == ends_b[later]]
        link_a, link_b = np.concatenate([one, over_b[two]]), np.concatenate([over_a[one], two])
        order = np.argsort(ends_a[link_a], kind="stable")
        link_a, link_b = link_a[order], link_b[order]
        cuts = ends_a[link_a]
        if len(cuts) and (np.diff(cuts) <= 0).any():
            raise ValueError("a tokenizer has tokens without bytes")
        rows_links = np.searchsorted(link_a, rows_a)
        return Aligned(
            a, b, ends_a, ends_b, rows_a, rows_b, overlaps, link_a, link_b, rows_links,
            np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), rows_links,
        )


def group_texts(al: Aligned) -> list[bytes]:
    """Per text its groups as `a1,a2|b1;a3|b2,b3`."""
    n_groups = len(al.link_a)
    # Places of tokens when a group's tokens of one side are followed by those of the other.
    before_b = np.searchsorted(al.group_b, np.arange(n_groups + 1))
    before_a = np.searchsorted(al.group_a, np.arange(n_groups + 1))
    ids = np.zeros(len(al.a) + len(al.b), np.int64)
    marks = np.full(len(ids), ord(","), np.uint8)
    at_a = np.arange(len(al.a)) + before_b[al.group_a]
    at_b = np.arange(len(al.b)) + before_a[al.group_b + 1] if len(al.b) else np.zeros(0, np.int64)
    ids[at_a], ids[at_b] = al.a, al.b
    marks[at_a[al.link_a]], marks[at_b[al.link_b]] = ord("|"), ord(";")
    width = len(str(int(ids.max()))) if len(ids) else 1
    out = np.empty((len(ids), width + 1), np.uint8)
    used = np.ones((len(ids), width + 1), bool)
    rest = ids.astype(np.int32)
    for k in range(width - 1, -1, -1):
        used[:, k] = (rest > 0) | (k == width - 1)
        rest, digit = np.divmod(rest, 10)
        out[:, k] = digit + 48
    out[:, width] = marks
    joined = out[used].tobytes()
    lengths = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    tokens = al.rows_a + al.rows_b
    return [joined[x : y - 1] if y > x else b"" for x, y in zip(lengths[tokens[:-1]], lengths[tokens[1:]])]
