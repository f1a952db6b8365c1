"""Exact, fast use of a byte-level BPE of the tokenizers library inside tasks.

The pre-tokenizer of a byte-level BPE starts a new pre-token at every blank that follows a
character that is no white space, so a text can be cut there and each piece encoded by itself.
Arrow cuts the texts and numbers the distinct pieces of a batch. Every Python worker keeps the ids
of pieces it has seen in arrays with a hash table (bounded), so that only new pieces become Python
strings and only their pre-tokens go to the library's model; the ids of texts are gathered by number.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from staysift.llm.work import forget, once, text_bytes

END_ID = 2
# White space as the pre-tokenizer's pattern knows it.
_WHITE = "\t-\r \x85\xa0  -     　"
# A blank after white space: there the blank is no place to cut.
_UNSAFE = re.compile(f"[{_WHITE}] ")
_PIECES = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
# Only pieces of these characters are split here; letters beyond them are left to the library,
# whose Unicode tables may be of another version.
_PLAIN = re.compile("[\t\n\r -~\xa0-ɏ]*")
# Entries of a table of words; when it is full it becomes the old one, whose entries come back when
# they are met. Words of more bytes are not kept. Entries of the dictionary of pre-tokens.
_KEPT, _WIDTH, _TOKENS = 700_000, 24, 250_000
_ONES = 2**64 - 1
# The bytes of a key that belong to a word, by its length.
_OWN = np.array(
    [[_ONES >> max(0, min(64, 64 - 8 * (n - 8 * i))) if n > 8 * i else 0 for i in range(3)] for n in range(25)], "<u8"
)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs of ``size`` numbers from ``first`` on, one run after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class _Words:
    """Ids of words of at most 24 bytes, which are their own keys: a hash table with open addressing."""

    def __init__(self, most: int):
        self.most, self.n, self.used = most, 0, 0
        self.slots = np.full(1 << (2 * most).bit_length(), -1, np.int32)
        self.keys = np.zeros((most, 3), "<u8")
        self.first, self.size = np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.ids = np.zeros(4 * most, "<u4")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for i in (1, 2):
            h = ((h ^ (h >> np.uint64(32))) + keys[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(31))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not there."""
        found, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = self.slots[slot[left]]
            same = (at >= 0) & (self.keys[at] == keys[left]).all(axis=1)
            found[left[same]] = at[same]
            left = left[(at >= 0) & ~same]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        return found

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return self.ids[_runs(self.first[numbers], size)], size

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Keep new, distinct keys as far as there is room."""
        m = min(len(keys), self.most - self.n)
        keys, size = keys[:m], size[:m]
        total, here = int(size.sum()), slice(self.n, self.n + m)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + total, "<u4")])
        self.ids[self.used : self.used + total] = ids[:total]
        self.keys[here], self.size[here] = keys, size
        self.first[here] = self.used + np.cumsum(size) - size
        numbers, left, slot = np.arange(self.n, self.n + m), np.arange(m), self._slot(keys)
        while len(left):
            at = slot[left]
            empty = self.slots[at] < 0
            self.slots[at[empty]] = numbers[left[empty]]
            left = left[self.slots[at] != numbers[left]]
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
        self.n, self.used = self.n + m, self.used + total


class PieceCoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids, as ``encode`` would."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.splitter = self.tokenizer.pre_tokenizer
        self.byte_level = (
            isinstance(self.model, models.BPE)
            and isinstance(self.splitter, pre_tokenizers.ByteLevel)
            and self.splitter.use_regex
            and not self.splitter.add_prefix_space
            and self.tokenizer.normalizer is None
        )
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.tokens_of = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
            rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
        ).findall
        # The same for ASCII alone, where the classes are short and the standard module is faster.
        self.ascii_tokens = re.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+"
            r"| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
        ).findall
        self.characters = _byte_characters()
        self.blank = self.characters[0x20]
        self.by_token: dict[str, list[int]] = {}
        self.known, self.old = _Words(_KEPT), _Words(1)

    def _mapped(self, mapped: str) -> list[int]:
        return [t.id for t in self.model.tokenize(mapped)]

    def _mixed(self, piece: str) -> list[int]:
        """Ids of a piece that is not one run of ASCII letters."""
        ascii_only = piece.isascii()
        if not (ascii_only or _PLAIN.fullmatch(piece)):
            return [i for m, _ in self.splitter.pre_tokenize_str(piece) for i in self._mapped(m)]
        ids: list[int] = []
        for token in (self.ascii_tokens if ascii_only else self.tokens_of)(piece):
            known = self.by_token.get(token)
            if known is None:
                known = self._mapped(token.encode().decode("latin1").translate(self.characters))
                if len(token) <= _WIDTH:
                    self.by_token[token] = known
            ids += known
        return ids

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that were not met before, and how many each has. A word stands for the piece
        of a blank and the word, after character one for the piece without a blank."""
        if len(self.by_token) > _TOKENS:
            self.by_token.clear()
        blank, tokenize, ids, ends = self.blank, self.model.tokenize, [], [0]
        for word in words:
            if word.isascii() and word.isalpha():
                ids += [t.id for t in tokenize(blank + word)]
            else:
                piece = word[1:] if word[:1] == "\1" else " " + word
                ids += self._mixed(piece) if piece else []
            ends.append(len(ids))
        return np.array(ids, "<u4"), np.diff(ends)

    def _coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's lie in them: first and number."""
        data, at = text_bytes(words)
        length = np.diff(at)
        short = np.flatnonzero(length <= _WIDTH)
        padded = np.append(data, np.zeros(_WIDTH, np.uint8))
        keys = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH)[at[short]].view("<u8")
        keys &= _OWN[length[short]]
        if self.known.n == self.known.most:
            self.known, self.old = _Words(_KEPT), self.known
        found = self.known.find(keys)
        lost = np.flatnonzero(found < 0)
        before = self.old.find(keys[lost])
        again, lost = lost[before >= 0], lost[before < 0]
        new = np.append(short[lost], np.flatnonzero(length > _WIDTH))
        coded = self._new(words.take(pa.array(new)).to_pylist())
        there = np.flatnonzero(found >= 0)
        parts = [self.known.ids_of(found[there]), self.old.ids_of(before[before >= 0])]
        parts.append(coded)
        self.known.add(keys[again], *parts[1])
        self.known.add(keys[lost], coded[0], coded[1][: len(lost)])
        order = np.concatenate([short[there], short[again], new])
        sizes = np.concatenate([n for _, n in parts])
        first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[order], size[order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate([ids for ids, _ in parts]), first, size

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts in order, and how many each text has."""
        if any(map(_UNSAFE.search, texts)):
            words, counts = [], []
            for text in texts:
                pieces = _PIECES.findall(text) if _UNSAFE.search(text) else text.replace(" ", "\0 ").split("\0")
                words += [p[1:] if p[:1] == " " else "\1" + p for p in pieces]
                counts.append(len(pieces))
            return pa.array(words, pa.large_string()), np.array(counts, np.int64)
        lists = pc.split_pattern(pa.array(["\1" + t for t in texts], pa.large_string()), " ")
        return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words, counts = self._cut(texts)
        numbered = words.dictionary_encode()
        ids, first, size = self._coded(numbered.dictionary)
        codes = numbered.indices.to_numpy(zero_copy_only=False)
        n_ids = size[codes]
        coded = ids[_runs(first[codes], n_ids)].tobytes()
        cuts = (4 * np.append(0, np.cumsum(n_ids))[np.append(0, np.cumsum(counts))]).tolist()
        return [coded[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; ``texts`` should be a few MB at most."""
        direct = [not self.byte_level or "\0" in t or "\1" in t or bool(self.added.search(t)) for t in texts]
        rest = [t for t, whole in zip(texts, direct) if not whole]
        cut = iter(self._by_words(rest) if rest else [])
        return [self._whole(t) if whole else next(cut) for t, whole in zip(texts, direct)]

    def _whole(self, text: str) -> bytes:
        coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(coded.ids, "<u4").tobytes()


def coder(path: str) -> PieceCoder:
    """The worker's coder for a tokenizer file, loaded once."""
    forget("coder")
    return once(f"coder {path}", lambda: PieceCoder(path))


def runs(texts: list[str], limit: int = 2 << 20):
    """Ranges of ``texts`` of about ``limit`` characters each (at least one text)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
