"""Token ids of a public byte-level BPE vocabulary, for batches of whole texts.

A batch is cut into words by array operations, equal words are encoded once, and the ids are gathered back; a
worker keeps the words it has met, up to a bound after which it starts anew. The ids are those that the tokenizers
library gives for byte_bpe_50k.json without special tokens: encode_texts takes the added tokens' strings as plain text,
encode_added as their ids, as the library does by default.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

OTHER, LETTER, NUMBER, BLANK, SPACE = range(5)
#: Texts of more characters are cut between two words, so that a batch's arrays stay small.
CUT_CHARS = 1 << 20
KNOWN_WORDS = 2_000_000
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256

_BETWEEN_WORDS = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[[ord(c) for c in m[0]]] = kind
    table[32] = SPACE
    return table


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE))


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words start in the code points of many texts; ``first`` marks each text's first character.

    A word is a contraction's end, or letters, numbers or other signs, each with one space before them if there is
    one, or white space without the last before a word.
    """
    kind = _classes()[cp]
    blank = kind >= BLANK
    prev = np.roll(kind, 1)
    prev_blank = prev >= BLANK
    before_word = np.zeros(len(cp), bool)
    before_word[:-1] = ~blank[1:] & ~first[1:]
    start = np.where(blank, ~prev_blank | before_word, np.where(prev_blank, prev != SPACE, kind != prev)) | first
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        padded, cut = np.append(cp, np.zeros(3, cp.dtype)), np.append(first, [True, True, True])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~cut[quote + 1]
        pair = a.astype(np.int64) << 32 | b
        two = np.isin(pair, [ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")]) & ~cut[quote + 1] & ~cut[quote + 2]
        start[quote[one | two] + 1] = False
        start[quote[two] + 2] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after[after < len(cp)]] = True
    return start


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (self.newline,) = self.plain("\n")
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and each word's count: all at once, as lines of one text."""
        blank = [k for k, w in enumerate(words) if w.isspace() or "\n" in w]
        lines = words
        if blank:
            lines = words.copy()
            for k in blank:
                lines[k] = "a"
        ids = np.array(self.plain("\n".join(lines)), np.uint32)
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
        lengths = np.diff(ends, prepend=-1) - 1
        if not blank:
            return ids[ids != self.newline], lengths
        parts = np.split(ids[ids != self.newline], lengths.cumsum()[:-1])
        for k in blank:
            parts[k] = np.array(self.plain(words[k]), np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def numbers(self, keys: np.ndarray, word) -> np.ndarray:
        """Places of the ascending keys among the known ones; the new ones' words are got by ``word`` and encoded."""
        if len(self.keys) + len(keys) > KNOWN_WORDS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[at] != keys
        new[at == len(self.keys)] = True
        fresh = np.flatnonzero(new)
        if len(fresh):
            ids, lengths = self.encode_words([word(k) for k in fresh.tolist()])
            starts = len(self.flat) + lengths.cumsum() - lengths
            self.lengths = np.insert(self.lengths, at[fresh], lengths)
            self.starts = np.insert(self.starts, at[fresh], starts)
            self.keys = np.insert(self.keys, at[fresh], keys[fresh])
            self.flat = np.concatenate([self.flat, ids])
            at = np.searchsorted(self.keys, keys)
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a list of texts of some CUT_CHARS characters altogether, one after the other, and each text's count."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        every = "".join(texts)
        if not every:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(every.encode("utf-32-le"), np.uint32)
        ends = lengths.cumsum()
        first = np.zeros(len(cp) + 1, bool)
        first[ends - lengths] = True
        at = np.flatnonzero(word_starts(cp, first[:-1]))
        stop = np.append(at[1:], len(cp))
        up, down = _powers(1 << int(len(cp)).bit_length())
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], ((cp + np.uint64(1)) * up[: len(cp)]).cumsum(dtype=np.uint64)])
            key = (sums[stop] - sums[at]) * down[at] + (stop - at).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        keys, sample, which = np.unique(key, return_index=True, return_inverse=True)
        number = self.numbers(keys, lambda k: every[at[sample[k]] : stop[sample[k]]])[which]
        n = self.lengths[number]
        total = np.concatenate([[0], n.cumsum()])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[number] - total[:-1], n)]
        upto = total[np.searchsorted(at, ends)]
        return ids, np.diff(np.concatenate([[0], upto]))


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(text: str, limit: int = CUT_CHARS) -> list[str]:
    """The text in parts of about ``limit`` characters; no word spans two, so their ids are those of the whole."""
    parts, at = [], 0
    while len(text) - at > limit and (m := _BETWEEN_WORDS.search(text, at + limit)):
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]] if at else [text]


def encode_texts(texts: list[str | None], path: str):
    """Yield the id array of each text, null counting as empty."""
    enc, parts, owner, size, at = encoder(path), [], [], 0, 0

    def flush():
        ids, counts = enc.encode(parts)
        ends = counts.cumsum()
        out: list[list] = [[] for _ in range(owner[-1] + 1)]
        for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            out[owner[k]].append(ids[a:b])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    for text in texts:
        text = text or ""
        if len(text) > CUT_CHARS:
            if parts:
                yield from flush()
                parts, owner, size, at = [], [], 0, 0
            yield np.concatenate([enc.encode([p])[0] for p in cut(text)])
            continue
        parts.append(text)
        owner.append(at)
        at, size = at + 1, size + len(text)
        if size > CUT_CHARS:
            yield from flush()
            parts, owner, size, at = [], [], 0, 0
    if parts:
        yield from flush()


def added_tokens(path: str) -> dict[str, int]:
    """The strings that the vocabulary's JSON file adds, with their ids; none where there is no such file."""
    whole = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}


def encode_added(texts: list[str | None], path: str, added: dict[str, int]):
    """Yield the id array of each text, each added token's string as its one id, the text between them on its own."""
    if not added:
        yield from encode_texts(texts, path)
        return
    find = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [find.split(t) if t else [""] for t in texts]  # every second one is an added token
    ids = encode_texts([p for every in parts for p in every[::2]], path)
    for every in parts:
        held = [next(ids) if k % 2 == 0 else np.array([added[p]], np.uint32) for k, p in enumerate(every)]
        yield held[0] if len(held) == 1 else np.concatenate(held)
