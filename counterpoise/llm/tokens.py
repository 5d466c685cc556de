"""Token ids of whole texts with a public tokenizer file.

The tokenizer cuts text at white space and between letters and punctuation before it
looks at merges, so the ids of a text are the ids of its pieces in order. Pieces repeat a
lot: each distinct piece is given to the tokenizer once per worker, and texts are put
together from the remembered ids with array operations.
"""

from __future__ import annotations

import os

import numpy as np

from counterpoise.llm.common import prefix_hash, ranges, run_hash

#: Vocabulary of the tokenizer whose files lie in the installed package.
VOCABULARY = "word_bpe_49k.json"

#: A worker forgets its pieces when it remembers this many; only speed depends on it.
REMEMBERED = 1_500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII marks that always start a new piece after a letter or digit. The apostrophe
#: (contractions) and <|> (special tokens) are left to the tokenizer.
_MARK = np.zeros(256, bool)
_MARK[list(b'.,;:!?"#$%&()*+-/=@[]^_`{}~\\')] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary_path(path: str | None = None) -> str:
    """``path``, or the place of the default vocabulary file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Pieces:
    """Ids of pieces, remembered by hash."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.closes[at] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        plain = [p for p in pieces if p.isalpha() and "İ" not in p]
        joined = np.array(
            self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.closes[joined]) + 1
        if len(ends) != len(plain) or len(plain) and ends[-1] != len(joined):
            plain, joined, ends = [], joined[:0], ends[:0]
        easy = set(plain)
        hard = [p for p in pieces if p not in easy]
        lists = [e.ids for e in self.tokenizer.encode_batch(hard, add_special_tokens=False)]
        place = {p: k for k, p in enumerate(plain)} | {
            p: len(plain) + k for k, p in enumerate(hard)}
        flat = np.concatenate(
            [joined, np.fromiter((i for x in lists for i in x), np.uint32)])
        count = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in lists], int)])
        first = np.cumsum(count) - count
        order = np.fromiter((place[p] for p in pieces), np.int64, len(pieces))
        known = np.concatenate([self.known, hashes])
        rank = np.argsort(known, kind="stable")
        self.known = known[rank]
        self.first = np.concatenate([self.first, first[order] + len(self.ids)])[rank]
        self.count = np.concatenate([self.count, count[order]])[rank].astype(np.int64)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each.

        ``data`` holds the UTF-8 bytes of the texts, which start at ``offsets``.
        """
        texts = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(texts, np.int64)
        inside = ~_SPACE[data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        before[edge] = False
        starts = inside & ~before
        plain = _PLAIN[data]
        letter = plain.copy()  # also the second byte of a Latin letter such as é
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= second
        starts[1:] |= _MARK[data[1:]] & letter[:-1] & before[1:]
        at = np.flatnonzero(starts)
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(texts, np.int64)
        # a piece ends where the next one starts or white space or the text's end comes
        stop = np.flatnonzero(~inside)
        nxt = np.append(at[1:], len(data))
        if len(stop):
            k = np.searchsorted(stop, at)
            nxt = np.minimum(nxt, np.append(stop, len(data))[k])
        owner = np.searchsorted(offsets, at, side="right") - 1
        ends = np.minimum(nxt, offsets[owner + 1])
        ascii_only = np.cumsum(data >= 0x80)
        pure = ascii_only[ends - 1] - ascii_only[at] + (data[at] >= 0x80) == 0
        # special tokens are spelled in lower case only, so their case must stay
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        pure[np.searchsorted(at, special, side="right") - 1] = False
        small = _LOWER[data]
        mark = np.repeat(pure, np.diff(np.append(at, len(data))))
        folded = data.copy()
        folded[at[0]:][mark] = small[at[0]:][mark]  # other ASCII pieces count as lower case
        hashes = run_hash(prefix_hash(folded), at, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(spot, len(self.known) - 1)] != distinct
        if new.any():
            raw = folded.tobytes()
            begin, end = at[where[new]], ends[where[new]]
            strings = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]
            self.learn(distinct[new], strings)
            spot = np.searchsorted(self.known, distinct)
        spot = spot[back]
        count = self.count[spot]
        ids = self.ids[ranges(self.first[spot], count)]
        lengths = np.bincount(owner, weights=count, minlength=texts).astype(np.int64)
        return ids, lengths


_open: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's remembered pieces of one vocabulary file."""
    if path not in _open:
        _open.clear()
        _open[path] = Pieces(path)
    return _open[path]


def encode(path: str, data: np.ndarray, offsets: np.ndarray,
           end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, each followed by the id ``end``, and their numbers."""
    ids, lengths = pieces(path).encode(data, offsets)
    total = lengths + 1
    out = np.empty(int(total.sum()), np.uint32)
    last = np.cumsum(total) - 1
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = ids
    out[last] = end
    return out, total
