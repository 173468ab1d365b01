"""Ids of a byte-level BPE vocabulary, fast enough for whole corpora.

The vocabulary file is a parameter and is opened on the executors; nothing of
it is kept in this repository.  Texts are cut at single spaces and line ends,
where the vocabulary's own pre-tokeniser also cuts.  A worker keeps the ids of
the pieces it has seen in packed arrays, so the merge loop runs about once per
distinct piece and worker, and ids of a batch are gathered without a Python
loop over words.
"""

from __future__ import annotations

import json

import numpy as np

from tessera.llm.common import mix, names

#: Pieces kept per worker (about 30 bytes each); later ones are encoded anew.
MEMO = 3_000_000

_made: dict[str, BytePieces] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each range, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class BytePieces:
    """Encode with a byte-level BPE given as a ``tokenizers`` JSON file.

    The strings of special tokens are ordinary text inside a document.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        plain = self._bytes_by_symbol()
        ranks = {bytes(plain[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._line = ranks[b"\n"]
        self._key = np.zeros(0, np.uint64)  # sorted
        self._check = np.zeros(0, np.uint32)
        self._at = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32)

    @staticmethod
    def _bytes_by_symbol() -> dict[str, int]:
        """Byte-level BPE writes printable Latin-1 bytes as themselves and the
        others, in order, as the code points from 256 on."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text, without cutting it."""
        return np.array(self._bpe.encode_ordinary(text), np.uint32)

    @staticmethod
    def _odd(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts have white space other than single spaces and line ends,
        or end with a space: in these a piece can span a cut."""
        n = len(bounds) - 1
        space = (data == 0x20) | (data == 0x0A)
        where = np.flatnonzero(space)
        bad = [np.flatnonzero((data == 0x09) | ((data >= 0x0B) & (data <= 0x0D))), where[:-1][np.diff(where) == 1]]
        full = np.flatnonzero(np.diff(bounds))
        last = bounds[full + 1] - 1
        bad.append(last[data[last] == 0x20])
        pad = np.append(data, np.zeros(3, np.uint8))
        first, second, third = pad[:-3], pad[1:-2], pad[2:-1]
        wide = np.flatnonzero(
            ((first == 0xC2) & ((second == 0x85) | (second == 0xA0)))
            | ((first == 0xE1) & (second == 0x9A) & (third == 0x80))
            | ((first == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)))
            | ((first == 0xE2) & (second == 0x81) & (third == 0x9F))
            | ((first == 0xE3) & (second == 0x80) & (third == 0x80))
        )
        if len(wide):
            edge = np.ones(len(data) + 1, bool)  # white, or of another text
            edge[:-1] = space
            edge[bounds] = True
            after = wide + np.where(data[wide] == 0xC2, 2, 3)
            bad.append(wide[edge[np.minimum(after, len(data))] | np.append(True, space)[wide] | np.isin(wide, bounds) | np.isin(after, wide)])
        odd = np.zeros(n, bool)
        odd[np.searchsorted(bounds, np.concatenate(bad), side="right") - 1] = True
        return odd

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, spaced: np.ndarray, ended: np.ndarray):
        """Lengths and ids of new pieces: one call for all, one piece a line."""
        raw = data.tobytes()
        full = e > s  # an empty piece has no ids but, where it ends a line, the line's
        rows = zip(s[full].tolist(), e[full].tolist(), spaced[full].tolist(), strict=True)
        text = b"\n".join([(b" " if p else b"") + raw[i:j] for i, j, p in rows])
        ids = np.append(self.whole(text.decode("utf-8")), np.uint32(self._line))
        stop = np.flatnonzero(ids == self._line)
        start, size = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        if full.any():
            start[full] = np.append(0, stop[:-1] + 1)
            size[full] = stop - start[full]
        start[~full] = len(ids) - 1
        return size + ended, ids[ranges(start, size + ended)]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of the texts in a byte buffer, and the bounds of each text's ids."""
        n = len(bounds) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = self._odd(data, bounds)
        data = np.insert(data, bounds[1:], 0x0A)  # so that every piece ends at a cut
        final = bounds[1:] + np.arange(n)  # the cut that ends each text
        cut = np.flatnonzero((data == 0x20) | (data == 0x0A))
        last = np.zeros(len(data), bool)
        last[final] = True
        first = np.append(True, last[cut[:-1]])  # of its text
        s, e = np.append(0, cut[:-1] + 1), cut
        spaced = ~first & (data[s - 1] == 0x20)
        ended = (data[e] == 0x0A) & ~last[e]
        doc = np.cumsum(first) - 1
        use = ~odd[doc]
        s, e, spaced, ended, doc = (x[use] for x in (s, e, spaced, ended, doc))
        at, length, ids = self._find(data, s, e, spaced, ended)
        count = np.bincount(doc, weights=length, minlength=n).astype(np.int64)
        flat = ids[ranges(at, length)].astype(np.uint32)
        if odd.any():
            raw, own = data.tobytes(), np.append(0, np.cumsum(count))
            begin = np.append(0, final[:-1] + 1)
            parts = []
            for i in np.flatnonzero(odd):
                parts.append((own[i], self.whole(raw[begin[i] : final[i]].decode("utf-8"))))
            flat = np.insert(flat, np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]), np.concatenate([p[1] for p in parts]))
            count[odd] = [len(p[1]) for p in parts]
        return flat, np.append(0, np.cumsum(count))

    def _find(self, data, s, e, spaced, ended):
        """Where each piece's ids stand, how many there are, and the array of ids."""
        kind = (spaced * 2 + ended).astype(np.uint64)
        key, where, back = np.unique(mix(names(data, s, e, 11) + kind), return_index=True, return_inverse=True)
        check = (mix(names(data, s[where], e[where], 21) + kind[where]) >> np.uint64(32)).astype(np.uint32)
        k = np.minimum(np.searchsorted(self._key, key), max(len(self._key) - 1, 0))
        known = (self._key[k] == key) & (self._check[k] == check) if len(self._key) else np.zeros(len(key), bool)
        at, length, ids = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), self._ids
        at[known], length[known] = self._at[k[known]], self._len[k[known]]
        new = np.flatnonzero(~known)
        if len(new):
            w = where[new]
            size, got = self._learn(data, s[w], e[w], spaced[w], ended[w])
            length[new], at[new] = size, len(ids) + np.cumsum(size) - size
            ids = np.concatenate([ids, got.astype(ids.dtype)])
            if len(self._key) + len(new) <= MEMO:
                into = np.searchsorted(self._key, key[new])
                self._key = np.insert(self._key, into, key[new])
                self._check = np.insert(self._check, into, check[new])
                self._at, self._len = np.insert(self._at, into, at[new]), np.insert(self._len, into, size)
                self._ids = ids
        return at[back], length[back], ids


def encoder(path: str) -> BytePieces:
    """The encoder of this worker process."""
    if path not in _made:
        _made[path] = BytePieces(path)
    return _made[path]
