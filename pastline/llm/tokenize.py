"""Token ids of whole texts by a tokenizers-library vocabulary, with a memo of pieces.

A text is cut only where the vocabulary's own rules always cut: before the first character after ASCII white space, and between
an ASCII letter and ASCII punctuation (never beside an apostrophe, ``<``, ``>`` or ``|``, which contractions and special tokens use).
Each distinct piece goes through the library once per worker; texts become gathers of the pieces' ids, so the ids equal those of
``Tokenizer.encode`` on the whole text. Tests compare the two.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from pastline.llm import textkernel as K

END_ID = 2
#: Pieces kept in a worker's memo; beyond, it keeps those of the texts at hand alone (a bound on memory, not on work).
MEMO_PIECES = 400_000
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch  # but İ, which becomes two characters
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 white, 2 letter, 3 punctuation
_KIND[[9, 10, 13, 32]] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<>|"]] = 3


class PieceTokenizer:
    """Encodes Arrow batches of texts; an instance lives in its Python worker and keeps its memo between tasks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for runs of letters: no pattern has anything to split
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.full.get_vocab_size()
        self.ends_word = np.array([(self.full.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = self.count = 0

    def _keep(self, names: list[str], where: np.ndarray) -> np.ndarray:
        """Forgets all pieces but ``names``, which are at ``where`` (if not negative); returns their new places."""
        known = where >= 0
        at, place = np.unique(where[known], return_inverse=True)
        lengths = self.lengths[at]
        flat = self.ids[K.ragged(self.starts[at], lengths)]
        self._clear()
        self._append(flat, lengths)
        out = where.copy()
        out[known] = place
        self.memo.update((x, i) for x, i in zip(names, out.tolist(), strict=True) if i >= 0)
        return out

    def _append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.count, len(lengths)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + m] = lengths
        self.used += len(flat)
        self.count += m

    def _add(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n = self.count
        self._append(flat, lengths)
        self.memo.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        lower: dict[str, str] = {}  # of runs of letters: the vocabulary's own rules lower them, so those that differ in case share their ids
        other = []
        for p in pieces:
            if _PLAIN(p):
                lower[p] = p.lower()
            else:
                other.append(p)
        plain = [p for p in dict.fromkeys(lower.values()) if p not in self.memo]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            found = self.plain.encode_batch_fast([" ".join(part[i : i + 200]) for i in range(0, len(part), 200)], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not end each word with a word-end id")
            self._add(part, flat, np.diff(ends, prepend=0))
        self.memo.update((p, self.memo[q]) for p, q in lower.items())
        if other:
            ids = [e.ids for e in self.full.encode_batch_fast(other, add_special_tokens=False)]
            lengths = np.array([len(x) for x in ids], np.int64)
            self._add(other, np.array([i for x in ids for i in x], np.uint32), lengths)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, each with the end id appended, and their row offsets."""
        rows = len(offsets) - 1
        if len(data):
            kind = _KIND[data]
            before, now = kind[:-1], kind[1:]
            cut = np.zeros(len(data), bool)
            cut[1:] = ((before == 1) & (now != 1)) | (before + now == 5) & (before >= 2)
            cut[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.flatnonzero(cut)
        else:
            starts = np.zeros(0, np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        names = [x.strip(" \t\n\r") for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        where = np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(where < 0).tolist()
        if len(self.memo) > MEMO_PIECES:
            where = self._keep(names, where)
        if missing:
            new = [names[i] for i in missing]
            self._learn(list(dict.fromkeys(new)))
            where[missing] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        index = where[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        lengths = self.lengths[index]
        before = np.searchsorted(starts, offsets)
        totals = K.per_row(lengths, before)
        out_offsets = np.zeros(rows + 1, np.int64)
        np.cumsum(totals + 1, out=out_offsets[1:])
        out = np.empty(int(out_offsets[-1]), np.uint32)
        text = np.ones(len(out), bool)
        text[out_offsets[1:] - 1] = False
        out[~text] = END_ID
        out[text] = self.ids[K.ragged(self.starts[index], lengths)]
        return out, out_offsets


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
