"""The tokenizer's memo of pieces: what goes through the library, and that ids are those of the whole text."""

import numpy as np
import pyarrow as pa

from pastline.llm import textkernel as K
from pastline.llm import tokenize


def _coder():
    """A tokenizer, and the texts that it hands to the library for runs of letters."""
    coder, seen = tokenize.PieceTokenizer(tokenize.default_vocabulary()), []
    library = coder.plain

    class Watched:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(w for t in texts for w in t.split(" "))
            return library.encode_batch_fast(texts, **kw)

    coder.plain = Watched()
    return coder, seen


def _check(coder, texts):
    ids, ends = coder.encode(*K.utf8(pa.array(texts, pa.large_string())))
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == [*coder.full.encode(text, add_special_tokens=False).ids, tokenize.END_ID]


def test_a_full_memo_keeps_the_pieces_at_hand(monkeypatch):
    monkeypatch.setattr(tokenize, "MEMO_PIECES", 3)
    coder, seen = _coder()
    _check(coder, ["river stone meadow harbour", "", "river 12,5 stone"])
    seen.clear()
    _check(coder, ["stone lantern, river 12,5 river", "stone"])
    assert seen == ["lantern"] and "meadow" not in coder.memo
    for _ in range(3):
        _check(coder, ["meadow <|x|> harbour's", "lantern\nÉcole école 7"])
    assert coder.count <= 12 and coder.used == int(np.sum(coder.lengths[: coder.count]))


def test_letters_in_another_case_are_not_learned_again():
    coder, seen = _coder()
    _check(coder, ["River RIVER river Ÿpres ÿpres ȺB ⱥb ⱥB Straße STRASSE"])
    _check(coder, ["rIVER ÿPRES"])
    assert seen.count("river") == 1 and "RIVER" not in seen and len(seen) == len({w.lower() for w in seen})
