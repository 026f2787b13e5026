"""Helpers around a tokenizer file of the tokenizers library.

A *pre-token* here is a run of characters other than white space with the one
space before it, or the white space between two such runs: byte-level BPE never
merges across these borders, so the ids of a text are those of its pre-tokens in
order.  A text that holds one of the tokenizer's added tokens (its special
strings) is encoded whole by the library.
"""

from __future__ import annotations

import json
import re
from array import array

#: Unicode White_Space, which the byte-level splitter goes by.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")

#: distinct pre-tokens in each of the two generations that a task remembers
MEMORY = 250_000
#: below this character the letter tables of both libraries agree
_AGREED = "\u0530"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def added_tokens(tok) -> re.Pattern | None:
    """What finds the added tokens' strings in a text (None if there are none)."""
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None


def same_ranks(path: str):
    """The file's vocabulary as ranks for tiktoken, which merges by them; None where its
    merges are not in the order of their ids, so that ranks would not do."""
    import tiktoken
    from public_tokenizers import PATTERN
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary, merges = model["vocab"], model["merges"]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
    if any(vocabulary[left + right] != 256 + k for k, (left, right) in enumerate(pairs)):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Remembered(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit numbers.

    When full, what was learnt becomes the old generation, from which a pre-token met
    again is taken over; so frequent ones stay and the size is bounded.  New ones are
    merged by the ranks of the same vocabulary where these give the tokenizer's ids
    (in half its time), by the tokenizer elsewhere.
    """

    def __init__(self, path: str, limit: int = MEMORY):
        super().__init__()
        self._tok, self._limit, self._old = load(path), limit, {}
        self._tok.encode_special_tokens = True  # a pre-token is ordinary text
        self._ranks = same_ranks(path)

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            if self._ranks is not None and max(piece) < _AGREED:
                new = self._ranks.encode_ordinary(piece)
            else:
                new = self._tok.encode(piece, add_special_tokens=False).ids
            ids = array("I", new).tobytes()
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[piece] = ids
        return ids
