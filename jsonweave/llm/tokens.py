"""Ids of whole texts by a byte-level BPE vocabulary file, with a bounded cache of pieces.

The vocabulary's pre-tokenizer starts a new token at every blank that stands before a visible
character, so a text may be cut there and the cuts encoded apart. Most cuts recur; they are encoded
once and kept. Longer runs of white space are never cut, nor are texts in which a special token is
written out: the library tells there what is a special token and what isn't.

New pieces of plain Latin words, most of all, are encoded by a faster library from the same vocabulary, where that is
ordered by merges (a token's number is its rank); all others, and everything in other vocabularies, by ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
from itertools import pairwise

import numpy as np

CACHE = 700_000
LONGEST = 64
_AT_BLANK = re.compile(r" (?=\S)")
_loaded: dict[tuple[str, bool], Pieces] = {}


class _Cache(dict):
    """Ids of ``" " + piece``. A new piece gets an empty buffer, which is filled when the batch's new
    pieces are encoded; pieces that stand in runs of white space are never kept, and raise the flag."""

    def __init__(self):
        self.fresh: list[str] = []
        self.irregular = False

    def __missing__(self, piece: str) -> bytearray:
        buffer = bytearray()
        if not piece or piece[0].isspace():
            self.irregular = True
        else:
            self[piece] = buffer
            self.fresh.append(piece)
        return buffer


#: Words and marks of which every reader of the pre-tokenizer's rule makes the same: Latin letters, then marks without
#: apostrophes, over several lines.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]*(?:\n[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]*)*")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable characters stand for themselves, other bytes for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_ranks(path: str):
    """An encoder of plain pieces, if the vocabulary is byte-level BPE whose numbers follow its merges; else None."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, model = model.get("pre_tokenizer") or {}, model["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    letters, ranks = _byte_of(), {}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in pairwise(merged)):
        return None
    made = set(merged)
    for token, i in model["vocab"].items():
        if i in made or (len(token) == 1 and token in letters):
            ranks[bytes(letters[c] for c in token)] = i
    if len(ranks) != len(made) + 256 or max(ranks[bytes([b])] for b in range(256)) > merged[0]:
        return None
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=r" ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pieces:
    """``plain``: special tokens written in a text are ordinary characters; else as the library has them."""

    def __init__(self, path: str, plain: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.default = None if plain else Tokenizer.from_file(path)
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for x, i in vocabulary.items() if x.startswith("\u0120")]] = True  # the byte-level sign of a blank
        self.known, self.first = _Cache(), {}
        self.quick = _by_ranks(path)

    def forget(self) -> None:
        """Drop the kept pieces: a worker that waits for its next task, of whatever kind, holds the vocabulary only."""
        self.known, self.first = _Cache(), {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, fresh: list[str]) -> None:
        plain = _PLAIN.fullmatch
        by_quick = [x for x in fresh if plain(x)] if self.quick else []
        if by_quick:
            self._fill(by_quick, np.array(self.quick(" " + " ".join(by_quick)), "<u4"))
            fresh = [x for x in fresh if not plain(x)]
        if fresh:
            self._fill(fresh, self.ids("".join([" " + x for x in fresh])))

    def _fill(self, fresh: list[str], ids: np.ndarray) -> None:
        """Cut the ids of pieces that were encoded as one text; each begins at a token that begins with a blank."""
        cuts = np.flatnonzero(self.blank_first[ids]) * 4
        assert len(cuts) == len(fresh)
        raw, at = ids.tobytes(), [*cuts.tolist(), 4 * len(ids)]
        known = self.known
        for x, i, j in zip(fresh, at, at[1:]):
            known[x].extend(raw[i:j])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE:
            self.known = _Cache()
        if len(self.first) > CACHE:
            self.first = {}
        known, found, odd = self.known, [], set()
        known.fresh = []
        for i, t in enumerate(texts):
            if any(x in t for x in self.special):
                found.append([np.array(self.default.encode(t, add_special_tokens=False).ids, "<u4").tobytes()])
                continue
            head, *rest = t.split(" ")
            if head not in self.first:
                self.first[head] = self.ids(head).tobytes()
            known.irregular = False
            found.append([self.first[head], *map(known.__getitem__, rest)])
            if known.irregular:
                odd.add(i)
        if known.fresh:
            self._learn(known.fresh)
        out = [self._irregular(t) if i in odd else b"".join(v) for i, (t, v) in enumerate(zip(texts, found))]
        for x in known.fresh:
            if len(x) > LONGEST:
                del known[x]
        return out

    def _irregular(self, text: str) -> bytes:
        """Texts with runs of white space: cut only at blanks before visible characters."""
        head, *rest = _AT_BLANK.split(text)
        out, known = [self.ids(head).tobytes()], self.known
        for x in rest:
            got = dict.get(known, x)
            out.append(got if got is not None else self.ids(" " + x).tobytes())
        return b"".join(out)


def pieces(path: str, plain: bool = True) -> Pieces:
    """The vocabulary of ``path``, loaded once in each Python worker."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = Pieces(path, plain)
    return _loaded[path, plain]
