"""Pre-tokens of byte-level BPE texts, through bounded memos.

A pre-token is one match of the split pattern. For the patterns of ``CUT_AT_SPACES`` it is letters,
digits or other signs, each with at most one space before, or a run of white space. No match
spans a space that follows a non-space, so a text may be cut in front of such spaces and the
pieces matched alone: most pieces (a space and a word) recur and come from the memo, without
running the pattern. With any other pattern the whole text is matched, and the memo
holds single pre-tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import regex

from loanlab.llm.common import ship

ship(__name__)

SIGNS = frozenset(".,;:!?")
# fixed value: the split patterns for which texts may be cut in front of spaces
CUT_AT_SPACES = frozenset([r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"])
MEMO_ENTRIES = 400_000  # per generation: about 60 MB
MEMO_KEY = 64           # longer pieces are worked out each time
OTHER_ENTRIES = 50_000  # of pieces that are not plain words


class Memo(dict):
    """Remembers ``work(key)`` in two generations, so its memory is bounded.

    When the young one is full it becomes the old one; keys that are asked for again return
    from there, the others go with the next change.
    """

    def __init__(self, work: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.work, self.entries, self.old = work, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= MEMO_KEY:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Words(Memo):
    """Values of a space and a word. A word of letters and one sign is put together, not remembered:
    the letters are one match with their space, and the sign is the next."""

    def __init__(self, work: Callable, signs: Memo, entries: int = MEMO_ENTRIES):
        super().__init__(work, entries)
        self.signs = signs

    def __missing__(self, word):
        if word[-1:] in SIGNS and word[:-1].isalpha():
            return self[word[:-1]] + self.signs[word[-1]]
        return super().__missing__(word)


class Pieces:
    """Maps a text to the values of its pieces, in order; their sum is the text's.

    ``one`` gives a pre-token's value, ``none`` that of an empty piece. ``entries``: words that a
    generation of the memo holds.
    """

    def __init__(self, pattern: str, one: Callable[[str], object], none, entries: int = MEMO_ENTRIES):
        split = regex.compile(pattern).findall
        token = Memo(one, OTHER_ENTRIES)
        self.split, self.token, self.cuts = split, token, pattern in CUT_AT_SPACES

        def fold(piece: str):
            value = none
            for t in split(piece):
                value = value + token[t]
            return value
        self.plain = Memo(fold, OTHER_ENTRIES)
        self.spaced = Words(lambda word: one(" " + word) if word.isalpha() else fold(" " + word), token,
                            entries)
        self.unsafe = regex.compile(r"\s ").search          # white space before a space: a run
        self.rough = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall

    def __call__(self, text: str) -> list:
        if not self.cuts:
            return list(map(self.token.__getitem__, self.split(text)))
        if self.unsafe(text):
            return list(map(self.plain.__getitem__, self.rough(text)))
        head, *rest = text.split(" ")
        if rest and not rest[-1]:  # a space at the very end stands alone
            rest.pop()
            return [self.plain[head], *map(self.spaced.__getitem__, rest), self.plain[" "]]
        return [self.plain[head], *map(self.spaced.__getitem__, rest)]
