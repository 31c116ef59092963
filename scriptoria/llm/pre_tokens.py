"""Boundaries of pre-tokens by an associative scan of transition functions, without regular expressions.

The pattern that is followed is, in its usual writing,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point has a class; two code points ahead tell whether an apostrophe begins a
contraction and whether white space is the last of its run.  With that the pattern is an
automaton of eight states.  Each class is a function from states to states.  These functions,
closed under composition, are a small set of numbers with a table of compositions, so the
state before every character comes from a prefix scan over numbers: inside blocks for all
blocks at once, then over the blocks, then one look-up a character.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters with the property White_Space, and what follows an apostrophe in a contraction.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Letters and numbers that Unicode 16 added, for a Python whose own table is older.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, SPACE_IN, SPACE_LAST, WHITE_LAST, STOP = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)

#: Characters looked at together, and characters of a block of the scan: bounds of memory only.
CHUNK, BLOCK = 1 << 18, 64


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, for each class and state."""
    step, begins = np.zeros((9, 8), np.int64), np.ones((9, 8), bool)
    for kind, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
        step[kind] = run
        begins[kind, [run, AFTER_SPACE]] = False
    # the letters of a contraction: nothing else follows in these states
    step[LETTER, [ONE_MORE, TWO_MORE]] = [START, ONE_MORE]
    begins[LETTER, [ONE_MORE, TWO_MORE]] = False
    for kind, rest in ((QUOTE_1, ONE_MORE), (QUOTE_2, TWO_MORE)):
        step[kind] = rest
        step[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        begins[kind, [IN_OTHER, AFTER_SPACE]] = False
    step[SPACE_IN], begins[SPACE_IN, IN_SPACE] = IN_SPACE, False
    step[SPACE_LAST] = AFTER_SPACE
    step[WHITE_LAST] = START
    step[STOP] = START
    return step, begins


class Scan:
    """Tables of the automaton's functions under composition."""

    def __init__(self):
        self.step, self.begins = automaton()
        made = {tuple(range(8)): 0}
        for f in map(tuple, self.step.tolist()):
            made.setdefault(f, len(made))
        grown = list(made)
        for f in grown:  # grows while it is walked
            for g in self.step.tolist():
                both = tuple(g[s] for s in f)
                if both not in made:
                    made[both] = len(made)
                    grown.append(both)
        functions = np.array(list(made), np.int64)
        self.number = np.array([made[tuple(f)] for f in self.step.tolist()], np.uint8)
        self.apply = functions.astype(np.uint8)  # function, state before -> state after
        self.after = np.array([[made[tuple(b[a])] for b in functions] for a in functions], np.uint8)  # first, then -> both
        if len(made) > 256:
            raise ValueError("functions are numbered in a byte")

    def prefixes(self, functions: np.ndarray) -> np.ndarray:
        """What all functions up to and with each one make together."""
        n = len(functions)
        if n <= BLOCK:
            out = functions.copy()
            for i in range(1, n):
                out[i] = self.after[out[i - 1], out[i]]
            return out
        rows = -(-n // BLOCK)
        full = np.zeros(rows * BLOCK, np.uint8)
        full[:n] = functions
        inside = np.ascontiguousarray(full.reshape(rows, BLOCK).T)
        for i in range(1, BLOCK):
            inside[i] = self.after[inside[i - 1], inside[i]]
        before = np.concatenate([np.zeros(1, np.uint8), self.prefixes(inside[-1])[:-1]])
        return self.after[before[:, None], inside.T].reshape(-1)[:n]

    def states(self, kinds: np.ndarray, state: int) -> np.ndarray:
        """The state after each character."""
        return self.apply[self.prefixes(self.number[kinds]), state]


@lru_cache(maxsize=1)
def tables() -> tuple[Scan, np.ndarray]:
    """The scan, and the class of every code point (white space as SPACE_IN)."""
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    kind[[c for c, k in enumerate(first) if k == "L"]] = LETTER
    kind[[c for c, k in enumerate(first) if k == "N"]] = NUMBER
    for newer, k in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for a, b in newer:
            kind[a:b + 1] = k
    kind[WHITE] = SPACE_IN
    return Scan(), kind


def classes(code: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Classes of characters; *stops* are the places of separators, and the end is one, too."""
    _, table = tables()
    kind = table[code]
    kind[stops] = STOP
    following = np.append(kind[1:], np.uint8(STOP))
    last = (kind == SPACE_IN) & (following != SPACE_IN) & (following != STOP)
    kind[last] = np.where(code[last] == 0x20, SPACE_LAST, WHITE_LAST)
    quote = np.flatnonzero((code == 0x27) & (kind == OTHER))
    if len(quote):
        one, two = (np.where(quote + k < len(code), code[np.minimum(quote + k, len(code) - 1)], 0) for k in (1, 2))
        # separators are no letters
        one[np.isin(quote + 1, stops)] = 0
        two[np.isin(quote + 2, stops)] = 0
        kind[quote[np.isin(one, [ord(c) for c in SHORT])]] = QUOTE_1
        both = np.zeros(len(quote), bool)
        for a, b in LONG:
            both |= (one == ord(a)) & (two == ord(b))
        kind[quote[both]] = QUOTE_2
    return kind


def boundaries(text: str, stops: np.ndarray) -> np.ndarray:
    """Places where pre-tokens begin; a separator is one by itself.  *stops* ascend."""
    scan, _ = tables()
    state, out = START, [np.zeros(0, np.int64)]
    for at in range(0, len(text), CHUNK):
        # two characters more tell contractions and ends of white space
        code = np.frombuffer(text[at:at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        near = stops[np.searchsorted(stops, at):np.searchsorted(stops, at + len(code))] - at
        kind = classes(code, near)[:CHUNK]
        after = scan.states(kind, state)
        before = np.append(np.uint8(state), after[:-1])
        out.append(np.flatnonzero(scan.begins[kind, before]) + at)
        state = int(after[-1])
    return np.concatenate(out)
