"""Contains-style LIKE patterns, many in one pass over a text."""

from __future__ import annotations

import re

import ahocorasick


class LikePattern:
    """Contains-style LIKE pattern (``%``, ``_``, backslash escapes).

    The pieces between ``%`` are searched one after the other; taking the leftmost place for each
    is enough, so the cost stays linear in the text.
    """

    def __init__(self, pattern: str):
        self.pieces: list[re.Pattern] = []
        current: list[str] = []
        letters = [""]
        chars = iter(pattern)
        for ch in chars:
            if ch == "%":
                self._close(current)
                current = []
                letters.append("")
            elif ch == "_":
                current.append(".")
                letters.append("")
            else:
                letter = next(chars, ch) if ch == "\\" else ch
                current.append(re.escape(letter))
                letters[-1] += letter
        self._close(current)
        self.anchor = max(letters, key=len)  # a text with the pattern holds it

    def _close(self, piece: list[str]) -> None:
        if piece:
            self.pieces.append(re.compile("".join(piece), re.S))

    def search(self, text: str) -> bool:
        at = 0
        for piece in self.pieces:
            found = piece.search(text, at)
            if found is None:
                return False
            at = found.end()
        return True


WORDS = 1 << 17  # words whose patterns a PatternSet remembers before it starts anew
LONG = 64  # letters from which a word is not remembered


def _automaton(patterns: dict[str, tuple[int, ...]]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    automaton = ahocorasick.Automaton()
    for p, own in patterns.items():
        automaton.add_word(p, own)
    automaton.make_automaton()
    return automaton


class PatternSet:
    """Finds which of many lower-cased patterns occur in a text, in one pass.

    A pattern without white space lies inside one word, so a word's patterns are looked for once and remembered; those
    with white space are looked for in the whole text. Results do not depend on what is remembered.
    """

    def __init__(self, patterns: list[str]):
        self.size = len(patterns)
        self.plain = [(i, p) for i, p in enumerate(patterns) if not re.search(r"[%_\\]", p)]
        self.wild = {i: LikePattern(p) for i, p in enumerate(patterns) if re.search(r"[%_\\]", p)}
        self.always = [i for i, rx in self.wild.items() if not rx.anchor]
        self.anchored = [i for i, rx in self.wild.items() if rx.anchor]
        self.longest = max((len(p) for p in [*(p for _, p in self.plain), *(rx.anchor for rx in self.wild.values())]), default=1)
        searched: dict[str, list[int]] = {}  # a pattern may be an anchor too, and an anchor that of several
        for i, p in [*self.plain, *((i, rx.anchor) for i, rx in self.wild.items() if rx.anchor)]:
            searched.setdefault(p, []).append(i)
        self.inside = _automaton({p: tuple(own) for p, own in searched.items() if p.split() == [p]})
        self.across = _automaton({p: tuple(own) for p, own in searched.items() if p.split() != [p]})
        self.words: dict[str, tuple[int, ...]] = {}
        self.once: set[str] = set()  # words met once; a word is remembered when it is met again

    def found(self, text: str) -> list[int]:
        return list(self._checked(self._held(text), text))

    def found_with_suffix(self, text: str, suffix: str) -> tuple[list[int], list[int]]:
        """``found`` of a text and of its suffix; what the suffix holds is not searched again in the text."""
        inside = self._held(suffix)
        head = self._held(text[: len(text) - len(suffix) + self.longest - 1])  # all that begins before the suffix ends in it
        return list(self._checked(inside | head, text)), list(self._checked(inside, suffix))

    def _checked(self, held: set[int], text: str) -> set[int]:
        """Of patterns that are held, or whose anchor is, those in the text."""
        if not self.wild:
            return held
        absent = [i for i in self.anchored if i in held and not self.wild[i].search(text)]
        return held.difference(absent).union([i for i in self.always if self.wild[i].search(text)])

    def _held(self, text: str) -> set[int]:
        """Plain patterns in a text, and patterns with wildcards whose anchor is in it."""
        hits = set().union(*[own for _, own in self.across.iter(text)]) if self.across else set()
        if not self.inside:
            return hits
        words = set(text.split())
        new = words.difference(self.words)
        again = new & self.once
        first = new - again
        self.once |= first
        for word in again:
            own = tuple(set().union(*[own for _, own in self.inside.iter(word)]))
            hits.update(own)
            if len(word) < LONG:
                self.words[word] = own
        hits.update(*[own for _, own in self.inside.iter("\n".join(first))])
        hits = hits.union(*map(self.words.__getitem__, words - new))
        if len(self.words) > WORDS:
            self.words = {}
        if len(self.once) > WORDS:
            self.once = set()
        return hits
