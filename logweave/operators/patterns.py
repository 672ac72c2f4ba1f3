"""Many patterns: texts are scanned once for what patterns must contain, and few patterns run."""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick

from logweave.functions import posix


class PatternSet:
    """Numbered patterns of one field.

    Most patterns have a text that every match contains. These texts of all patterns are in one automaton, so a
    message is read once however many patterns there are, and only patterns
    whose text it has, or that have none, are tried.
    """

    def __init__(self, patterns: Iterable[tuple[int, str]]):
        self.search, self.always = {}, []
        self.texts: dict[str, list[int]] = {}
        for number, pattern in patterns:
            self.search[number] = pattern
            found = posix.literals(posix.parse(pattern))
            for text in found or ():
                self.texts.setdefault(text, []).append(number)
            if found is None:
                self.always.append(number)
        self.automaton = None
        if self.texts:
            self.automaton = ahocorasick.Automaton()
            for text, numbers in self.texts.items():
                self.automaton.add_word(text, numbers)
            self.automaton.make_automaton()

    def candidates(self, text: str) -> set[int]:
        found = set(self.always)
        if self.automaton:
            for _, numbers in self.automaton.iter(text):
                found.update(numbers)
        return found

    def matching(self, text: str) -> list[int]:
        """The numbers of the patterns that match, ascending."""
        return [n for n in sorted(self.candidates(text)) if self._compiled(n)(text)]

    def _compiled(self, number: int):
        found = self.search[number]
        if isinstance(found, str):
            found = self.search[number] = re.compile(posix.python(found)).search
        return found


class RowTests:
    """Tests that a row brings along, as ``[[field, pattern, inverse], …]``, compiled once per worker and list."""

    MOST = 50_000

    def __init__(self):
        self.known: dict[str, list[tuple]] = {}

    def tests(self, key: str, rows: list) -> list[tuple]:
        if len(self.known) >= self.MOST:
            self.known.clear()
        made = self.known[key] = [
            (field, tuple(posix.literals(posix.parse(pattern)) or ()), re.compile(posix.python(pattern)).search, inverse)
            for field, pattern, inverse in rows]
        return made

    @staticmethod
    def passes(tests: list[tuple], values: tuple[str | None, ...]) -> bool:
        """Whether all tests pass; a null value passes none."""
        for field, texts, search, inverse in tests:
            value = values[field]
            if value is None:
                return False
            hit = (not texts or any(t in value for t in texts)) and search(value) is not None
            if hit == inverse:
                return False
        return True
