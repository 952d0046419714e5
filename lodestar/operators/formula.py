"""Boolean formulas over names: ! binds tighter than &, & tighter than |; compiled to a Column."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:([A-Za-z_]\w*)|([!&|()]))")


class FormulaError(ValueError):
    pass


class Formula:
    """A parsed formula; nested tuples ("name", x), ("not", f), ("and", f, g), ("or", f, g)."""

    def __init__(self, text: str):
        self._tokens = self._scan(text)
        self._at = 0
        self.tree = self._level(0)
        if self._at < len(self._tokens):
            raise FormulaError(f"unexpected {self._tokens[self._at]!r}")

    @staticmethod
    def _scan(text: str) -> list[str]:
        out, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise FormulaError(f"bad character at {at}: {text[at:]!r}")
            out.append(m.group(1) or m.group(2))
            at = m.end()
        if not out:
            raise FormulaError("empty formula")
        return out

    def _peek(self) -> str:
        return self._tokens[self._at] if self._at < len(self._tokens) else ""

    def _level(self, depth: int) -> tuple:
        if depth == 2:
            return self._factor()
        sign, kind = (("|", "or"), ("&", "and"))[depth]
        left = self._level(depth + 1)
        while self._peek() == sign:
            self._at += 1
            left = (kind, left, self._level(depth + 1))
        return left

    def _factor(self) -> tuple:
        t = self._peek()
        self._at += 1
        if t == "!":
            return ("not", self._factor())
        if t == "(":
            inner = self._level(0)
            if self._peek() != ")":
                raise FormulaError("missing )")
            self._at += 1
            return inner
        if not t or t in "&|)":
            raise FormulaError(f"a name is missing before {t!r}" if t else "the formula ends early")
        return ("name", t)

    def names(self) -> set[str]:
        def walk(f: tuple) -> set[str]:
            return {f[1]} if f[0] == "name" else set().union(*map(walk, f[1:]))

        return walk(self.tree)

    def compile(self, values: Mapping[str, Column]) -> Column:
        """A name without a value is false."""

        def walk(f: tuple) -> Column:
            if f[0] == "name":
                return values.get(f[1], F.lit(False))
            if f[0] == "not":
                return ~walk(f[1])
            a, b = walk(f[1]), walk(f[2])
            return a & b if f[0] == "and" else a | b

        return walk(self.tree)
