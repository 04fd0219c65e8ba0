"""Two predicate languages over rows with a metadata map (or columns), compiled to columns.

Both are two-valued: a missing key is false for every operator, != too, and NOT turns that true. A numeric
literal compares with the number that the text starts with (decimals; no inf, nan or hexadecimal). They differ
in spelling (= and LIKE against ==, CONTAINS and PREFIX) and in strings under < <= > >=: bytes in SQL, never
true in the filter language.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Field = Callable[[str], Column]
NUMBER = r"^[ \t\n\x0B\f\r]*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
_LEX = re.compile(r"""\s*(?:('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)(?![\w.])|(==|!=|<>|<=|>=|=|<|>)|([A-Za-z_][\w.\-]*)|([(),;*\[\]]))""")


def from_map(column: str = "metadata") -> Field:
    return lambda name: F.col(column)[name]


def from_columns(names) -> Field:
    known = set(names)
    return lambda name: F.col(f"`{name}`").cast("string") if name in known else F.lit(None).cast("string")


def number(text: Column) -> Column:
    """The number that a text starts with, or null."""
    return F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).try_cast("double")


def lex(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:at + 20]!r}")
        kind = ("string", "number", "op", "word", "mark")[next(i for i, g in enumerate(m.groups()) if g is not None)]
        value = m.group(m.lastindex)
        out.append((kind, value[1:-1] if kind == "string" else value))
        at = m.end()
    return out


class Reader:
    def __init__(self, items: list[tuple[str, str]]):
        self.items, self.at = items, 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def word(self) -> str:
        kind, value = self.peek()
        return value.upper() if kind == "word" else ""

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if k == "end" or (kind and k != kind) or (value and v.upper() != value):
            raise ValueError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def accept(self, value: str) -> bool:
        k, v = self.peek()
        if k != "string" and v.upper() == value:
            self.at += 1
            return True
        return False


def _compare(left: Column, op: str, right: Column) -> Column:
    return {"=": left == right, "==": left == right, "!=": left != right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def like(text: Column, pattern: str) -> Column:
    """% only at the ends is a wildcard; everything else is itself, case kept."""
    head, tail = pattern.startswith("%"), len(pattern) > 1 and pattern.endswith("%")
    body = pattern[head : len(pattern) - tail]
    if pattern == "%":
        return text.isNotNull()
    if head and tail:
        return F.contains(text, F.lit(body))
    return text.endswith(body) if head else text.startswith(body) if tail else text == body


def condition(reader: Reader, field: Field, dialect: str) -> Column:
    def leaf() -> Column:
        if reader.accept("NOT"):
            return ~leaf()
        if reader.accept("("):
            inner = either()
            reader.take("mark", ")")
            return inner
        value = field(reader.take("word"))
        kind, op = reader.peek()
        up = op.upper()
        if kind == "word" and up in (("LIKE",) if dialect == "sql" else ("CONTAINS", "PREFIX", "IN")):
            reader.take()
            if up == "IN":
                reader.take("mark", "(")
                items = [reader.take()]
                while reader.accept(","):
                    items.append(reader.take())
                reader.take("mark", ")")
                return F.coalesce(value.isin(*items), F.lit(False))
            literal = reader.take("string") if dialect == "sql" or reader.peek()[0] == "string" else reader.take()
            test = like(value, literal) if up == "LIKE" else F.contains(value, F.lit(literal)) if up == "CONTAINS" else value.startswith(literal)
            return F.coalesce(test, F.lit(False))
        op = reader.take("op")
        if (op in ("=", "<>")) if dialect == "filter" else (op == "=="):
            raise ValueError(f"{op} isn't an operator of the {dialect} language")
        kind, literal = reader.peek()
        reader.take()
        if kind == "number":
            return F.coalesce(_compare(number(value), op, F.lit(float(literal))), F.lit(False))
        if kind not in (("string",) if dialect == "sql" else ("string", "word")):
            raise ValueError(f"expected a value, found {literal!r}")
        if dialect == "filter" and op not in ("==", "!="):
            return F.lit(False)
        return F.coalesce(_compare(value, op, F.lit(literal)), F.lit(False))

    def both() -> Column:
        c = leaf()
        while reader.accept("AND"):
            c = c & leaf()
        return c

    def either() -> Column:
        c = both()
        while reader.accept("OR"):
            c = c | both()
        return c

    return either()


def parse_filter(text: str, field: Field) -> Column:
    """The filter language: == != < <= > >= CONTAINS PREFIX IN, AND OR NOT, parentheses, bare words as values."""
    reader = Reader(lex(text))
    c = condition(reader, field, "filter")
    reader_end(reader)
    return c


def reader_end(reader: Reader) -> None:
    if reader.peek()[0] != "end":
        raise ValueError(f"trailing {reader.peek()[1]!r}")


class Where:
    """A builder of the same conditions: (Where("x") >= 1) & ~Where("c").prefix("a"); .on(field) gives the column."""

    def __init__(self, name: str | None = None, make: Callable[[Field], Column] | None = None):
        self.name, self.make = name, make

    def _leaf(self, test: Callable[[Column], Column]) -> "Where":
        return Where(make=lambda field: F.coalesce(test(field(self.name)), F.lit(False)))

    def _op(self, op: str, value) -> "Where":
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return self._leaf(lambda c: _compare(number(c), op, F.lit(float(value))))
        if op not in ("=", "!="):
            return Where(make=lambda field: F.lit(False))
        return self._leaf(lambda c: _compare(c, op, F.lit(str(value))))

    def __eq__(self, value):  # type: ignore[override]
        return self._op("=", value)

    def __ne__(self, value):  # type: ignore[override]
        return self._op("!=", value)

    def __lt__(self, value):
        return self._op("<", value)

    def __le__(self, value):
        return self._op("<=", value)

    def __gt__(self, value):
        return self._op(">", value)

    def __ge__(self, value):
        return self._op(">=", value)

    def contains(self, text: str) -> "Where":
        return self._leaf(lambda c: F.contains(c, F.lit(text)))

    def prefix(self, text: str) -> "Where":
        return self._leaf(lambda c: c.startswith(text))

    def is_in(self, values) -> "Where":
        return self._leaf(lambda c: c.isin(*map(str, values)))

    def __and__(self, other: "Where") -> "Where":
        return Where(make=lambda f: self.make(f) & other.make(f))

    def __or__(self, other: "Where") -> "Where":
        return Where(make=lambda f: self.make(f) | other.make(f))

    def __invert__(self) -> "Where":
        return Where(make=lambda f: ~self.make(f))

    def on(self, field: Field) -> Column:
        return self.make(field)

    __hash__ = object.__hash__
