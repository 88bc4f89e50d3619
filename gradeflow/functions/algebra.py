"""Typed answers and their equality: numbers and expressions, tuples, intervals, sets, unions, text.

An answer is read once into postfix terms. Two expressions are equal if they agree at several seeded points. Without roots and functions points are
residues modulo two large primes, so arithmetic is exact (pi and variables are independent unknowns, i is a root of -1 there); with
roots the points are positive decimals of 60 digits, compared within 10^-40, or complex doubles within 10^-9 where decimals
can't follow (roots of negative numbers, functions). So a tolerance is met only where a root or function is.

Sets, bare lists and unions compare unordered, tuples and intervals in order and with their brackets. What doesn't parse is text and
equals the same text only.
"""

from __future__ import annotations

import cmath
import decimal
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Notation.
NO_MEANING = re.compile(r"\\(?:left|right|displaystyle|textstyle|quad|qquad|[!,;: ])|[~$]|\^\{?\\circ\}?|\\degree|°")
SAME = (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\cdot", "*"), ("\\times", "*"), ("\\div", "/"), ("\\pi", "π"), ("\\infty", "∞"), ("\\lbrace", "\\{"), ("\\rbrace", "\\}"), ("\\%", "%"), ("\\cup", "∪"), ("**", "^"), ("−", "-"), ("–", "-"), ("×", "*"), ("·", "*"), ("÷", "/"), ("√", "\\sqrt"))
FUNCTIONS = ("sin", "cos", "tan", "ln", "log", "exp")
THOUSANDS = re.compile(r"(?<![\d.])[-+]?\d{1,3}(?:(?:,|\{,\})\d{3})+(?:\.\d*)?(?![\d,])")
TOKEN = re.compile(r"\s+|(\d+\.?\d*(?:[eE][-+]?\d{1,3}(?!\d))?|\.\d+)|(\\frac|\\sqrt|\\(?:sin|cos|tan|ln|log|exp)(?![A-Za-z])|(?<![A-Za-z\\])(?:sin|cos|tan|ln|log|exp)(?=\s*\())|(\\[A-Za-z]+|[A-Za-zπ∞αβγθλμ]+)|([-+*/^(){}!%=\[\]])|(.)", re.DOTALL)
#: Letters in a row that are a word rather than a product.
WORD = 4

POINTS, DIGITS_KEPT = 3, 60
CLOSE, NEAR = Decimal(10) ** -40, 1e-9
#: Whole numbers of so many bits at most are followed exactly, for exponents and roots.
MOST_BITS, MOST_DEPTH = 4096, 40


class NotMath(ValueError):
    """Not an expression, or without a value."""


class NeedsNumbers(ArithmeticError):
    """Has a value, but not as a residue."""


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


@lru_cache(maxsize=1)
def _fields() -> list[tuple[int, int]]:
    """(prime, root of -1 in its field): primes beyond 2^61 that are one more than a multiple of four."""
    out, n = [], (1 << 61) + 1
    while len(out) < 2:
        if _is_prime(n):
            r = next(r for a in range(2, 100) if (r := pow(a, (n - 1) // 4, n)) * r % n == n - 1)
            out.append((n, r))
        n += 4
    return out


def _remembered(entries: int, longest: int = 200):
    """Keeps results of calls with short texts."""

    def wrap(use):
        cached = lru_cache(maxsize=entries)(use)

        @wraps(use)
        def ask(*texts):
            return (cached if sum(map(len, texts[:2])) <= longest else use)(*texts)

        return ask

    return wrap


# --- reading -----------------------------------------------------------------------------------------------------------------

PRECEDENCE = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "^": 4, "root": 5, "frac": 5, **{f: 3 for f in FUNCTIONS}}
Term = tuple[str, object]


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    for m in TOKEN.finditer(text):
        number, command, name, sign, other = m.groups()
        if other:
            raise NotMath(text)
        if number:
            yield "number", number
        elif command:
            yield "command", command.removeprefix("\\")
        elif name:
            if name.startswith("\\"):
                yield "name", name
            elif len(name) >= WORD:
                raise NotMath(text)
            else:
                yield from (("name", c) for c in name)
        elif sign:
            yield "sign", sign


class _Reader:
    """Recursive descent over one text: sums, products (also without a sign, but not before a number), powers, atoms."""

    def __init__(self, text: str) -> None:
        self.items, self.at, self.out, self.depth = [*_tokens(text)], 0, [], 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, sign: str) -> None:
        if self.peek() != ("sign", sign):
            raise NotMath(sign)
        self.at += 1

    def sum(self) -> None:
        self.product()
        while (sign := self.peek()) in (("sign", "+"), ("sign", "-")):
            self.at += 1
            self.product()
            self.out.append(("op", sign[1]))

    def product(self) -> None:
        negative = False
        while self.peek() in (("sign", "-"), ("sign", "+")):
            negative ^= self.peek()[1] == "-"
            self.at += 1
        self.power()
        while True:
            kind, text = self.peek()
            if (kind, text) in (("sign", "*"), ("sign", "/")):
                self.at += 1
                minus = False
                while self.peek() in (("sign", "-"), ("sign", "+")):
                    minus ^= self.peek()[1] == "-"
                    self.at += 1
                self.power()
                self.out += [("neg", None)] * minus + [("op", text)]
            elif kind in ("command", "name") or (kind, text) in (("sign", "("), ("sign", "{")):
                self.power()
                self.out.append(("op", "*"))
            else:
                break
        if negative:
            self.out.append(("neg", None))

    def power(self) -> None:
        self.atom()
        while self.peek() in (("sign", "!"), ("sign", "%")):
            self.out.append(("post", self.peek()[1]))
            self.at += 1
        if self.peek() == ("sign", "^"):
            self.at += 1
            negative = self.peek() == ("sign", "-")
            self.at += negative
            self.argument()
            if negative:
                self.out.append(("neg", None))
            self.out.append(("op", "^"))

    def group(self, opens: str, closes: str) -> None:
        self.take(opens)
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise NotMath("too deep")
        self.sum()
        self.depth -= 1
        self.take(closes)

    def argument(self) -> None:
        """What a command or a power binds to: a group, or one digit, number or name."""
        kind, text = self.peek()
        if (kind, text) == ("sign", "{"):
            self.group("{", "}")
        else:
            self.atom()

    def digit(self) -> None:
        """An argument of a fraction or root without braces is one digit."""
        kind, text = self.peek()
        if kind == "number" and len(text) > 1:
            if not text.isdigit():
                raise NotMath(text)
            self.items[self.at : self.at + 1] = [("number", text[0]), ("number", text[1:])]
        self.argument()

    def atom(self) -> None:
        kind, text = self.peek()
        if kind == "number":
            self.at += 1
            self.out.append(("number", text))
            after = [self.items[self.at + k] if self.at + k < len(self.items) else ("end", "") for k in range(3)]
            if text.isdigit() and after[0] == ("command", "frac"):  # a mixed number
                mark = len(self.out)
                self.atom()
                plain = [t[0] for t in self.out[mark:]] == ["number", "number", "op"]
                self.out.append(("op", "+" if plain else "*"))
            elif text.isdigit() and [a[0] for a in after] == ["number", "sign", "number"] and after[1][1] == "/":
                self.out += [("number", after[0][1]), ("number", after[2][1]), ("op", "/"), ("op", "+")]
                self.at += 3
        elif kind == "name":
            self.at += 1
            self.out.append(("name", text))
        elif kind == "command":
            self.at += 1
            if text == "frac":
                self.digit()
                self.digit()
                self.out.append(("op", "/"))
            elif text == "sqrt":
                degree = self.peek() == ("sign", "[")
                if degree:
                    self.group("[", "]")
                else:
                    self.out.append(("number", "2"))
                self.digit()
                self.out.append(("root", None))
            else:
                self.power()
                self.out.append(("call", text))
        elif (kind, text) == ("sign", "("):
            self.group("(", ")")
        elif (kind, text) == ("sign", "{"):
            self.group("{", "}")
        else:
            raise NotMath(text)


@_remembered(20_000)
def postfix(text: str) -> tuple[Term, ...]:
    """Postfix terms of an expression; NotMath if it is none."""
    if text.isalpha() and len(text) > 1:
        raise NotMath(text)
    reader = _Reader(text)
    reader.sum()
    if reader.at < len(reader.items):
        raise NotMath(text)
    return tuple(reader.out)


# --- values ------------------------------------------------------------------------------------------------------------------


def _fraction(text: str) -> Fraction | None:
    """A literal exactly; None if it is very long."""
    return Fraction(text) if len(text) < 600 else None


def _residue(text: str, p: int) -> int:
    """A literal modulo a prime, whatever its length."""
    mantissa, _, power = text.lower().partition("e")
    whole, _, decimals = mantissa.partition(".")
    out = 0
    for k in range(0, len(digits := whole + decimals), 18):
        out = (out * pow(10, len(digits[k : k + 18]), p) + int(digits[k : k + 18])) % p
    return out * pow(10, int(power or 0) - len(decimals), p) % p


class _Field:
    """Residues modulo one prime at one point; beside each the exact number where it is a constant that isn't large."""

    def __init__(self, p: int, unit: int, seed: int) -> None:
        self.p, self.unit, self.seed = p, unit, seed

    def number(self, text: str):
        return _residue(text, self.p), _fraction(text)

    def name(self, name: str):
        if name == "i":
            return self.unit, None
        return random.Random(f"{self.seed}|{self.p}|{name}").randrange(2, self.p - 1), None

    def apply(self, op: str, a, b):
        (x, ex), (y, ey) = a, b
        exact = None
        if op == "^":
            if ey is None or ey.denominator != 1:
                raise NeedsNumbers
            n = ey.numerator
            if n < 0 and x == 0:
                raise NotMath("0 to a negative power")
            if ex is not None and abs(n) * max(ex.numerator.bit_length(), ex.denominator.bit_length()) <= MOST_BITS:
                exact = ex**n
            return pow(x, n, self.p), exact
        if op == "/" and y == 0:
            raise NotMath("division by zero")
        if ex is not None and ey is not None:
            exact = ex + ey if op == "+" else ex - ey if op == "-" else ex * ey if op == "*" else ex / ey
            if max(exact.numerator.bit_length(), exact.denominator.bit_length()) > MOST_BITS:
                exact = None
        out = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x * pow(y, -1, self.p)
        return out % self.p, exact

    def neg(self, a):
        return -a[0] % self.p, None if a[1] is None else -a[1]

    def factorial(self, a):
        n = a[1]
        if n is None or n.denominator != 1 or not 0 <= n <= 500:
            raise NotMath("factorial")
        out = 1
        for k in range(2, int(n) + 1):
            out *= k
        return out % self.p, Fraction(out) if out.bit_length() <= MOST_BITS else None

    def root(self, degree, a):
        """Exact where it is one."""
        n, x = degree[1], a[1]
        if n is None or x is None or n.denominator != 1 or not 1 <= n <= 64 or x < 0:
            raise NeedsNumbers
        parts = []
        for part in (x.numerator, x.denominator):
            r = _whole_root(part, int(n))
            if r ** int(n) != part:
                raise NeedsNumbers
            parts.append(r)
        exact = Fraction(*parts)
        return exact.numerator * pow(exact.denominator, -1, self.p) % self.p, exact

    def call(self, name: str, a):
        raise NeedsNumbers


def _whole_root(x: int, n: int) -> int:
    low, high = 0, 1 << (x.bit_length() // n + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**n <= x else (low, mid - 1)
    return low


class _Real:
    """Positive decimals for names; no roots of negative numbers, no functions."""

    PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803")

    def __init__(self, seed: int) -> None:
        self.seed = seed

    def number(self, text: str):
        return Decimal(text)

    def name(self, name: str):
        if name == "i":
            raise decimal.InvalidOperation
        return self.PI if name == "π" else Decimal(random.Random(f"{self.seed}|{name}").randrange(10**20, 9 * 10**20)) / 10**20

    def apply(self, op: str, a, b):
        if op == "^":
            return self._power(a, b)
        if op == "/" and b == 0:
            raise NotMath("division by zero")
        return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b

    def _power(self, a: Decimal, b: Decimal) -> Decimal:
        if abs(b) > 10**6:
            raise NotMath("a large power")
        if a == 0 and b < 0:
            raise NotMath("0 to a negative power")
        return a**b

    def neg(self, a):
        return -a

    def factorial(self, a):
        if a != a.to_integral_value() or not 0 <= a <= 500:
            raise NotMath("factorial")
        out = Decimal(1)
        for k in range(2, int(a) + 1):
            out *= k
        return out

    def root(self, degree, a):
        if a < 0 and degree % 2 == 1:
            return -((-a) ** (1 / degree))
        return a.sqrt() if degree == 2 else a ** (1 / degree)

    def call(self, name: str, a):
        if name in ("ln", "log"):
            return a.ln() if name == "ln" else a.log10()
        if name == "exp":
            return a.exp()
        raise decimal.InvalidOperation


class _Complex(_Real):
    """Complex doubles."""

    def neg(self, a):
        return 0 - a  # -a would turn a zero's sign, and with it the side of a root's cut

    def number(self, text: str):
        return complex(float(text))

    def name(self, name: str):
        return 1j if name == "i" else complex(float(super().name(name)))

    def _power(self, a, b):
        return a**b

    def factorial(self, a):
        return complex(float(super().factorial(Decimal(a.real))))

    def root(self, degree, a):
        n = degree.real
        return -((-a) ** (1 / n)) if a.imag == 0 and a.real < 0 and n % 2 == 1 else a ** (1 / n)

    def call(self, name: str, a):
        return {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log10, "exp": cmath.exp}[name](a)


def value(terms: tuple[Term, ...], at) -> object:
    """Of postfix terms at a point."""
    stack: list = []
    for kind, x in terms:
        if kind == "number":
            stack.append(at.number(x))
        elif kind == "name":
            stack.append(at.name(x))
        elif kind == "neg":
            stack.append(at.neg(stack.pop()))
        elif kind == "post":
            stack.append(at.factorial(stack.pop()) if x == "!" else at.apply("/", stack.pop(), at.number("100")))
        elif kind == "root":
            a = stack.pop()
            stack.append(at.root(stack.pop(), a))
        elif kind == "call":
            stack.append(at.call(x, stack.pop()))
        else:
            b = stack.pop()
            stack.append(at.apply(x, stack.pop(), b))
    return stack[-1]


@_remembered(20_000)
def residues(text: str) -> tuple[int, ...] | None:
    """Values of an expression modulo the primes at all points; None if residues can't follow it."""
    terms = postfix(text)
    points = POINTS if any(kind == "name" and x != "i" for kind, x in terms) else 1
    try:
        found = [value(terms, _Field(p, unit, seed))[0] for seed in range(points) for p, unit in _fields()]
        return tuple(found * (POINTS // points))
    except NeedsNumbers:
        return None


def same_expression(a: str, b: str) -> bool:
    """Whether two expressions agree at every point; NotMath if one of them is none."""
    if ("∞" in a) != ("∞" in b):
        return False
    x, y = residues(a), residues(b)
    if x is not None and y is not None:
        return x == y
    left, right = postfix(a), postfix(b)
    with decimal.localcontext(prec=DIGITS_KEPT, Emax=10**6, Emin=-(10**6)):
        for seed in range(POINTS):
            try:
                u, v = value(left, _Real(seed)), value(right, _Real(seed))
                if not abs(u - v) <= CLOSE * max(1, abs(u), abs(v)):
                    return False
            except (decimal.DecimalException, ArithmeticError):
                return _near(left, right)
    return True


def _near(left: tuple[Term, ...], right: tuple[Term, ...]) -> bool:
    try:
        pairs = [(value(left, _Complex(seed)), value(right, _Complex(seed))) for seed in range(POINTS)]
    except (ArithmeticError, decimal.DecimalException) as e:
        raise NotMath("no value") from e
    return all(abs(u - v) <= NEAR * max(1.0, abs(u), abs(v)) for u, v in pairs)


# --- answers -----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Answer:
    """kind: number, tuple, interval, set, union, relation or text; brackets: those around it; parts: of a number or text one."""

    kind: str
    brackets: str
    parts: tuple[str, ...]


def cleaned(text: str) -> str:
    """In one notation, without marks that have no meaning."""
    for a, b in SAME:
        text = re.sub(re.escape(a) + ("(?![A-Za-z])" if a[-1].isalpha() and a[0] == "\\" and b[0] != "\\" else ""), lambda m, b=b: b, text)
    return " ".join(NO_MEANING.sub(" " if "\\ " in text else "", text).split())


def _split(text: str, at: str) -> list[str]:
    """Parts between signs that no bracket encloses."""
    parts, depth, start, k = [], 0, 0, 0
    while k < len(text):
        c = text[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and c == at:
            parts.append(text[start:k].strip())
            start = k + 1
        k += 1
    return [*parts, text[start:].strip()]


def _enclosed(text: str) -> bool:
    """Whether the first bracket is closed by the last character."""
    depth = 0
    for k, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            return k == len(text) - 1
    return False


@_remembered(20_000)
def typed(text: str) -> Answer:
    """What kind of answer a text is. A comma between groups of three digits without brackets around parts thousands; others part an answer."""
    t = cleaned(text)
    if THOUSANDS.fullmatch(t):
        return Answer("number", "", (t.replace("{,}", "").replace(",", ""),))
    t = t.replace("{,}", "")
    if len(parts := _split(t, "∪")) > 1 and all(parts):
        return Answer("union", "", tuple(parts))
    if t.startswith("\\{") and t.endswith("\\}") and _enclosed(t.replace("\\{", "{").replace("\\}", "}")):
        inner = t[2:-2].strip()
        return Answer("set", "{}", tuple(_split(inner, ",")) if inner else ())
    if len(t) > 2 and t[0] in "([" and t[-1] in ")]" and _enclosed(t) and len(parts := _split(t[1:-1], ",")) > 1 and all(parts):
        brackets = t[0] + t[-1]
        return Answer("tuple" if brackets == "()" else "interval", brackets, tuple(parts))
    if len(parts := _split(t, ",")) > 1 and all(parts):
        return Answer("set", "", tuple(parts))
    if len(parts := _split(t, "=")) > 1 and all(parts):
        return Answer("relation", "=", tuple(parts))
    try:
        postfix(t)
    except (NotMath, RecursionError, ValueError):
        return Answer("text", "", (t,))
    return Answer("number", "", (t,))


def _unordered(a: tuple[str, ...], b: tuple[str, ...], depth: int) -> bool:
    """Whether each part of either has its like in the other."""
    keys: list[dict[object, str]] = []
    for parts in (a, b):
        keys.append({})
        for part in parts:
            try:
                key = residues(part) if typed(part).kind == "number" else None
            except NotMath:
                key = None
            keys[-1].setdefault(key or part, part)
    left, right = ({k: p for k, p in mine.items() if k not in other} for mine, other in (keys, keys[::-1]))
    like = lambda x, others: any(same(x, y, depth + 1) for y in others)
    return all(like(x, b) for x in left.values()) and all(like(y, a) for y in right.values())


def same(a: str, b: str, depth: int = 0) -> bool:
    """Whether two answers are equal."""
    x, y = typed(a), typed(b)
    if depth > MOST_DEPTH:
        return x == y
    if x.kind == "relation" and y.kind != "relation" or y.kind == "relation" and x.kind != "relation":
        # a value may be given as that of one name
        named, other = (x, b) if x.kind == "relation" else (y, a)
        return len(named.parts) == 2 and len(named.parts[0].lstrip("\\")) == 1 and same(named.parts[1], other, depth + 1)
    if x.kind != y.kind:
        return False
    if x.kind == "number":
        try:
            return same_expression(x.parts[0], y.parts[0])
        except (NotMath, RecursionError, OverflowError):
            return x.parts == y.parts
    if x.kind == "text":
        return x.parts == y.parts
    if x.kind in ("set", "union"):
        return _unordered(x.parts, y.parts, depth)
    if x.kind == "relation":
        ordered = len(x.parts) == len(y.parts) and all(same(u, v, depth + 1) for u, v in zip(x.parts, y.parts, strict=True))
        return ordered or (len(x.parts) == len(y.parts) == 2 and same(x.parts[0], y.parts[1], depth + 1) and same(x.parts[1], y.parts[0], depth + 1))
    return x.brackets == y.brackets and len(x.parts) == len(y.parts) and all(same(u, v, depth + 1) for u, v in zip(x.parts, y.parts, strict=True))


@_remembered(50_000)
def _known(a: str, b: str) -> bool:
    return same(a, b)


def any_same(answers: Iterable[str | None], want: str | None) -> bool | None:
    """Whether any of some answers equals the wanted one; None without answers or a wanted one."""
    asked = [a for a in answers if a is not None]
    if want is None or not asked:
        return None
    return any(_known(a, want) for a in asked)


@F.arrow_udf(T.BooleanType())
def any_equal(want: pa.Array, *answers: pa.Array) -> pa.Array:
    """``any_same`` of a wanted answer and some others; most batches have none to compare. Columns of texts, not one of arrays: a batch of arrays is
    measured anew with every row that joins it, which takes the square of its rows."""
    out = np.full(len(want), None, dtype=object)
    asked = np.logical_or.reduce([np.asarray(a.is_valid()) for a in answers])
    for k in np.flatnonzero(asked & np.asarray(want.is_valid())):
        out[k] = any_same([a[k].as_py() for a in answers], want[k].as_py())
    return pa.array(out, pa.bool_())


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("brackets", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType()))]))
def answer_type(answers: pd.Series) -> pd.DataFrame:
    """Typed values of answers; null is text without parts."""
    found = [Answer("text", "", ()) if a is None else typed(a) for a in answers]
    return pd.DataFrame({"kind": [x.kind for x in found], "brackets": [x.brackets for x in found], "parts": [list(x.parts) for x in found]})
