"""Equality of answers as expressions, for what exact numbers do not decide.

An answer is read as a rational function over the rationals with square roots of
integers. Two such functions are equal iff a polynomial is zero, and polynomials
(in the variables, pi, and one root per prime, whose square is the prime) have one
normal form, so equal and different are both decided. Where the polynomials grow
over ``MAX_TERMS`` terms both sides are computed at random points modulo two primes
of 61 bits instead: a difference there is certain, agreement at all points is wrong
with a probability below (degree / 2^61)^8. Functions, e, i and symbolic exponents
stand for themselves: equal if their arguments are, otherwise undecided.

The Spark side (``algebraically_equal``, ``first_equal``) decides texts and plain
numbers with built-in functions and sends only what is left to Python. A worker
remembers what it decided; ``with_equality`` decides each different pair of a table
once, on all cores.
"""

from __future__ import annotations

import hashlib
import random
import re
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .equivalence import equivalent
from .text import normalize_answer

MAX_TERMS, MAX_POWER, MAX_CHARS = 300, 64, 400
#: Two primes of 61 bits.
PRIMES = (2305843009213693951, 2305843009213693921)
POINTS = 4
#: Pairs of texts whose verdict a worker remembers, and tasks a core among which different pairs are dealt.
REMEMBERED, TASKS = 50_000, 4

_TOKEN = re.compile(r"\\[a-z]+|\\[{}]|\d+\.\d+|\.\d+|\d+|[a-z]+|\*\*|[-+*/^(){}\[\],=]|\S")
#: How signs and commands are written otherwise.
_SAME = {"**": "^", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "×": "*", "·": "*", "−": "-", "÷": "/", "π": "\\pi", "pi": "\\pi", "sqrt": "\\sqrt", "√": "\\sqrt"}
_FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "log", "ln", "exp", "arcsin", "arccos", "arctan")
_CLOSES = {"(": ")", "[": "]", "{": "}", "\\{": "\\}"}


class Unreadable(ValueError):
    """Not an expression that is understood here."""


class TooLarge(ValueError):
    """A polynomial of more than ``MAX_TERMS`` terms or of a power over ``MAX_POWER``."""


# -- reading -------------------------------------------------------------------------------------------------------


class _Reader:
    """A tree of an expression: (kind, parts...). Only products that cannot be read in two ways may leave out their sign."""

    def __init__(self, text: str):
        self.tokens = [_SAME.get(t, t) for t in _TOKEN.findall(text)]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        t = self.peek()
        if not t or wanted and t != wanted:
            raise Unreadable(t)
        self.at += 1
        return t

    def whole(self):
        tree = self.listing() if self.peek() in ("(", "[", "\\{") else self.sum()
        if self.peek():
            raise Unreadable(self.peek())
        return tree

    def listing(self):
        """A tuple, interval or set, or an expression that only begins with a bracket."""
        start, opening = self.at, self.take()
        parts = [self.sum()]
        while self.peek() == ",":
            self.take()
            parts.append(self.sum())
        closing = self.take()
        if len(parts) == 1 and opening == "(":
            self.at = start
            return self.sum()
        if opening == "\\{":
            if closing != "\\}":
                raise Unreadable(closing)
            return ("set", *parts)
        return ("list", opening + closing, *parts)

    def sum(self):
        tree = self.product()
        while self.peek() in ("+", "-"):
            sign = self.take()
            right = self.product()
            tree = ("+", tree, right if sign == "+" else ("*", ("n", Fraction(-1)), right))
        return tree

    def product(self):
        tree, divided = self.signed(), False
        while True:
            t = self.peek()
            if t in ("*", "/"):
                self.take()
                tree, divided = (t, tree, self.signed()), t == "/"
            elif t and (t in ("(", "\\frac", "\\sqrt", "\\pi") or t.strip("\\") in _FUNCTIONS or t.isalpha()):
                if divided:
                    raise Unreadable("a product after a quotient")
                tree = ("*", tree, self.power())
            else:
                return tree

    def signed(self):
        if self.peek() in ("+", "-"):
            sign = self.take()
            tree = self.signed()
            return tree if sign == "+" else ("*", ("n", Fraction(-1)), tree)
        return self.power()

    def power(self):
        base = self.atom()
        if self.peek() == "^":
            self.take()
            return ("^", base, self.braced() if self.peek() == "{" else self.signed())
        return base

    def braced(self):
        self.take("{")
        tree = self.sum()
        self.take("}")
        return tree

    def argument(self):
        """In braces, or one digit or letter."""
        if self.peek() == "{":
            return self.braced()
        t = self.take()
        if t.isdigit():
            if len(t) > 1:
                self.at -= 1
                self.tokens[self.at] = t[1:]
            return ("n", Fraction(int(t[0])))
        if len(t) == 1 and t.isalpha():
            return ("v", t)
        raise Unreadable(t)

    def atom(self):
        t = self.take()
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            if len(t) > 40:
                raise Unreadable("a long number")
            return ("n", Fraction(t))
        if t in ("(", "{"):
            tree = self.sum()
            self.take(_CLOSES[t])
            return tree
        if t == "\\frac":
            top = self.argument()
            return ("/", top, self.argument())
        if t == "\\sqrt":
            if self.peek() == "[":
                raise Unreadable("a root of another degree")
            if self.peek() == "(":
                self.take()
                inner = self.sum()
                self.take(")")
                return ("root", inner)
            return ("root", self.argument())
        if t.strip("\\") in _FUNCTIONS:
            return ("f", t.strip("\\"), self.argument() if self.peek() == "{" else self.power())
        if t == "\\pi" or len(t) == 1 and t.isascii() and t.isalpha():
            return ("v", t)
        if len(t) == 2 and set(t) <= set("abcxyz"):
            return ("*", ("v", t[0]), ("v", t[1]))
        raise Unreadable(t)


def read(text: str):
    """The tree of a normalized answer; ``x=`` before it is left out."""
    if len(text) > MAX_CHARS:
        raise Unreadable("a long text")
    try:
        return _Reader(re.sub(r"^[a-z]=", "", text)).whole()
    except RecursionError as e:
        raise Unreadable("too deep") from e


# -- normal forms --------------------------------------------------------------------------------------------------
# A polynomial is a dict from monomials (sorted pairs of atom and exponent) to whole or rational numbers. Atoms are
# ("v", name), ("r", prime) with the prime as its square, and ("o", text) for what only stands for itself.


def _plus(a: dict, b: dict, sign: int = 1) -> dict:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, 0) + sign * c
        if not out[m]:
            del out[m]
    return out


def _times(a: dict, b: dict) -> dict:
    if len(a) * len(b) > 2 * MAX_TERMS:
        raise TooLarge
    out: dict = {}
    for m, c in a.items():
        for n, d in b.items():
            powers, x = dict(m), c * d
            for atom, e in n:
                powers[atom] = powers.get(atom, 0) + e
            for atom, e in list(powers.items()):
                if atom[0] == "r" and e > 1:
                    x *= atom[1] ** (e // 2)
                    powers[atom] = e % 2
            key = tuple(sorted((k, e) for k, e in powers.items() if e))
            out[key] = out.get(key, 0) + x
    out = {m: c for m, c in out.items() if c}
    if len(out) > MAX_TERMS:
        raise TooLarge
    return out


def _power(a: dict, n: int) -> dict:
    if n > MAX_POWER and (len(a) > 1 or any(a)):
        raise TooLarge
    if n > 4096:
        raise Unreadable("a huge power")
    out, square = {(): 1}, a
    while n:
        if n & 1:
            out = _times(out, square)
        n >>= 1
        if n:
            square = _times(square, square)
    return out


def _constant(p: dict) -> Fraction | None:
    return Fraction(p.get((), 0)) if set(p) <= {()} else None


def _root(x: Fraction) -> dict:
    """The square root of a number that is not negative, as a product of roots of primes."""
    n, outside, inside, p = x.numerator * x.denominator, Fraction(1, x.denominator), {}, 2
    if x < 0 or n > 10**24:
        raise Unreadable("a root")
    if not n:
        return {}
    while p * p <= n and p < 100_000:
        while n % p == 0:
            n //= p
            if inside.pop(("r", p), 0):
                outside *= p
            else:
                inside[("r", p)] = 1
        p += 1
    if n > 1:
        s = round(n**0.5)
        if s * s == n:
            outside *= s
        elif p * p > n:
            inside[("r", n)] = 1
        else:
            raise Unreadable("a root of a large number")
    return {tuple(sorted(inside.items())): outside}


def normal(tree) -> tuple[dict, dict]:
    """(numerator, denominator) of a tree."""
    kind = tree[0]
    if kind == "n":
        return ({(): tree[1]} if tree[1] else {}), {(): 1}
    if kind == "v":
        return {(((("o", tree[1]) if tree[1] in "ei" else ("v", tree[1])), 1),): 1}, {(): 1}
    if kind == "f":
        return {((_opaque(tree[1], tree[2]), 1),): 1}, {(): 1}
    if kind == "root":
        top, bottom = normal(tree[1])
        a, b = _constant(top), _constant(bottom)
        if a is None or not b:
            return {((_opaque("root", tree[1]), 1),): 1}, {(): 1}
        return _root(a / b), {(): 1}
    (a, b), (c, d) = normal(tree[1]), normal(tree[2])
    if kind == "+":
        return (_plus(a, c), b) if b == d else (_plus(_times(a, d), _times(c, b)), _times(b, d))
    if kind == "*":
        return _times(a, c), _times(b, d)
    if kind == "/":
        if not c:
            raise Unreadable("division by zero")
        return _times(a, d), _times(b, c)
    top, bottom = _constant(c), _constant(d)
    n = top / bottom if top is not None and bottom else None
    if n is not None and n.denominator == 1:
        n = int(n)
        if n < 0 and not a:
            raise Unreadable("division by zero")
        return (_power(a, n), _power(b, n)) if n >= 0 else (_power(b, -n), _power(a, -n))
    if n == Fraction(1, 2):
        return normal(("root", tree[1]))
    return {((_opaque("^", tree[1], tree[2]), 1),): 1}, {(): 1}


def _opaque(name: str, *trees) -> tuple:
    return ("o", name + repr([[sorted(p.items()) for p in normal(t)] for t in trees]))


def at_point(tree, point: dict, prime: int) -> int:
    """The value of a tree without roots and functions at a point modulo a prime; ZeroDivisionError where it has none."""
    kind = tree[0]
    if kind == "n":
        return tree[1].numerator * pow(tree[1].denominator, -1, prime) % prime
    if kind == "v" and tree[1] not in "ei":
        return point.setdefault(tree[1], random.Random(f"{point['seed']}{tree[1]}").randrange(prime))
    if kind in ("f", "root", "v"):
        raise Unreadable("no number")
    a = at_point(tree[1], point, prime)
    if kind == "^":
        top, bottom = map(_constant, normal(tree[2]))
        n = top / bottom if top is not None and bottom else None
        if n is None or n.denominator != 1:
            raise Unreadable("a symbolic power")
        if n < 0 and not a:
            raise ZeroDivisionError
        return pow(a, int(n), prime)
    b = at_point(tree[2], point, prime)
    if kind == "/":
        if not b:
            raise ZeroDivisionError
        return a * pow(b, -1, prime) % prime
    return (a + b if kind == "+" else a * b) % prime


def _agree_at_points(p, g) -> bool | None:
    seed, tried = hashlib.md5(repr((p, g)).encode()).hexdigest(), 0
    for i in range(4 * POINTS):
        for prime in PRIMES:
            try:
                same = at_point(p, {"seed": f"{seed}{i}{prime}"}, prime) == at_point(g, {"seed": f"{seed}{i}{prime}"}, prime)
            except ZeroDivisionError:
                continue
            if not same:
                return False
            tried += 1
        if tried >= POINTS * len(PRIMES):
            return True
    return None


def same_value(p, g) -> bool | None:
    """Are two trees equal? None where that is not decided."""
    if p[0] in ("set", "list") or g[0] in ("set", "list"):
        return _same_parts(p, g)
    try:
        (a, b), (c, d) = normal(p), normal(g)
        rest = _plus(_times(a, d), _times(c, b), -1)
    except TooLarge:
        return _agree_at_points(p, g)
    if not rest:
        return True
    return None if any(atom[0] == "o" for m in rest for atom, _ in m) else False


def _same_parts(p, g) -> bool | None:
    if p[0] != g[0]:
        return None
    if p[0] == "list":
        if p[1] != g[1] or len(p) != len(g):
            return False
        return _all(same_value(x, y) for x, y in zip(p[2:], g[2:]))
    one = lambda x, others: _any(same_value(x, y) for y in others)
    return _all([*(one(x, g[1:]) for x in p[1:]), *(one(x, p[1:]) for x in g[1:])])


def _all(found) -> bool | None:
    found = list(found)
    return False if False in found else None if None in found else True


def _any(found) -> bool | None:
    found = list(found)
    return True if True in found else None if None in found else False


def verdict(prediction: str, gold: str) -> bool | None:
    """Are two normalized answers equal expressions? None if one is unreadable or it is not decided."""
    try:
        return same_value(read(prediction), read(gold))
    except (Unreadable, TooLarge, OverflowError):
        return None


_remembered = lru_cache(maxsize=REMEMBERED)(verdict)


def _decided(prediction: str, gold: str) -> bool | None:
    """``verdict``, remembered; texts too long to be read are not."""
    return None if max(len(prediction), len(gold)) > MAX_CHARS else _remembered(prediction, gold)


# -- columns -------------------------------------------------------------------------------------------------------


def _verdicts(p, g):
    import pandas as pd

    return pd.Series([None if a is None or b is None else _decided(a, b) for a, b in zip(p, g)], dtype=object)


def algebraically_equal(prediction: Column, gold: Column) -> Column:
    """``equivalent``, and what it leaves undecided as expressions; NULL if that does not decide it either."""
    native = equivalent(prediction, gold)
    ask = lambda c: F.when(native.isNull(), normalize_answer(c))
    return F.coalesce(native, F.pandas_udf(_verdicts, "boolean")(ask(prediction), ask(gold)))


def with_equality(df: DataFrame, prediction: str, gold: str, out: str = "equal") -> DataFrame:
    """The rows with ``algebraically_equal`` of two columns as ``out``: each different pair is decided once and joined back.

    Pairs are dealt over the cores by their texts, however few files or tasks the rows are in.
    """
    pairs = df.select(F.col(prediction).alias("_p"), F.col(gold).alias("_g")).distinct()
    pairs = pairs.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, "_p", "_g")
    decided = pairs.select("_p", "_g", algebraically_equal(F.col("_p"), F.col("_g")).alias(out))
    same = F.col(prediction).eqNullSafe(F.col("_p")) & F.col(gold).eqNullSafe(F.col("_g"))
    return df.join(decided, same, "left").drop("_p", "_g")


def _first(candidates, answer):
    import pandas as pd

    out = []
    for values, gold in zip(candidates, answer):
        at = None
        for i, x in enumerate(() if values is None or gold is None else values):
            if x is not None and _decided(x, gold):
                at = i + 1
                break
        out.append(at)
    return pd.Series(out, dtype="Int64")


def first_equal(candidates: Column, answer: Column) -> Column:
    """Place (from 1) of the first candidate that equals the answer, NULL if none does.

    Those before the first equal number or text, and not decided by numbers, are
    compared as expressions.
    """
    hits = F.transform(candidates, lambda c: equivalent(c, answer))
    native = F.array_position(hits, F.lit(True))
    before = F.when(native > 0, F.slice(candidates, F.lit(1), (native - 1).cast("int"))).otherwise(candidates)
    unsure = F.transform(before, lambda c: F.when(equivalent(c, answer).isNull(), normalize_answer(c)))
    some = F.when(F.exists(unsure, lambda c: c.isNotNull()), unsure)
    found = F.pandas_udf(_first, "long")(some, F.when(some.isNotNull(), normalize_answer(answer)))
    return F.coalesce(found, F.when(native > 0, native)).cast("int")


def _restates(now, earlier):
    import pandas as pd

    out = []
    for a_values, b_values in zip(now, earlier):
        pairs = [(a, b) for a in (() if a_values is None else a_values) for b in (() if b_values is None else b_values) if a != b]
        out.append(any(_decided(*pair) for pair in pairs))
    return pd.Series(out, dtype=bool)


def restates(now: Column, earlier: Column) -> Column:
    """Do two lists hold values that are written differently and equal, as numbers or as expressions?"""
    ask = lambda c: F.when((F.size(now) > 0) & (F.size(earlier) > 0), F.transform(c, normalize_answer))
    return F.pandas_udf(_restates, "boolean")(ask(now), ask(earlier))
