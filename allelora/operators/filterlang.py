"""The annotation filter language, compiled to Spark columns.

    expr    := "(" expr ")" [("&" | "|") expr] | cmp [("&" | "|") expr]
    cmp     := operand op operand        op := == != < > <= >= =~ !~

Operators have one precedence and bind to the right: ``a & b | c`` is ``a & (b | c)``. ``==`` and ``!=`` compare texts, the
four orders compare the numbers that texts begin with (0 if none), ``=~`` and ``!~`` search a regular
expression. An operand that begins with a quote, digit or sign is a literal; FILTER and QUAL are columns; any other
word, quoted or not on the right side alike, is an info key, and an absent key is the empty text. Flags have the text ".".
Text after a closing bracket that none opened is ignored, and brackets still open at the end are closed. A comparison with a missing QUAL is false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from allelora.functions.text import atof, g6

_QUOTED = r"""(?P<{0}quote>['"])(?P<{0}body>(?:\\.|(?!(?P={0}quote))[^\\])*)(?P={0}quote)\s*"""
#: One comparison with the brackets that open before it: an operand, which a comparison sign ends, the sign, and an operand that a closing
#: bracket or a logical sign ends.
_CLAUSE = re.compile(
    rf"\s*(?P<opened>(?:\(\s*)*)(?:{_QUOTED.format('left_')}|(?P<left>[^=<>!]+))(?P<sign>[=<>!][=<>!~]*)\s*(?:{_QUOTED.format('right_')}|(?P<right>[^)&|]+))", re.S
)
_CLOSED, _LOGIC = re.compile(r"\)\s*"), re.compile(r"\s*([&|])")


class FilterError(ValueError):
    """The expression is not in the language."""


def _operand(clause: re.Match, side: str) -> Column:
    """The text of a clause's left or right operand."""
    if clause[side] is None:
        return F.lit(re.sub(r"\\(.)", r"\1", clause[f"{side}_body"], flags=re.S))
    word = clause[side].rstrip(" ")
    if not word or word[0] in "'\"":
        raise FilterError(f"an operand is missing or its quote isn't closed: {clause[0]}")
    if word[0].isdigit() or word[0] in "+-":
        return F.lit(word)
    named = {"FILTER": lambda: F.array_join("filters", ";"), "QUAL": lambda: F.coalesce(g6(F.col("qual")), F.lit("nan"))}
    return F.coalesce(named.get(word, lambda: F.col("info")[word])(), F.lit(""))


_SIGNS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "=~": F.regexp_like,
    "!~": lambda a, b: ~F.regexp_like(a, b),
    "<": lambda a, b: atof(a) < atof(b),
    ">": lambda a, b: atof(a) > atof(b),
    "<=": lambda a, b: atof(a) <= atof(b),
    ">=": lambda a, b: atof(a) >= atof(b),
}


def _comparison(clause: re.Match) -> Column:
    if clause["sign"] not in _SIGNS:
        raise FilterError(f"no comparison: {clause[0]}")
    return F.coalesce(_SIGNS[clause["sign"]](_operand(clause, "left"), _operand(clause, "right")), F.lit(False))


def _folded(terms: list) -> Column:
    """Conditions and the signs between them, folded from the right."""
    made = terms[-1]
    for condition, sign in zip(terms[-3::-2], terms[-2::-2]):
        made = condition & made if sign == "&" else condition | made
    return made


def _condition(text: str) -> Column:
    groups: list[list] = [[]]
    at, more = 0, True
    while more:
        clause = _CLAUSE.match(text, at)
        if not clause:
            raise FilterError(f"no comparison at {at}: {text}")
        groups += [[] for _ in range(clause["opened"].count("("))]
        groups[-1].append(_comparison(clause))
        at = clause.end()
        while closed := _CLOSED.match(text, at):
            if len(groups) == 1:
                return _folded(groups[0])
            inner = _folded(groups.pop())
            groups[-1].append(inner)
            at = closed.end()
        sign = _LOGIC.match(text, at)
        if sign:
            groups[-1].append(sign[1])
            at = sign.end()
        elif text[at:].strip():
            raise FilterError(f"no logical operator at {at}: {text}")
        more = bool(sign)
    while len(groups) > 1:
        inner = _folded(groups.pop())
        groups[-1].append(inner)
    return _folded(groups[0])


def compile_filter(text: str) -> Column:
    """The condition of a filter expression; an empty one is always true. Raises FilterError (a ValueError)."""
    if not text.strip():
        return F.lit(True)
    return _condition(text)
