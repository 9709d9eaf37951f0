"""A rule language over staged values, compiled to columns with three-valued logic.

    rule    := any ("or" any)*        any := one ("and" one)*       one := "not" one | "(" rule ")" | test
    test    := "exists(" ref ")" | "missing(" ref ")" | side (op side)?      ref := code "." stage
SQL's logic of nulls is the language's: unknown is null. ``and``, ``or`` and ``not`` bind as usual.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(
    r"""(?P<number>\d+(?:[.,]\d+)?)|(?P<text>"[^"]*"|'[^']*')|(?P<op><=|>=|==|!=|[=<>()])"""
    r"""|(?P<name>[\w#\-]+(?:\.(?:PD|RD|ID))?)|(?P<bad>\S)"""
)
OPS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}
#: How strongly each operator binds, from the loosest.
BINDING = {"or": 1, "and": 2} | dict.fromkeys(("=", "==", "!=", *OPS), 4)
NOT = 3
END = ("end", "the end", -1)


class RuleError(ValueError):
    """A rule that can't be read, with the place in its text."""


@dataclass(frozen=True)
class Ref:
    code: str
    stage: str

    @property
    def column(self) -> str:
        return f"{self.code}.{self.stage}"


class Reader:
    """Reads a rule by precedence climbing into nested tuples (kind, parts...); values stay as they are."""

    def __init__(self, text: str):
        self.text = text
        self.queue = deque((m.lastgroup or "", m[0], m.start()) for m in WORD.finditer(text))
        self.queue.append(END)

    def wrong(self, expected: str) -> RuleError:
        return RuleError(f"expected {expected} instead of {self.queue[0][1]!r} at {self.queue[0][2]} of {self.text!r}")

    def met(self, *words: str) -> str | None:
        """The next word, taken, if it is one of these."""
        kind, word, _ = self.queue[0]
        if kind in ("op", "name") and word.lower() in words:
            self.queue.popleft()
            return word.lower()
        return None

    def whole(self):
        tree = truth(self.expression(0))
        if self.queue[0] != END:
            raise self.wrong("the end")
        return tree

    def expression(self, least: int):
        left = self.operand()
        while (word := self.queue[0][1].lower()) in BINDING and self.queue[0][0] != "text" and BINDING[word] >= least:
            self.queue.popleft()
            right = self.expression(BINDING[word] + 1)
            if word in ("and", "or"):
                left = (word, truth(left), truth(right))
            elif isinstance(left, tuple) or isinstance(right, tuple):
                raise RuleError(f"{word!r} compares values, not conditions, in {self.text!r}")
            else:
                left = ("compare", "==" if word == "=" else word, left, right)
        return left

    def operand(self):
        if self.met("not"):
            return ("not", truth(self.expression(NOT)))
        if self.met("("):
            inside = truth(self.expression(0))
            if not self.met(")"):
                raise self.wrong("a closing bracket")
            return inside
        if test := self.met("exists", "missing"):
            ref = self.operand() if self.queue[0][1] == "(" and self.queue.popleft() else None
            if not isinstance(ref, Ref) or not self.met(")"):
                raise self.wrong(f"a bracketed reference after {test}")
            return (test, ref)
        return self.value()

    def value(self):
        kind, word, _ = self.queue[0]
        out = None
        if kind == "number":
            out = float(word.replace(",", "."))
        elif kind == "text":
            out = word[1:-1]
        elif kind == "name" and word.lower() in ("true", "false"):
            out = word.lower() == "true"
        elif kind == "name" and "." in word:
            out = Ref(*word.rsplit(".", 1))
        if out is None:
            raise self.wrong("a value")
        self.queue.popleft()
        return out


def truth(tree):
    """A value where a condition is wanted is true or false by itself."""
    return tree if isinstance(tree, tuple) else ("truth", tree)


def refs(tree) -> set[Ref]:
    """All references in a rule."""
    found, open_ = set(), [tree]
    while open_:
        now = open_.pop()
        if isinstance(now, Ref):
            found.add(now)
        elif isinstance(now, tuple):
            open_.extend(now)
    return found


def unknown_codes(rules: Iterable[tuple[str, str, str]], codes: Iterable[str]) -> dict[str, list[str]]:
    """By rule, the codes it refers to that aren't known; a rule that can't be read counts with its error."""
    known, out = set(codes), {}
    for rule_id, condition, expected in rules:
        try:
            used = {r.code for part in (condition, expected) for r in refs(Reader(part).whole())}
            if used - known:
                out[rule_id] = sorted(used - known)
        except RuleError as e:
            out[rule_id] = [str(e)]
    return out


def typed(side) -> tuple[Column, Column, Column]:
    """(number, text, boolean) of a constant or of a reference's struct column."""
    none = lambda kind: F.lit(None).cast(kind)
    if isinstance(side, Ref):
        c = F.col(f"`{side.column}`")
        return c["num"], F.lower(c["str"]), c["bool"]
    if isinstance(side, bool):
        return none("double"), none("string"), F.lit(side)
    if isinstance(side, float):
        return F.lit(side), none("string"), none("boolean")
    return none("double"), F.lower(F.lit(side)), none("boolean")


def compile_tree(tree) -> Column:
    """A boolean column, null where the rule's truth is unknown."""
    kind = tree[0]
    if kind in ("and", "or"):
        out = compile_tree(tree[1])
        for part in tree[2:]:
            out = out & compile_tree(part) if kind == "and" else out | compile_tree(part)
        return out
    if kind == "not":
        return ~compile_tree(tree[1])
    if kind in ("exists", "missing"):
        n, s, b = typed(tree[1])
        there = n.isNotNull() | s.isNotNull() | b.isNotNull()
        return there if kind == "exists" else ~there
    if kind == "truth":
        return typed(tree[1])[2]
    _, op, left, right = tree
    (n1, s1, b1), (n2, s2, b2) = typed(left), typed(right)
    if op in ("==", "!="):
        near = F.abs(n1 - n2) <= F.lit(1e-9) * F.greatest(F.abs(n1), F.abs(n2))
        same = F.coalesce(near, s1 == s2, b1 == b2)
        return same if op == "==" else ~same
    return OPS[op](n1, n2)  # order is for numbers; all else is unknown


def compile_rules(rules: Iterable[tuple[str, str, str]]) -> tuple[dict[str, tuple[Column, Column, set[Ref]]], dict[str, str]]:
    """Compiled (condition, expected) by id, and the errors of rules that can't be read, which are skipped."""
    good, bad = {}, {}
    for rule_id, condition, expected in rules:
        try:
            trees = Reader(condition).whole(), Reader(expected).whole()
            good[rule_id] = (compile_tree(trees[0]), compile_tree(trees[1]), refs(trees[0]) | refs(trees[1]))
        except RuleError as e:
            bad[rule_id] = str(e)
    return good, bad


def fired(values: DataFrame, rules: Iterable[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """(keys, rule) where a condition is true and what is expected false.

    ``values`` has keys, code, stage, num, str, bool. A stage with several different values is
    missing. One aggregation puts every referenced value beside its point; all rules read that row.
    """
    compiled, _ = compile_rules(rules)
    wanted = sorted(set().union(*(r for _, _, r in compiled.values())), key=lambda r: r.column) if compiled else []
    value = F.struct(F.col("num"), F.col("str"), F.col("bool"))
    cells = []
    for r in wanted:
        here = F.when((F.col("code") == r.code) & (F.col("stage") == r.stage), value)
        cells.append(F.when(F.min(here).eqNullSafe(F.max(here)), F.min(here)).alias(r.column))
    nothing = values.select(*keys).withColumn("rule", F.lit("")).filter("false")
    if not cells:
        return nothing
    wide = values.groupBy(*keys).agg(*cells)
    hits = F.array_compact(F.array(*(F.when(c & (e == F.lit(False)), F.lit(i)) for i, (c, e, _) in compiled.items())))
    return wide.select(*keys, F.explode(hits).alias("rule"))
