"""The query language: words, "phrases", AND, OR, NOT and parentheses. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass, field

BINDING = {"OR": 1, "AND": 2, "NOT": 3}


def _letter(c: str) -> bool:
    return c.isalnum() or c == "_"


def _operator_at(query: str, i: int) -> int:
    """Length of the operator, in any case, that stands at i as a whole word; 0 if none does."""
    for name in BINDING:
        n = len(name)
        if query[i : i + n].upper() == name and not (i and _letter(query[i - 1])) and not (i + n < len(query) and _letter(query[i + n])):
            return n
    return 0


def split_query(query: str) -> list[str]:
    """Phrases with their quotes, parentheses, operators and words, in order. A quote that isn't closed, or closed at
    once, is part of a word; a word goes on to white space or a parenthesis, operators inside it included."""
    out, i = [], 0
    while i < len(query):
        c = query[i]
        end = query.find('"', i + 1) if c == '"' else -1
        if c.isspace():
            i += 1
            continue
        if end > i + 1:
            j = end + 1
        elif c in "()":
            j = i + 1
        else:
            j = i + _operator_at(query, i)
            while j == i or (not _operator_at(query, i) and j < len(query) and not query[j].isspace() and query[j] not in "()"):
                j += 1
        out.append(query[i:j])
        i = j
    return out


def is_boolean(parts: list[str]) -> bool:
    """Upper-case operators make a query boolean; parentheses alone do not."""
    return any(p in BINDING for p in parts)


def is_phrase(part: str) -> bool:
    return len(part) > 1 and part[0] == part[-1] == '"'


@dataclass
class Node:
    """A leaf (op None) or an operator. positive: whether some leaf counts with, and with NOT against, it."""

    op: str | None
    leaf: str = ""
    kids: list[Node] = field(default_factory=list)

    def polarity(self) -> tuple[bool, bool]:
        if self.op is None:
            return True, False
        if self.op == "NOT":
            plus, minus = self.kids[0].polarity()
            return minus, plus
        each = [k.polarity() for k in self.kids]
        return any(p for p, _ in each), any(m for _, m in each)

    def rpn(self) -> list[str]:
        if self.op is None:
            return [self.leaf]
        return [x for k in self.kids for x in k.rpn()] + [self.op]

    def leaves(self) -> list[str]:
        return [self.leaf] if self.op is None else [x for k in self.kids for x in k.leaves()]


def parse(parts: list[str]) -> Node:
    """Tree of a boolean query, by precedence climbing. Neighbouring operands are joined by AND; an unclosed
    parenthesis becomes an operand that matches nothing, a stray closing one is ignored.

    ValueError: a missing operand, a lower-case operator, or no positive clause."""
    for p in parts:
        if p.upper() in BINDING and p not in BINDING:
            raise ValueError(f"operator {p!r} must be upper-case in a boolean query")
    at = 0
    depth = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def operand() -> Node:
        nonlocal at, depth
        p = peek()
        if p is None or p in ("AND", "OR"):
            raise ValueError("malformed query: an operand is missing")
        at += 1
        if p == "NOT":
            return Node("NOT", kids=[operand()])
        if p == "(":
            depth += 1
            inside = expression(1)
            if peek() == ")":
                at += 1
                depth -= 1
                return inside
            depth -= 1
            return Node("AND", kids=[Node(None, "("), inside])
        if p == ")":
            if depth:
                raise ValueError("malformed query: an operand is missing")
            return operand()
        return Node(None, p)

    def expression(least: int) -> Node:
        nonlocal at
        left = operand()
        while (p := peek()) is not None:
            if p == ")":
                if depth:
                    break
                at += 1
                continue
            op = p if p in ("AND", "OR") else "AND"
            if BINDING[op] < least:
                break
            if p in ("AND", "OR"):
                at += 1
            left = Node(op, kids=[left, expression(BINDING[op] + 1)])
        return left

    tree = expression(1)
    if not tree.polarity()[0]:
        raise ValueError("a boolean query needs a positive clause")
    return tree
