"""Memoised parsing with derivatives.

A grammar is a set of interned language nodes: empty, epsilon, token set, sequence, alternative, repetition and named
rule. The derivative of a node by a token is the language of what may still follow; it is kept for each (node, token).
A token that leaves the empty language is the exact failing token; an end that is not nullable is a truncation.
Rules must not be left-recursive, so a derivative needs no fixed point. Ambiguity costs nothing: alternatives merge."""

from __future__ import annotations

import re

EMPTY, EPSILON = 0, 1
_PART = re.compile(r"'[^']+'|[A-Za-z_]\w*|[=|()\[\]{}.;]")


class Grammar:
    """Rules as ``name = a 'x' [ optional ] { repeated } ( b | c ) ;``; upper-case names are token kinds."""

    def __init__(self, rules: str, start: str) -> None:
        self.nodes: list[tuple] = [("0",), ("1",)]
        self._ids: dict[tuple, int] = {("0",): 0, ("1",): 1}
        self.rules: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self._null: dict[int, bool] = {0: False, 1: True}
        self._first: dict[int, frozenset[int]] = {0: frozenset(), 1: frozenset()}
        self._derived: dict[tuple[int, int], int] = {}
        parts = _PART.findall(rules)
        at = 0
        while at < len(parts):
            node, after = self._alternatives(parts, at + 2)
            self.rules[parts[at]] = node
            at = after + 1
        self.start = self._node(("n", start))

    # Construction.

    def _node(self, key: tuple) -> int:
        found = self._ids.get(key)
        if found is None:
            found = self._ids[key] = len(self.nodes)
            self.nodes.append(key)
        return found

    def token(self, name: str) -> int:
        return self.tokens.setdefault(name, len(self.tokens))

    def seq(self, a: int, b: int) -> int:
        """Sequences are kept to the right, so that the parts of ``a`` are put before ``b`` one by one."""
        if not a or not b:
            return EMPTY
        if b == EPSILON:
            return a
        parts, nodes = [], self.nodes
        while nodes[a][0] == "s":
            parts.append(nodes[a][1])
            a = nodes[a][2]
        if a != EPSILON:
            parts.append(a)
        for part in reversed(parts):
            b = self._node(("s", part, b))
        return b

    def alt(self, several: list[int]) -> int:
        flat: set[int] = set()
        for a in several:
            x = self.nodes[a]
            flat.update(x[1]) if x[0] == "|" else flat.add(a)
        flat.discard(EMPTY)
        if len(flat) < 2:
            return flat.pop() if flat else EMPTY
        return self._node(("|", tuple(sorted(flat))))

    def _alternatives(self, parts: list[str], at: int) -> tuple[int, int]:
        found, sequence = [], []
        while True:
            p = parts[at]
            if p in "|;)]}":
                node = EPSILON
                for x in reversed(sequence):
                    node = self.seq(x, node)
                found.append(node)
                sequence = []
                if p != "|":
                    return self.alt(found), at
                at += 1
            elif p in "([{":
                node, at = self._alternatives(parts, at + 1)
                sequence.append(node if p == "(" else self.alt([node, EPSILON]) if p == "[" else self._node(("*", node)))
                at += 1
            else:
                name = p.strip("'")
                sequence.append(self._node(("t", self.token(name))) if p[0] == "'" or p.isupper() else self._node(("n", name)))
                at += 1

    # Properties. Each is worked out with a stack of its own, so that no depth of nesting exhausts the interpreter's.

    def _needs(self, a: int) -> tuple[int, ...]:
        x = self.nodes[a]
        k = x[0]
        return (x[1], x[2]) if k == "s" else x[1] if k == "|" else (x[1],) if k == "*" else (self.rules[x[1]],) if k == "n" else ()

    def nullable(self, a: int) -> bool:
        known = self._null
        found = known.get(a)
        if found is not None:
            return found
        stack = [a]
        while stack:
            a = stack[-1]
            x = self.nodes[a]
            k = x[0]
            needs = self._needs(a) if k != "*" else ()
            if k == "s" and not known.get(x[1], True):  # what follows doesn't matter, and may lead back here
                needs = needs[:1]
            missing = [y for y in needs if y not in known][: 1 if k == "s" else None]
            if missing:
                stack += missing
                continue
            known[a] = k == "*" or k != "t" and (any if k == "|" else all)(known[y] for y in needs)
            stack.pop()
        return known[a]

    def first(self, a: int) -> frozenset[int]:
        known = self._first
        found = known.get(a)
        if found is not None:
            return found
        stack = [a]
        while stack:
            a = stack[-1]
            x = self.nodes[a]
            k = x[0]
            if k == "t":
                known[a] = frozenset([x[1]])
                stack.pop()
                continue
            needs = self._needs(a)
            if k == "s" and not self.nullable(x[1]):
                needs = needs[:1]
            missing = [y for y in needs if y not in known]
            if missing:
                stack += missing
            else:
                known[a] = known[needs[0]] if len(needs) == 1 else frozenset().union(*(known[y] for y in needs))
                stack.pop()
        return known[a]

    def derive(self, a: int, token: int) -> int:
        known = self._derived
        found = known.get((a, token))
        if found is not None:
            return found
        stack = [a]
        while stack:
            a = stack[-1]
            x = self.nodes[a]
            k = x[0]
            if token not in self.first(a):
                found = EMPTY
            elif k == "t":
                found = EPSILON
            else:
                needs = self._needs(a)
                if k == "s" and not self.nullable(x[1]):
                    needs = needs[:1]
                missing = [y for y in needs if (y, token) not in known]
                if missing:
                    stack += missing
                    continue
                if k == "s":
                    found = self.seq(known[x[1], token], x[2])
                    if len(needs) == 2:
                        found = self.alt([found, known[x[2], token]])
                elif k == "|":
                    found = self.alt([known[y, token] for y in needs])
                else:
                    found = self.seq(known[x[1], token], a) if k == "*" else known[needs[0], token]
            known[a, token] = found
            stack.pop()
        return found
