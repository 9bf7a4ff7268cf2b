"""Memoised parsing with derivatives over hash-consed grammar nodes.

The derivative of a language by a token is what may follow the token. Nodes are small integers; equal nodes are the same
integer, so the derivative of every (node, token) is computed once in a process and looked up ever after. An empty
derivative marks the exact token at which a text stops being a prefix of the language; a text whose last derivative is
not nullable is cut short.

Grammars are written as ``name = alternatives`` rules: 'quoted' tokens, names, (groups), [options], ``*`` and ``+``.
They must not be left-recursive."""

from __future__ import annotations

import re

EMPTY, EPS = 0, 1


class Derivatives:
    def __init__(self, grammar: str, limit: int = 1_000_000):
        self.grammar, self.limit = grammar, limit
        self.reset()

    def reset(self) -> None:
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.known: dict[tuple, int] = {n: i for i, n in enumerate(self.nodes)}
        self.memo: dict[tuple[int, str], int] = {}
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.rules: dict[str, int] = {}
        for rule in re.split(r"\n(?=\w+ *=)", self.grammar.strip()):
            name, body = rule.split("=", 1)
            self.rules[name.strip()] = self._parse(body)
        nullable: set[str] = set()
        while True:
            now = {n for n, body in self.rules.items() if self._null(body, nullable, {})}
            if now == nullable:
                break
            nullable = now
        self.nullable_rules = nullable

    # -- construction
    def _node(self, *n) -> int:
        i = self.known.get(n)
        if i is None:
            i = self.known[n] = len(self.nodes)
            self.nodes.append(n)
        return i

    def token(self, t: str) -> int:
        return self._node("tok", t)

    def cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        n = self.nodes[a]
        if n[0] == "cat":
            return self._node("cat", n[1], self.cat(n[2], b))
        return self._node("cat", a, b)

    def alt(self, *parts: int) -> int:
        flat: set[int] = set()
        for p in parts:
            n = self.nodes[p]
            if n[0] == "alt":
                flat.update(n[1])
            elif p != EMPTY:
                flat.add(p)
        if not flat:
            return EMPTY
        if len(flat) == 1:
            return flat.pop()
        return self._node("alt", tuple(sorted(flat)))

    def star(self, a: int) -> int:
        return EPS if a in (EMPTY, EPS) else self._node("star", a)

    def _parse(self, body: str) -> int:
        toks = re.findall(r"'[^']+'|\w+|[()\[\]*+|]", body)
        at = 0

        def alternatives() -> int:
            nonlocal at
            parts = [sequence()]
            while at < len(toks) and toks[at] == "|":
                at += 1
                parts.append(sequence())
            return self.alt(*parts)

        def sequence() -> int:
            nonlocal at
            parts = []
            while at < len(toks) and toks[at] not in ("|", ")", "]"):
                t = toks[at]
                at += 1
                if t == "(":
                    x = alternatives()
                    at += 1
                elif t == "[":
                    x = self.alt(EPS, alternatives())
                    at += 1
                elif t[0] == "'":
                    x = self.token(t[1:-1])
                else:
                    x = self._node("ref", t)
                if at < len(toks) and toks[at] in ("*", "+"):
                    x = self.star(x) if toks[at] == "*" else self.cat(x, self.star(x))
                    at += 1
                parts.append(x)
            out = EPS
            for x in reversed(parts):
                out = self.cat(x, out)
            return out

        return alternatives()

    # -- nullability and derivatives
    def _null(self, i: int, rules: set[str], known: dict[int, bool]) -> bool:
        got = known.get(i)
        if got is None:
            n = self.nodes[i]
            kind = n[0]
            if kind == "cat":
                got = self._null(n[1], rules, known) and self._null(n[2], rules, known)
            elif kind == "alt":
                got = any(self._null(x, rules, known) for x in n[1])
            else:
                got = n[1] in rules if kind == "ref" else kind in ("eps", "star")
            known[i] = got
        return got

    def nullable(self, i: int) -> bool:
        got = self.null.get(i)
        return self._null(i, self.nullable_rules, self.null) if got is None else got

    def derive(self, i: int, t: str) -> int:
        got = self.memo.get((i, t))
        if got is not None:
            return got
        n = self.nodes[i]
        kind = n[0]
        if kind == "tok":
            out = EPS if n[1] == t else EMPTY
        elif kind == "cat":
            out = self.cat(self.derive(n[1], t), n[2])
            if self.nullable(n[1]):
                out = self.alt(out, self.derive(n[2], t))
        elif kind == "alt":
            out = self.alt(*(self.derive(x, t) for x in n[1]))
        elif kind == "star":
            out = self.cat(self.derive(n[1], t), i)
        elif kind == "ref":
            out = self.derive(self.rules[n[1]], t)
        else:
            out = EMPTY
        self.memo[i, t] = out
        return out

    def start(self, rule: str) -> int:
        if len(self.memo) > self.limit:
            self.reset()
        return self._node("ref", rule)

    def run(self, rule: str, tokens) -> tuple[int, int]:
        """(last node, number of tokens read before the derivative became empty, -1 if it never did)."""
        node, memo = self.start(rule), self.memo
        for k, t in enumerate(tokens):
            nxt = memo.get((node, t))
            node = self.derive(node, t) if nxt is None else nxt
            if node == EMPTY:
                return EMPTY, k
        return node, -1
