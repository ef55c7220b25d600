"""CSS selectors over the tree: types, classes, ids, attributes, combinators, groups and the usual pseudo-classes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from webloom.html.tree import Node

Test = Callable[[Node], bool]
_PART = re.compile(
    r"\s*(?P<comb>[>+~])\s*|(?P<space>\s+)|(?P<tag>\*|[A-Za-z_][\w|-]*)|#(?P<id>(?:\\.|[\w-])+)|\.(?P<cls>(?:\\.|[\w-])+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]|::?(?P<pseudo>[\w-]+)"
)


class SelectorError(ValueError):
    code = "SELECTOR_INVALID"


def split_groups(selector: str) -> list[str]:
    """The parts of a selector list; commas in brackets, parentheses and quotes don't count."""
    out, depth, quote, now = [], 0, "", ""
    for c in selector:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(now.strip())
            now = ""
            continue
        now += c
    return [*out, now.strip()]


def _attr(name: str, op: str | None, value: str, fold: bool) -> Test:
    name = name.lower()
    low = (lambda s: s.lower()) if fold else (lambda s: s)
    want = low(value)
    tests = {
        None: lambda v: True,
        "=": lambda v: low(v) == want,
        "~=": lambda v: want in low(v).split() and bool(want),
        "|=": lambda v: low(v) == want or low(v).startswith(want + "-"),
        "^=": lambda v: bool(want) and low(v).startswith(want),
        "$=": lambda v: bool(want) and low(v).endswith(want),
        "*=": lambda v: bool(want) and want in low(v),
    }
    test = tests[op]
    return lambda n: name in n.attrs and test(n.attrs[name])


def _nth(text: str) -> tuple[int, int]:
    t = text.replace(" ", "").lower()
    t = {"odd": "2n+1", "even": "2n"}.get(t, t)
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", t):
        return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", t):
        return 0, int(t)
    raise SelectorError(f"invalid position: {text!r}")


def _at(place: int, a: int, b: int) -> bool:
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def _siblings(n: Node) -> list[Node]:
    return n.parent.elements() if n.parent else [n]


def _pseudo(name: str, arg: str | None) -> Test:
    name = name.lower()
    same = lambda n: [s for s in _siblings(n) if s.tag == n.tag]
    if name == "first-child":
        return lambda n: _siblings(n)[0] is n
    if name == "last-child":
        return lambda n: _siblings(n)[-1] is n
    if name == "only-child":
        return lambda n: len(_siblings(n)) == 1
    if name == "first-of-type":
        return lambda n: same(n)[0] is n
    if name == "last-of-type":
        return lambda n: same(n)[-1] is n
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        a, b = _nth(arg or "")

        def nth(n: Node) -> bool:
            of = same(n) if "of-type" in name else _siblings(n)
            place = next(k for k, s in enumerate(of) if s is n)
            return _at(len(of) - place if "last" in name else place + 1, a, b)

        return nth
    if name == "not":
        inner = compile_selector(arg or "")
        return lambda n: not inner.matches(n)
    if name in ("is", "where", "matches"):
        inner = compile_selector(arg or "")
        return inner.matches
    if name == "has":
        inner = compile_selector(arg or "")
        return lambda n: bool(inner.select(n))
    if name == "contains":
        want = (arg or "").strip().strip("\"'")
        return lambda n: want in n.text()
    if name == "empty":
        return lambda n: not n.children
    if name in ("checked", "selected", "disabled"):
        return lambda n: name in n.attrs
    if name == "root":
        return lambda n: n.parent is not None and n.parent.tag == "#document"
    raise SelectorError(f"unknown pseudo-class :{name}")


#: Positions among the nodes that a selector has found so far.
_POSITION = {"first": lambda k, n, a: k == 0, "last": lambda k, n, a: k == n - 1, "eq": lambda k, n, a: k == (a if a >= 0 else n + a), "gt": lambda k, n, a: k > a, "lt": lambda k, n, a: k < a, "even": lambda k, n, a: k % 2 == 0, "odd": lambda k, n, a: k % 2 == 1}


class _Chain:
    """One selector without commas: compounds with the combinators between them."""

    def __init__(self, text: str) -> None:
        self.steps: list[tuple[str, list[Test], list[tuple[str, int]]]] = []
        tests: list[Test] = []
        places: list[tuple[str, int]] = []
        comb, pos, text = " ", 0, text.strip()
        if not text:
            raise SelectorError("empty selector")
        while pos < len(text):
            m = _PART.match(text, pos)
            if not m:
                raise SelectorError(f"invalid selector at {text[pos:]!r}")
            pos = m.end()
            if m["comb"] or m["space"]:
                if tests or places:
                    self.steps.append((comb, tests, places))
                elif not (m["comb"] and not self.steps):
                    raise SelectorError(f"misplaced combinator in {text!r}")
                tests, places, comb = [], [], m["comb"] or " "
            elif m["tag"]:
                if m["tag"] != "*":
                    tag = m["tag"]
                    tests.append(lambda n, t=tag: n.tag == t or n.tag == t.lower())
                else:
                    tests.append(lambda n: True)
            elif m["id"]:
                tests.append(lambda n, v=re.sub(r"\\(.)", r"\1", m["id"]): n.attrs.get("id") == v)
            elif m["cls"]:
                tests.append(lambda n, v=re.sub(r"\\(.)", r"\1", m["cls"]): v in n.classes())
            elif m["attr"]:
                value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
                tests.append(_attr(m["attr"], m["op"], value, (m["flag"] or "").lower() == "i"))
            else:
                arg = None
                if pos < len(text) and text[pos] == "(":
                    depth, end = 0, pos
                    while end < len(text):
                        depth += (text[end] == "(") - (text[end] == ")")
                        end += 1
                        if not depth:
                            break
                    if depth:
                        raise SelectorError(f"unclosed parenthesis in {text!r}")
                    arg, pos = text[pos + 1 : end - 1], end
                name = m["pseudo"].lower()
                if name in _POSITION:
                    places.append((name, int(arg) if arg else 0))
                    tests.append(lambda n: True)
                else:
                    tests.append(_pseudo(name, arg))
        if not tests:
            raise SelectorError(f"selector ends with a combinator: {text!r}")
        self.steps.append((comb, tests, places))

    def _ok(self, n: Node, k: int) -> bool:
        return all(t(n) for t in self.steps[k][1])

    def matches(self, n: Node, k: int = -1, scope: Node | None = None) -> bool:
        k = len(self.steps) - 1 if k < 0 else k
        if not self._ok(n, k):
            return False
        comb = self.steps[k][0]
        if k == 0:
            return comb == " " or (comb == ">" and (scope is None or n.parent is scope))
        if comb == ">":
            return n.parent is not None and self.matches(n.parent, k - 1, scope)
        if comb == " ":
            p = n.parent
            while p is not None:
                if self.matches(p, k - 1, scope):
                    return True
                p = p.parent
            return False
        before = []
        for s in _siblings(n):
            if s is n:
                break
            before.append(s)
        return any(self.matches(s, k - 1, scope) for s in (before[-1:] if comb == "+" else before))

    def select(self, root: Node) -> list[Node]:
        if not any(p for _, _, p in self.steps):
            return [n for n in root.walk() if self.matches(n, scope=root)]
        # positions count among what is found step by step
        now: list[Node] = [root]
        for k, (comb, _, places) in enumerate(self.steps):
            found: list[Node] = []
            seen: set[int] = set()
            for base in now:
                near = base.elements() if comb == ">" else list(base.walk()) if comb == " " else self._after(base, comb)
                for n in near:
                    if id(n) not in seen and self._ok(n, k):
                        seen.add(id(n))
                        found.append(n)
            if places:
                order = {id(n): k2 for k2, n in enumerate(root.walk())}
                found.sort(key=lambda n: order[id(n)])
            for name, arg in places:
                found = [n for i, n in enumerate(found) if _POSITION[name](i, len(found), arg)]
            now = found
        return now

    @staticmethod
    def _after(n: Node, comb: str) -> list[Node]:
        of = _siblings(n)
        k = next(i for i, s in enumerate(of) if s is n)
        return of[k + 1 : k + 2] if comb == "+" else of[k + 1 :]


class Selector:
    def __init__(self, text: str) -> None:
        self.text, self.chains = text, [_Chain(g) for g in split_groups(text)]

    def matches(self, n: Node) -> bool:
        return any(c.matches(n) for c in self.chains)

    def select(self, root: Node) -> list[Node]:
        """Elements below root that match, in document order, each once."""
        if len(self.chains) == 1:
            return self.chains[0].select(root)
        found = {id(n) for c in self.chains for n in c.select(root)}
        return [n for n in root.walk() if id(n) in found]


@lru_cache(1024)
def compile_selector(text: str) -> Selector:
    return Selector(text)


def select(root: Node, selector: str) -> list[Node]:
    return compile_selector(selector).select(root)
