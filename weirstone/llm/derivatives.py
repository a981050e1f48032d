"""Memoised parsing with derivatives over token streams.

A grammar is written as EBNF text and compiled to hash-consed expression
nodes.  A parser state is an interned set of derivatives of the start symbol;
the derivative of a state by a token is computed once and kept in the state's
own table, so that a token normally costs one dictionary lookup.

Brackets (and indentation, and ``def ... end``) are compacted: when a token
opens a group, the derivative splits into what may stand inside and what may
follow the close, and only the inside is carried on; the rest waits on a
stack.  States are therefore shared between all nesting depths and the memo
stays small.

An empty derivative names the exact failing token.  A non-nullable derivative
at the end of the stream means the text was cut off.
"""

from __future__ import annotations

import operator
import re

_DSL = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<name>\w+)|(?P<op>[=|;()*+?%!{},]))")
#: Rows kept in the memo of one grammar before it is started anew.
MEMO_ROWS = 300_000


class Row(dict):
    """A parser state; maps a token's code to the next state."""

    __slots__ = ("grammar", "alts", "tags")

    def __missing__(self, code):
        return self.grammar.derive(self, code)


class Frame(dict):
    """What may follow an open group, by the tags of the insides that may end."""

    __slots__ = ("grammar", "rests", "closer")

    def __missing__(self, tags):
        alts = frozenset().union(*(self.rests[t] for t in tags)) if tags else frozenset()
        self[tags] = row = self.grammar.row(alts)
        return row


class Grammar:
    def __init__(self, text, pairs, words=(), classes=()):
        """text: EBNF rules. pairs: opening token -> closing token. words: keywords
        that rule ``anykw`` stands for. classes: names of token classes."""
        opens, closes = list(pairs), list(dict.fromkeys(pairs.values()))
        toks = self._lex(text)
        literals = [t[1:-1] for t in toks if t[0] == "'"]
        order = dict.fromkeys([*opens, *closes, *classes, *literals, *words])
        self.codes = {t: i for i, t in enumerate(order)}
        self.bad = len(self.codes)
        self.n_open, self.n_group = len(opens), len(opens) + len(closes)
        self.pairs = {self.codes[o]: self.codes[c] for o, c in pairs.items()}
        self._by_text = pairs
        self.words = [self.codes[w] for w in words]
        self.nodes, self._ids = [], {}
        self.rules = {}
        self.eps = self._node(("seq", ()))
        self._compile(toks)
        self._fixpoints()
        self.reset()

    # -- compiling ---------------------------------------------------------
    @staticmethod
    def _lex(text):
        text = re.sub(r"#.*", "", text).strip()
        out, at = [], 0
        while at < len(text):
            m = _DSL.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            out.append(m.group(m.lastgroup))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        return out

    def _node(self, key):
        if key not in self._ids:
            self._ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self._ids[key]

    def _compile(self, toks):
        self._t, self._i = toks, 0
        first = None
        while self._i < len(toks):
            name = toks[self._i]
            first = first or name
            if toks[self._i + 1] != "=":
                raise ValueError(f"rule {name}")
            self._i += 2
            self.rules[name] = self._alt()
            if toks[self._i] != ";":
                raise ValueError(f"rule {name}: {toks[self._i - 2:self._i + 3]}")
            self._i += 1
        self.rules["anykw"] = self._node(("alt", tuple(sorted(self._node(("tok", w)) for w in self.words))))
        self.start = first

    def _peek(self):
        return self._t[self._i]

    def _alt(self):
        parts = [self._seq()]
        while self._peek() == "|":
            self._i += 1
            parts.append(self._seq())
        return parts[0] if len(parts) == 1 else self._node(("alt", tuple(dict.fromkeys(parts))))

    def _seq(self):
        items = []
        while self._peek() not in ("|", ")", ";"):
            items.append(self._item())
        return self._fold(items)

    def _fold(self, items):
        """A sequence; from an opening token to its closing one it becomes a group."""
        out, i = [], 0
        while i < len(items):
            kind = self.nodes[items[i]]
            if kind[0] == "tok" and kind[1] in self.pairs:
                depth, j = 1, i + 1
                closer = self.pairs[kind[1]]
                while depth:
                    if j >= len(items):
                        raise ValueError("group without a close in its sequence")
                    k = self.nodes[items[j]]
                    if k[0] == "tok" and k[1] in self.pairs:
                        depth += 1
                    elif k == ("tok", closer) or k[0] == "tok" and self.n_open <= k[1] < self.n_group:
                        depth -= 1
                    j += 1
                out.append(self._node(("group", kind[1], self._fold(items[i + 1 : j - 1]))))
                i = j
            else:
                out.append(items[i])
                i += 1
        return out[0] if len(out) == 1 else self._node(("seq", tuple(out)))

    def _item(self):
        t = self._peek()
        self._i += 1
        if t == "(":
            node = self._alt()
            self._i += 1
        elif t == "!":  # !{ 'a' 'b' } item : item, but not beginning with these tokens
            self._i += 1
            barred = []
            while self._peek() != "}":
                barred.append(self.codes[self._peek()[1:-1]])
                self._i += 1
            self._i += 1
            return self._node(("not", tuple(sorted(barred)), self._item()))
        elif t[0] == "'":
            node = self._node(("tok", self.codes[t[1:-1]]))
        elif t in self.codes and t.isupper():
            node = self._node(("tok", self.codes[t]))
        else:
            node = self._node(("ref", t))
        while self._peek() in ("*", "+", "?", "%"):
            op = self._peek()
            self._i += 1
            if op == "*":
                node = self._node(("star", node))
            elif op == "+":
                node = self._node(("seq", (node, self._node(("star", node)))))
            elif op == "?":
                node = self._node(("alt", (node, self.eps)))
            else:
                sep = self._item_plain()
                node = self._node(("seq", (node, self._node(("star", self._node(("seq", (sep, node))))))))
        return node

    def _item_plain(self):
        t = self._peek()
        self._i += 1
        return self._node(("tok", self.codes[t[1:-1]])) if t[0] == "'" else self._node(("ref", t))

    def _fixpoints(self):
        n = len(self.nodes)
        self.nullable, self.first = [False] * n, [frozenset()] * n
        changed = True
        while changed:
            changed = False
            for i, node in enumerate(self.nodes):
                kind = node[0]
                if kind == "tok":
                    new = False, frozenset((node[1],))
                elif kind == "group":
                    new = False, frozenset((node[1],))
                elif kind == "seq":
                    null, first = True, frozenset()
                    for x in node[1]:
                        if null:
                            first |= self.first[x]
                        null = null and self.nullable[x]
                    new = null, first
                elif kind == "alt":
                    new = any(self.nullable[x] for x in node[1]), frozenset().union(*(self.first[x] for x in node[1]))
                elif kind == "star":
                    new = True, self.first[node[1]]
                elif kind == "not":
                    new = self.nullable[node[2]], self.first[node[2]] - set(node[1])
                else:
                    if node[1] not in self.rules:
                        raise ValueError(f"no rule {node[1]}")
                    x = self.rules[node[1]]
                    new = self.nullable[x], self.first[x]
                if new != (self.nullable[i], self.first[i]):
                    self.nullable[i], self.first[i] = new
                    changed = True

    # -- derivatives -------------------------------------------------------
    def reset(self):
        self._stacks, self._stack_ids, self._stack_null = [None], {}, [True]
        self._rows, self._steps, self._frames = {}, {}, {}
        self.dead = self.row(frozenset())
        self.starts = {}

    def begin(self, rule=None):
        """The state that expects the rule, by default the grammar's first."""
        if len(self._rows) > MEMO_ROWS:
            self.reset()
        rule = rule or self.start
        if rule not in self.starts:
            self.starts[rule] = self.row(frozenset([(self._push(self.rules[rule], 0), 0)]))
        return self.starts[rule]

    def _push(self, node, rest):
        key = node, rest
        if key not in self._stack_ids:
            self._stack_ids[key] = len(self._stacks)
            self._stacks.append(key)
            self._stack_null.append(self.nullable[node] and self._stack_null[rest])
        return self._stack_ids[key]

    def row(self, alts):
        if alts not in self._rows:
            row = Row()
            row.grammar, row.alts = self, alts
            row.tags = tuple(sorted({tag for stack, tag in alts if self._stack_null[stack]}))
            self._rows[alts] = row
        return self._rows[alts]

    def _step(self, stack, code):
        """Stacks that follow the token; for an opening token pairs (inside, stack)."""
        key = stack, code
        if key in self._steps:
            return self._steps[key]
        out, todo, seen = set(), [stack], set()
        while todo:
            s = todo.pop()
            if not s or s in seen:
                continue
            seen.add(s)
            node, rest = self._stacks[s]
            if self.nullable[node]:
                todo.append(rest)
            if code not in self.first[node]:
                continue
            n = self.nodes[node]
            kind = n[0]
            if kind == "tok":
                out.add(rest)
            elif kind == "group":
                out.add((n[2], rest))
            elif kind == "seq":
                for x in reversed(n[1]):
                    rest = self._push(x, rest)
                todo.append(rest)
            elif kind == "alt":
                todo.extend(self._push(x, rest) for x in n[1] if code in self.first[x])
            elif kind == "star":
                todo.append(self._push(n[1], s))
            elif kind == "not":
                todo.append(self._push(n[2], rest))
            else:
                todo.append(self._push(self.rules[n[1]], rest))
        self._steps[key] = out
        return out

    def derive(self, row, code):
        if code >= self.n_open:
            alts = frozenset((s, tag) for stack, tag in row.alts for s in self._step(stack, code))
            row[code] = new = self.row(alts)
            return new
        insides = {}
        for stack, tag in row.alts:
            for inside, rest in self._step(stack, code):
                insides.setdefault(inside, set()).add((rest, tag))
        if not insides:
            row[code] = None
            return None
        order = sorted(insides)
        rests = tuple(frozenset(insides[x]) for x in order)
        key = rests, self.pairs[code]
        if key not in self._frames:
            f = self._frames[key] = Frame()
            f.grammar, f.rests, f.closer = self, rests, self.pairs[code]
        row[code] = new = (self.row(frozenset((self._push(x, 0), i) for i, x in enumerate(order))), self._frames[key])
        return new


def run(grammar, codes, rule=None, repair=None):
    """Derive by all codes. Returns None if the stream is in the language, else the
    index of the failing token (the length, if the stream ends too early).
    repair(index, closing): whether a terminator, grammar.semi, may be put before that token."""
    s, frames, dead = grammar.begin(rule), [], grammar.dead
    n_open, n_group, semi = grammar.n_open, grammar.n_group, getattr(grammar, "semi", None)
    it = iter(codes)
    for c in it:
        if c >= n_group:
            n = s[c]
            if n is dead:
                if repair is None or not repair(len(codes) - operator.length_hint(it) - 1, False):
                    return len(codes) - operator.length_hint(it) - 1
                n = s[semi][c]
                if n is dead:
                    return len(codes) - operator.length_hint(it) - 1
            s = n
        elif c < n_open:
            n = s[c]
            if n is None and repair is not None and repair(len(codes) - operator.length_hint(it) - 1, False):
                n = s[semi][c]
            if n is None:
                return len(codes) - operator.length_hint(it) - 1
            s = n[0]
            frames.append(n[1])
        else:
            if not frames or frames[-1].closer != c:
                return len(codes) - operator.length_hint(it) - 1
            tags = s.tags
            if not tags and repair is not None and repair(len(codes) - operator.length_hint(it) - 1, True):
                tags = s[semi].tags
            s = frames.pop()[tags]
            if s is dead:
                return len(codes) - operator.length_hint(it) - 1
    if frames or not s.tags and not (repair is not None and s[semi].tags):
        return len(codes)
    return None
