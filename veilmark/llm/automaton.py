"""Byte automata: rule patterns -> position sets -> subset construction -> minimal transition arrays."""

from __future__ import annotations

from collections import defaultdict

#: Pattern syntax: literals, \xHH, \\ escapes, [classes], (groups), | and the repeats ? * + {n} {n,} {n,m}.
_ANY = frozenset(range(256))


class Pattern:
    """Parse one rule to a small tree: ("set", bytes) | ("cat", kids) | ("alt", kids) | ("rep", kid, low, high)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.tree = self._alt()
        if self.at != len(text):
            raise ValueError(f"unbalanced ) in {text!r}")

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _alt(self):
        kids = [self._cat()]
        while self._peek() == "|":
            self.at += 1
            kids.append(self._cat())
        return kids[0] if len(kids) == 1 else ("alt", kids)

    def _cat(self):
        kids = []
        while self._peek() not in ("", "|", ")"):
            kids.append(self._repeat())
        return ("cat", kids)

    def _repeat(self):
        node = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self.at += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[c]
            if c == "{":
                end = self.text.index("}", self.at)
                a, _, b = self.text[self.at : end].partition(",")
                low, high = int(a), int(b) if b else (None if "," in self.text[self.at : end] else int(a))
                self.at = end + 1
            node = ("rep", node, low, high)
        return node

    def _char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "\\":
            c = self.text[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def _atom(self):
        c = self._peek()
        if c == "(":
            self.at += 1
            node = self._alt()
            if self._peek() != ")":
                raise ValueError(f"unbalanced ( in {self.text!r}")
            self.at += 1
            return node
        if c != "[":
            return ("set", frozenset([self._char()]))
        self.at += 1
        negated = self._peek() == "^"
        self.at += negated
        members: set[int] = set()
        while self._peek() != "]":
            low = self._char()
            if self._peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                members.update(range(low, self._char() + 1))
            else:
                members.add(low)
        self.at += 1
        return ("set", frozenset(_ANY - members if negated else members))


def folded(tree):
    """The same tree with ASCII letters in either case."""
    if tree[0] == "set":
        return ("set", frozenset(b for x in tree[1] for b in ({x, x ^ 32} if chr(x).isascii() and chr(x).isalpha() else {x})))
    if tree[0] == "rep":
        return ("rep", folded(tree[1]), *tree[2:])
    return (tree[0], [folded(k) for k in tree[1]])


def shortest(tree):
    """The tree with a closing repeat cut to its least count: it ends where the full rule first ends."""
    if tree[0] == "cat" and tree[1]:
        return ("cat", [*tree[1][:-1], shortest(tree[1][-1])])
    if tree[0] == "rep":
        return ("rep", tree[1], tree[2], tree[2])
    return tree


def mirrored(tree):
    """The tree of the reversed language."""
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    kids = [mirrored(k) for k in tree[1]]
    return (tree[0], kids[::-1] if tree[0] == "cat" else kids)


class Nfa:
    """Thompson fragments with empty moves."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Append the tree after start; returns its end state."""
        if tree[0] == "set":
            end = self.state()
            self.moves[start] = (tree[1], end)
            fresh = self.state()
            self.empty[end].append(fresh)
            return fresh
        if tree[0] == "cat":
            for kid in tree[1]:
                start = self.add(kid, start)
            return start
        if tree[0] == "alt":
            end = self.state()
            for kid in tree[1]:
                own = self.state()
                self.empty[start].append(own)
                self.empty[self.add(kid, own)].append(end)
            fresh = self.state()
            self.empty[end].append(fresh)
            return fresh
        _, kid, low, high = tree
        for _ in range(low):
            start = self.add(kid, start)
        if high is None:
            hub = self.state()
            self.empty[start].append(hub)
            own = self.state()
            self.empty[hub].append(own)
            self.empty[self.add(kid, own)].append(hub)
            fresh = self.state()
            self.empty[hub].append(fresh)
            return fresh
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            own = self.state()
            self.empty[start].append(own)
            start = self.add(kid, own)
        self.empty[start].append(end)
        fresh = self.state()
        self.empty[end].append(fresh)
        return fresh


def compile_dfa(trees: list, search: bool) -> tuple[list[list[int]], list[int], int]:
    """Minimal automaton of all trees together: (transition arrays, accepted-tree bit masks, start).

    search: a match may begin at any byte.  State -1 does not occur: a dead state is an ordinary state.
    """
    nfa = Nfa()
    root = nfa.state()
    accepts = {}
    for k, tree in enumerate(trees):
        own = nfa.state()
        nfa.empty[root].append(own)
        accepts[nfa.add(tree, own)] = 1 << k

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.moves[s] or s in accepts)

    base = closure([root])
    ids, order, table, masks = {base: 0}, [base], [], []
    for group in order:
        to: dict[int, set[int]] = defaultdict(set)
        for s in group:
            if nfa.moves[s]:
                for b in nfa.moves[s][0]:
                    to[b].add(nfa.moves[s][1])
        row, memo = [], {}
        for b in range(256):
            key = frozenset(to.get(b, ()))
            if key not in memo:
                target = closure(key) | (base if search else frozenset())
                if target not in ids:
                    ids[target] = len(order)
                    order.append(target)
                memo[key] = ids[target]
            row.append(memo[key])
        table.append(row)
        masks.append(sum({accepts[s] for s in group if s in accepts}))
    return _minimal(table, masks)


def _minimal(table, masks):
    """Partition refinement until states of a block agree on mask and on every successor's block."""
    block = masks
    names = {m: i for i, m in enumerate(dict.fromkeys(block))}
    block = [names[m] for m in block]
    while True:
        signs = [(block[s], *(block[t] for t in row)) for s, row in enumerate(table)]
        names = {g: i for i, g in enumerate(dict.fromkeys(signs))}
        finer = [names[g] for g in signs]
        if len(names) == len(set(block)):
            break
        block = finer
    first = {}
    for s, k in enumerate(block):
        first.setdefault(k, s)
    ranks = {k: i for i, k in enumerate(sorted(first))}
    rows = [[ranks[block[t]] for t in table[first[k]]] for k in sorted(first)]
    return rows, [masks[first[k]] for k in sorted(first)], ranks[block[0]]
