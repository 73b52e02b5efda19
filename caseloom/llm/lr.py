"""Weighted generalised LR repair of sequences of roles.

Tables of the grammar are made by the usual item sets. A cell of the graph-structured stack is a state on a cell below;
equal cells are one, so equal stacks share one top, which keeps its least (cost, audit). Before each row the tops may
shift inserted symbols; a row is kept, given another role, or deleted.

After a row every audit has the same number of letters other than I and ends in one, so of two different audits none
begins with the other: their order decides whatever follows, and ranks stand for them. Costs are taken relative to the
least; a top over ``SLACK`` dearer cannot catch up, as any top can come to accept what another accepts for that much.
So there are few different rows of tops, and each step from one of them is worked out once.
"""

from __future__ import annotations

from functools import lru_cache

# The grammar of (s?(ua)+)? and the costs of edits.
GRAMMAR = [("T", "Q"), ("Q", ""), ("Q", "sP"), ("Q", "P"), ("P", "PE"), ("P", "E"), ("E", "ua")]
TERMINALS = "sua"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = "ua"  # what can be inserted or given
NAMES = {"u": "user", "a": "assistant"}
SLACK = 5
END = "$"


class Tables:
    """SLR actions: shifts[state][terminal], reductions[state][terminal] and gotos[state][nonterminal]."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        heads = {h for h, _ in rules}
        first, nullable = {h: set() for h in heads}, set()
        follow = {h: set() for h in heads}
        follow[rules[0][0]].add(END)
        for _ in range(len(rules) ** 2):
            for head, body in rules:
                if all(x in nullable for x in body):
                    nullable.add(head)
                for x in body:
                    first[head] |= first[x] if x in heads else {x}
                    if x not in nullable:
                        break
                after = set(follow[head])
                for x in reversed(body):
                    if x in heads:
                        follow[x] |= after
                        after = first[x] | (after if x in nullable else set())
                    else:
                        after = {x}

        def closure(items):
            items, todo = set(items), list(items)
            while todo:
                rule, dot = todo.pop()
                body = rules[rule][1]
                if dot < len(body):
                    for i, (head, _) in enumerate(rules):
                        if head == body[dot] and (i, 0) not in items:
                            items.add((i, 0))
                            todo.append((i, 0))
            return frozenset(items)

        states = [closure({(0, 0)})]
        self.moves: list[dict[str, int]] = []
        for items in states:  # grows while it is read
            moves = {}
            for x in sorted({rules[r][1][d] for r, d in items if d < len(rules[r][1])}):
                there = closure({(r, d + 1) for r, d in items if rules[r][1][d : d + 1] == x})
                if there not in states:
                    states.append(there)
                moves[x] = states.index(there)
            self.moves.append(moves)
        self.reductions = [
            {t: [r for r, d in sorted(items) if r and d == len(rules[r][1]) and t in follow[rules[r][0]]] for t in [*TERMINALS, END]}
            for items in states
        ]
        self.accepting = {i for i, items in enumerate(states) if (0, len(rules[0][1])) in items}


class Repairer:
    """Repairs strings with a letter for each row: s, u, a or x (another role), upper-case if truncated, - if it must go."""

    def __init__(self):
        self.tables = Tables(GRAMMAR)
        self.cells: dict[tuple, int] = {}
        self.stack: list[tuple[int, int]] = []  # (state, cell below) of each cell
        self.shift = lru_cache(None)(self._shift)
        self.accepts = lru_cache(None)(self._accepts)
        self.steps: dict[tuple, tuple] = {}
        self.ends: dict[tuple, tuple] = {}
        self.start = ((self._cell(0, -1), 0, 0),)

    def _cell(self, state: int, below: int) -> int:
        cell = self.cells.setdefault((state, below), len(self.stack))
        if cell == len(self.stack):
            self.stack.append((state, below))
        return cell

    def _reduced(self, cell: int, ahead: str) -> list[int]:
        """The cell and all that reductions before ``ahead`` make of it."""
        out = [cell]
        for top in out:  # grows while it is read
            for rule in self.tables.reductions[self.stack[top][0]][ahead]:
                head, body = self.tables.rules[rule]
                base = top
                for _ in body:
                    base = self.stack[base][1]
                made = self._cell(self.tables.moves[self.stack[base][0]][head], base)
                if made not in out:
                    out.append(made)
        return out

    def _shift(self, cell: int, symbol: str) -> tuple[int, ...]:
        moves = self.tables.moves
        return tuple(self._cell(moves[self.stack[c][0]][symbol], c) for c in self._reduced(cell, symbol) if symbol in moves[self.stack[c][0]])

    def _accepts(self, cell: int) -> bool:
        return any(self.stack[c][0] in self.tables.accepting for c in self._reduced(cell, END))

    def _with_inserts(self, tops: tuple) -> dict[int, tuple]:
        """The least (cost, rank, letters, place of the top it came from) of each cell, after any inserts."""
        best = {cell: (cost, rank, "", i) for i, (cell, cost, rank) in enumerate(tops)}
        todo = list(best)
        while todo:
            cell = todo.pop()
            cost, rank, letters, i = best[cell]
            for role in ROLES:
                for there in self.shift(cell, role):
                    new = (cost + INSERT, rank, letters + "I", i)
                    if there not in best or new < best[there]:
                        best[there] = new
                        todo.append(there)
        return best

    def _step(self, tops: tuple, letter: str) -> tuple:
        """(next tops, what their costs were lowered by, (place, letters) of each) after a row."""
        new: dict[int, tuple] = {}

        def offer(cell, cost, rank, letters, i):
            if cell not in new or (cost, rank, letters) < new[cell][:3]:
                new[cell] = (cost, rank, letters, i)

        extra = TRUNCATED if letter.isupper() else 0
        for cell, (cost, rank, letters, i) in self._with_inserts(tops).items():
            offer(cell, cost + DELETE, rank, letters + "D", i)
            if letter == "-":
                continue
            if letter.lower() in TERMINALS:
                for there in self.shift(cell, letter.lower()):
                    offer(there, cost + KEEP + extra, rank, letters + "K", i)
            for role in ROLES:
                for there in self.shift(cell, role):
                    offer(there, cost + REROLE + extra, rank, letters + "R", i)
        least = min(n[0] for n in new.values())
        kept = sorted((cell, n) for cell, n in new.items() if n[0] <= least + SLACK)
        ranks = {k: i for i, k in enumerate(sorted({n[1:3] for _, n in kept}))}
        tops = tuple((cell, n[0] - least, ranks[n[1:3]]) for cell, n in kept)
        return tops, least, tuple((n[3], n[2]) for _, n in kept)

    def _end(self, tops: tuple) -> tuple:
        cost, _, letters, i = min(n for cell, n in self._with_inserts(tops).items() if self.accepts(cell))
        return cost, letters, i

    def repair(self, letters: str) -> tuple[int, list[str]]:
        """Least cost, and what is done at each row: any I and then K, R or D; a last entry holds the I at the end."""
        tops, cost, trace = self.start, 0, []
        steps = self.steps
        for letter in letters:
            step = steps.get((tops, letter))
            if step is None:
                step = steps[tops, letter] = self._step(tops, letter)
            tops, least, back = step
            cost += least
            trace.append(back)
        if tops not in self.ends:
            self.ends[tops] = self._end(tops)
        more, last, i = self.ends[tops]
        done = [last]
        for back in reversed(trace):
            i, edit = back[i]
            done.append(edit)
        return cost + more, done[::-1]


class Renderer:
    """Lines role:text of repaired rows. ``given`` counts the user and assistant lines so far."""

    def __init__(self, given: int = 0):
        self.given = given

    def lines(self, edits: list[str], roles: list[str], texts: list[str]) -> list[str]:
        out = []
        for k, edit in enumerate(edits):
            for letter in edit:
                if letter == "D":
                    continue
                name = NAMES[ROLES[self.given % 2]]
                if letter == "I":
                    out.append(f"{name}:")
                elif letter == "R":
                    out.append(f"{name}:{texts[k]}")
                else:
                    out.append(f"{roles[k]}:{texts[k]}")
                    if roles[k][:1] == "s":
                        continue
                self.given += 1
        return out
