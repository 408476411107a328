"""A weighted context-free grammar and an Earley parser that keeps the highest-scoring parse."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """left -> right at a weight (a log probability up to a constant; 0 or less); marks name the tokens to capture."""

    left: str
    right: tuple[str, ...]
    weight: float = 0.0
    marks: tuple[str | None, ...] = ()


@dataclass
class Parse:
    """The best parse: its score, layout (name of the rule below the start), captured tokens and skipped tokens."""

    score: float
    layout: str
    captured: dict[str, int] = field(default_factory=dict)
    skipped: list[int] = field(default_factory=list)


class Grammar:
    """Rules are written one a line: ``left -> right ... @weight``; ``name:symbol`` captures the token under a name.

    A symbol that no rule has on its left is a terminal. No rule may be empty, and unit rules may not form cycles;
    then every improvement of an item comes from shorter or lower items and the best score is found.
    """

    def __init__(self, text: str, start: str, skip: str = "SKIP") -> None:
        self.start, self.skip = start, skip
        self.rules: dict[str, list[Rule]] = defaultdict(list)
        for line in filter(None, map(str.strip, text.splitlines())):
            left, _, rest = line.partition("->")
            body, _, weight = rest.partition("@")
            parts = [p.partition("=") if "=" in p else ("", "", p) for p in body.split()]
            self.rules[left.strip()].append(Rule(left.strip(), tuple(p[2] for p in parts), float(weight or 0), tuple(p[0] or None for p in parts)))

    def parse(self, tokens: tuple[str, ...]) -> Parse | None:
        """The best parse of all the tokens, None where there is none."""
        # an item is (rule, dot, origin); each chart column keeps its best score and how it came about
        columns: list[dict[tuple[Rule, int, int], tuple[float, tuple | None]]] = [{} for _ in range(len(tokens) + 1)]
        waiting: list[dict[str, list[tuple[Rule, int, int]]]] = [defaultdict(list) for _ in range(len(tokens) + 1)]
        for rule in self.rules[self.start]:
            columns[0][(rule, 0, 0)] = (rule.weight, None)
        for i, column in enumerate(columns):
            agenda = list(column)
            while agenda:
                item = agenda.pop()
                rule, dot, origin = item
                score = column[item][0]
                if dot == len(rule.right):
                    for parent in list(waiting[origin][rule.left]):
                        advanced = (parent[0], parent[1] + 1, parent[2])
                        total = columns[origin][parent][0] + score
                        if advanced not in column or column[advanced][0] < total:
                            column[advanced] = (total, (parent, origin, item))
                            agenda.append(advanced)
                    continue
                symbol = rule.right[dot]
                if symbol in self.rules:
                    if item not in waiting[i][symbol]:
                        waiting[i][symbol].append(item)
                    for r in self.rules[symbol]:
                        if (r, 0, i) not in column:
                            column[(r, 0, i)] = (r.weight, None)
                            agenda.append((r, 0, i))
                elif i < len(tokens) and tokens[i] == symbol:
                    advanced = (rule, dot + 1, origin)
                    if advanced not in columns[i + 1] or columns[i + 1][advanced][0] < score:
                        columns[i + 1][advanced] = (score, (item, i, None))
        done = [(s[0], item) for item, s in columns[-1].items() if item[0].left == self.start and item[1] == len(item[0].right) and item[2] == 0]
        if not done:
            return None
        score, best = max(done, key=lambda x: x[0])
        out = Parse(score, best[0].right[0])
        stack = [(best, len(tokens))]
        while stack:
            item, end = stack.pop()
            came = columns[end][item][1]
            if came is None:
                continue
            before, at, child = came
            mark = before[0].marks[before[1]]
            if mark:
                out.captured[mark] = at
            if before[0].left == self.skip and child is None:
                out.skipped.append(at)
            stack.append((before, at))
            if child is not None:
                stack.append((child, end))
        out.skipped.sort()
        return out
