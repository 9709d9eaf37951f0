"""Grammar inference: probabilistic automata from labelled strings by merging prefix-tree states."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from functools import lru_cache

UPPER, LOWER, DIGITS, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
ALPHABET = UPPER + LOWER + DIGITS + "+/_=.-"


class Automaton:
    """A deterministic probabilistic automaton inferred by merging compatible states (ALERGIA).

    Two states are compatible if, by Hoeffding's bound at ``alpha``, their frequencies of ending and
    of each next character, and those of the states behind, don't differ. States are merged in
    breadth-first order into the first compatible one kept so far.
    """

    def __init__(self, sample: Iterable[str], alpha: float = 0.02):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        for word in sample:
            at = 0
            self.seen[0] += 1
            for c in word:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = self.next[at].setdefault(c, len(self.next))
                if at == len(self.count):
                    self.next.append({})
                    self.count.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                self.seen[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.infer()
        self.compile()

    def differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in met:
                continue
            met.add((a, b))
            if self.differ(self.ends[a], self.seen[a], self.ends[b], self.seen[b]):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self.differ(self.count[a].get(c, 0), self.seen[a], self.count[b].get(c, 0), self.seen[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def merge(self, into: int, state: int, parent: int, by: str) -> None:
        """``state`` roots a subtree of the prefix tree: point its parent at ``into`` and fold the subtree in."""
        self.next[parent][by] = into
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def infer(self) -> None:
        kept, fringe = [0], [(0, c) for c in sorted(self.next[0])]
        while fringe:
            parent, by = fringe.pop(0)
            state = self.next[parent][by]
            if state in kept:
                continue
            into = next((k for k in kept if self.compatible(k, state)), None)
            if into is None:
                kept.append(state)
                fringe += [(state, c) for c in sorted(self.next[state])]
            else:
                self.merge(into, state, parent, by)
                fringe += [(k, c) for k in kept for c in sorted(self.next[k]) if self.next[k][c] not in kept and (k, c) not in fringe]
        self.kept = kept

    def compile(self, smoothing: float = 0.02) -> None:
        """Per state: log2 probability and next state of each character, of ending, and of the unseen."""
        number = {s: i for i, s in enumerate(self.kept)}
        size = len(ALPHABET) + 1
        self.steps, self.stop, self.unseen = [], [], []
        for s in self.kept:
            total = self.seen[s] + smoothing * size
            self.steps.append({c: (math.log2((n + smoothing) / total), number[self.next[s][c]]) for c, n in self.count[s].items()})
            self.stop.append(math.log2((self.ends[s] + smoothing) / total))
            self.unseen.append(math.log2(smoothing / total))
        del self.next, self.count, self.ends, self.seen, self.kept

    def bits(self, word: str) -> float:
        """log2 probability of a whole word; an unseen character keeps the state."""
        at, total = 0, 0.0
        for c in word:
            step = self.steps[at].get(c)
            if step is None:
                total += self.unseen[at]
            else:
                total += step[0]
                at = step[1]
        return total + self.stop[at]


# Published shapes of credentials, as (name, prefix, alphabet, least and most characters after it).
SHAPES = [
    ("cloud_key", "AKIA", UPPER + DIGITS, 16, 16),
    ("temporary_key", "ASIA", UPPER + DIGITS, 16, 16),
    ("code_host_token", "ghp_", UPPER + LOWER + DIGITS, 36, 36),
    ("code_host_server", "ghs_", UPPER + LOWER + DIGITS, 36, 36),
    ("group_token", "glpat-", UPPER + LOWER + DIGITS, 20, 20),
    ("payment_key", "sk_live_", UPPER + LOWER + DIGITS, 24, 24),
    ("map_key", "AIza", UPPER + LOWER + DIGITS + "_-", 35, 35),
    ("chat_token", "xoxb-", DIGITS + "-", 20, 24),
    ("package_token", "npm_", UPPER + LOWER + DIGITS, 36, 36),
    ("hex_digest", "", HEX, 24, 48),
    ("web_token", "eyJ", UPPER + LOWER + DIGITS + "_-", 30, 60),
    ("random_secret", "", UPPER + LOWER + DIGITS + "+/", 28, 44),
]


def labelled_credentials(each: int = 160, seed: int = 7) -> list[tuple[str, str]]:
    """(label, text): made-up credentials of each shape, and ``plain...`` for strings that only look technical."""
    r = random.Random(seed)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    out = [(name, prefix + draw(chars, r.randint(low, high))) for name, prefix, chars, low, high in SHAPES for _ in range(each)]
    word = lambda: draw(LOWER, r.randint(2, 9))
    plain = (
        lambda: "".join(word() for _ in range(r.randint(2, 4))),
        lambda: "_".join(word() for _ in range(r.randint(2, 5))),
        lambda: "-".join(word() for _ in range(r.randint(2, 5))),
        lambda: "".join(word().title() for _ in range(r.randint(2, 5))),
        lambda: ".".join(word() for _ in range(r.randint(2, 4))) + "/" + word(),
        lambda: word() + draw(DIGITS, r.randint(1, 4)) + "_" + word() + draw(DIGITS, r.randint(1, 3)),
        lambda: draw(DIGITS, r.randint(16, 24)),
        lambda: f"20{draw(DIGITS, 2)}-{draw(DIGITS, 2)}-{draw(DIGITS, 2)}T{draw(DIGITS, 2)}.{draw(DIGITS, 2)}",
        lambda: r.choice("-=._") * r.randint(16, 60),
        lambda: "/" + "/".join(word() for _ in range(r.randint(3, 6))) + ".html",
        lambda: word().upper() + "_" + word().upper() + "_" + draw(DIGITS, 3),
    )
    return out + [(f"plain{i}", make()[:80]) for i, make in enumerate(plain) for _ in range(each)]


@lru_cache(1)
def default_automata() -> dict[str, Automaton]:
    return learn(labelled_credentials())


def learn(labelled: Iterable[tuple[str, str]], alpha: float = 0.02) -> dict[str, Automaton]:
    """One automaton per label."""
    groups: dict[str, list[str]] = {}
    for label, text in labelled:
        groups.setdefault(label, []).append(text)
    return {label: Automaton(sample, alpha) for label, sample in sorted(groups.items())}


def best_format(word: str, automata: dict[str, Automaton]) -> tuple[str, float]:
    """The likeliest credential format and its advantage in bits over the likeliest plain shape."""
    bits = sorted((a.bits(word), label) for label, a in automata.items())
    plain = next(b for b, label in reversed(bits) if label.startswith("plain"))
    best, label = next((b, label) for b, label in reversed(bits) if not label.startswith("plain"))
    return label, best - plain
