"""Choosing among evaluated candidates: the best few, ties, and bridge ("random") literals."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from cinnabar.functions.scores import area, combine, f1, mcc, score
from cinnabar.operators.evaluate import Counts
from cinnabar.plans.model import Clause, Literal

TIE = 1e-5


@dataclass(frozen=True)
class Scored:
    counts: Counts
    score: float


def need_regrow(clause: Clause, literal: Literal, n: int) -> bool:
    """After a bridge literal the next one must use its new variables, outside the predicate's key, or cover no negative."""
    if not clause.body or n == 0 or not clause.random[-1]:
        return False
    before = clause.width_before_last
    return not any(v >= before for i, v in enumerate(literal.terms) if i != literal.predicate.key)


class Selector:
    """The best candidates of one search over a clause with P positive and N negative bindings."""

    def __init__(self, clause: Clause, P: int, N: int, uncovered: int, blacklist: Collection[Literal] = (), keep: int = 5, margin: float = 0.03, consider_random: bool = True):
        self.clause, self.P, self.N, self.uncovered = clause, P, N, uncovered
        self.blacklist, self.keep, self.margin, self.consider_random = blacklist, keep, margin, consider_random
        self.top: list[Scored] = []
        self.bridge: Scored | None = None
        self.bridge_f1 = -1.0
        self.saved: list[Scored] = []

    def insert(self, c: Counts) -> None:
        s = score(c.bp, c.bn, c.p, c.n, self.P, self.N)
        if s is None:
            return
        one = Scored(c, s)
        if self.consider_random and self.may_bridge(c):
            f = f1(c.p / (c.p + c.n), c.p / self.P)
            best = self.bridge
            wider = best is not None and f == self.bridge_f1 and c.p < self.uncovered and c.bp // c.p <= 2 and c.bp > best.counts.bp
            if best is None or f > self.bridge_f1 or wider:
                self.bridge, self.bridge_f1 = one, f
        if len(self.top) >= self.keep:
            least = min(x.score for x in self.top)
            if s < least:
                return
            self.top = [x for x in self.top if x.score != least]  # all that tie with the least make room
        self.top.append(one)

    def may_bridge(self, c: Counts) -> bool:
        m = mcc(c.p, c.n, self.P, self.N)
        if not c.literal.unbound or c.literal in self.blacklist or not abs(m) < self.margin:
            return False
        if m == 0 and c.bp == c.p and c.bn == c.n:
            return False
        return not need_regrow(self.clause, c.literal, c.n)

    def best(self, choose_bridge: Callable[[Literal, Literal], bool]) -> tuple[list[Scored], bool]:
        """(ties, the best last), and whether it is a bridge; the others are saved for next_best."""
        if not self.top:
            return [], False
        order = sorted(self.top, key=lambda x: x.score)
        first = order[-1]
        if self.bridge is not None and self.prefers_bridge(first) and choose_bridge(self.bridge.counts.literal, first.counts.literal):
            self.saved = order
            return [self.bridge], True
        ties = 1
        while ties < len(order) and abs(order[-1 - ties].score - first.score) < TIE:
            ties += 1
        self.saved = order[: len(order) - ties]
        return [*order[len(order) - ties : -1][::-1], first], False

    def prefers_bridge(self, first: Scored) -> bool:
        c, r = self.bridge.counts, first.counts
        a = 1 + area(c.bp, c.bn) - area(self.P, self.N)
        s = combine(2 + mcc(c.p, c.n, self.P, self.N), a)
        return s > first.score and c.p > r.p and (c.bp // c.p < 50 or r.p / self.P < 0.1)

    def next_best(self) -> list[Scored]:
        """The next ties among the saved, the one to take last."""
        out: list[Scored] = []
        while self.saved and (not out or abs(self.saved[-1].score - out[0].score) < TIE):
            out.append(self.saved.pop())
        return out
