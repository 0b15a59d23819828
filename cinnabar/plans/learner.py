"""The rule learner: a search on the driver whose every data-sized step is a Spark job.

Rules are learned one at a time until enough positives are covered.  A rule grows a literal at a time: candidates
are counted in one job, the best joins the body, and when it is precise enough the rule is tested on the examples.
Bridge literals, which bring in variables without gain of their own, can be taken back; literals that tie with the
best are kept and resumed for later rules.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinnabar.functions.scores import f1
from cinnabar.operators import bindings as b
from cinnabar.operators.evaluate import Counts, FactCounts, collect_counts, label_counts
from cinnabar.operators.staging import stage
from cinnabar.plans.candidates import Search, enumerate_candidates
from cinnabar.plans.model import Clause, Literal, Predicate
from cinnabar.plans.selection import Scored, Selector, need_regrow


@dataclass(frozen=True)
class LearnerConfig:
    positive_threshold: float = 0.8
    max_iterations: int = 1000
    minimum_inflated_precision: float = 0.85
    minimum_true_precision: float = 0.8
    minimum_f_score: float = 0.85
    maximum_clause_length: int = 25
    maximum_random_literals: int = 2
    maximum_random_trials: int = 5
    minimum_coverage_for_tied_literal: float = 0.1
    num_saved_literals: int = 5
    random_margin: float = 0.03
    run_tests: bool = True
    #: A bridge literal is refused if its bindings would take more than this, at 3 x 8 bytes a value; None: no limit.
    memory_quota: int | None = None


#: What the timers tell apart: staging the examples; generating candidates; ordering them by the variable they join on;
#: counting facts by column, once a run; building the jobs; running them (dealing rows out, joining, filtering and
#: counting are one fused job here); choosing; the bridge test; building binding tables; the test of a finished rule.
STAGES = ("load", "enumerate", "group", "facts", "plan", "evaluate", "select", "bridge", "extend", "test")


def uncovered_target(positives: int, threshold: float) -> int:
    """Positives that may stay uncovered."""
    return int(positives * (1 - threshold))


@dataclass
class State:
    """A rule being built.  bindings are staged; P and N count them."""

    clause: Clause
    bindings: DataFrame
    P: int
    N: int
    stats: Search | None
    blacklist: set[Literal]
    uncovered: DataFrame  # positives that the rules before it left, labelled
    num_uncovered: int
    previous: State | None = None
    from_tie: bool = False
    selector: Selector | None = None


@dataclass(frozen=True)
class Tie:
    literal: Scored
    state: State
    stats: Search


@dataclass
class Learned:
    clauses: list[Clause]
    seconds: float
    uncovered: int
    #: Seconds by stage, see STAGES.
    timers: dict[str, float] = field(default_factory=dict)

    def rules_df(self, spark) -> DataFrame:
        """rule, clause, literals."""
        return spark.createDataFrame([(i, str(c), len(c.body)) for i, c in enumerate(self.clauses)], "rule int, clause string, literals int")


class Learner:
    def __init__(self, examples: DataFrame, target: Predicate, background: Sequence[Predicate], relations: b.Relations, config: LearnerConfig = LearnerConfig()):  # noqa: B008
        """examples: v0, ..., label."""
        self.config, self.target, self.relations = config, target, relations
        self.background = list(background)
        self.facts = FactCounts(relations)
        self.timers: dict[str, float] = dict.fromkeys(STAGES, 0.0)
        self.examples = self.timed("load", stage, examples, "examples")
        positives, self.num_negative = label_counts(self.examples)
        if not self.num_negative:
            raise ValueError("positive-only data is not supported")
        self.negatives = self.examples.where(~F.col(b.LABEL))
        self.uncovered = self.examples.where(F.col(b.LABEL))
        self.num_uncovered = positives
        self.most_uncovered = uncovered_target(positives, config.positive_threshold)
        self.first_search: Search | None = None
        self.ties: list[Tie] = []
        self.clauses: list[Clause] = []

    def timed(self, what: str, f, *args):
        began = time.monotonic()
        try:
            return f(*args)
        finally:
            self.timers[what] += time.monotonic() - began

    # the search

    def learn(self) -> Learned:
        began = time.monotonic()
        state: State | None = self.fresh()
        for _ in range(self.config.max_iterations):
            while state is not None:
                more, state = self.grow(state)
                if not more:
                    break
            if self.num_uncovered <= self.most_uncovered:
                break
            state = self.resume()
            if state is None:
                if self.stuck or self.num_uncovered <= self.most_uncovered:  # a tie may have covered the rest
                    break
                state = self.fresh()
        return Learned(list(self.clauses), time.monotonic() - began, self.num_uncovered, dict(self.timers))

    #: Set when a fresh start would repeat a search that has just failed.
    stuck = False

    def fresh(self) -> State:
        """The most general clause over the positives left; a fresh start from the same positives can't do better."""
        self.started_with = self.num_uncovered
        rows = self.uncovered.unionByName(self.negatives)
        return State(Clause.most_general(self.target), rows, self.num_uncovered, self.num_negative, self.first_search, set(), self.uncovered, self.num_uncovered)

    def grow(self, state: State) -> tuple[bool, State | None]:
        """One literal: (go on with this rule?, its next state)."""
        c = self.config
        search, left = self.timed("enumerate", enumerate_candidates, state.clause, self.background, state.stats)
        literals = self.timed("group", lambda: sorted((x for p in left for x in left[p]), key=lambda x: (x.terms[x.join_key], self.background.index(x.predicate))))
        counts = collect_counts(state.bindings, literals, self.relations, self.facts, timed=self.timed)
        bridges = sum(state.clause.random) < c.maximum_random_literals and len(state.blacklist) < c.maximum_random_trials and state.P // max(state.num_uncovered, 1) < 50
        selector = Selector(state.clause, state.P, state.N, state.num_uncovered, state.blacklist, c.num_saved_literals, c.random_margin, bridges)
        search.dead.update(x.literal for x in counts if x.p == 0)
        self.timed("select", lambda: [selector.insert(x) for x in counts])
        found, random = selector.best(lambda r, s: self.timed("bridge", self.choose_bridge, state, selector, r, s))
        if not found:
            return self.give_up(state)
        best = found.pop()
        if need_regrow(state.clause, best.counts.literal, best.counts.n):
            random = False
            regrown = self.regrow(state, selector, search, found)
            if regrown is None:
                return self.give_up(state)
            state, selector, search, best, found = regrown
        for tie in found:
            if tie.counts.p > c.minimum_coverage_for_tied_literal * state.num_uncovered:
                self.ties.append(Tie(tie, state, search))
        return self.add(state, best, random, False, search, selector)

    def give_up(self, state: State) -> tuple[bool, None]:
        if not self.ties and self.num_uncovered == self.started_with:
            self.stuck = True
        return False, None

    def regrow(self, state: State, selector: Selector, search: Search, queue: list[Scored]):
        """Try the next candidates, and the clause before the bridge when there are none: (state, selector, search, best, ties)."""
        while True:
            while queue:
                best = queue.pop()
                if not need_regrow(state.clause, best.counts.literal, best.counts.n):
                    return state, selector, search, best, queue
            queue = selector.next_best()
            if not queue:
                before = state.previous
                if before is None or before.selector is None:
                    return None
                before.blacklist.add(state.clause.last_unbound())
                search, state, selector = state.stats, before, before.selector
                queue = selector.next_best()
                if not queue:
                    return None

    def add(self, state: State, best: Scored, random: bool, tied: bool, search: Search, selector: Selector | None) -> tuple[bool, State | None]:
        c, counts = self.config, best.counts
        length = len(state.clause.body)
        if not random and (counts.precision >= c.minimum_inflated_precision or length >= c.maximum_clause_length):
            if self.timed("test", self.finish, state, counts):
                return False, None
            if tied or state.from_tie or length >= c.maximum_clause_length:
                if self.num_uncovered == self.started_with and not self.ties:
                    self.stuck = True
                return False, None
        clause = state.clause.add(counts.literal, random)
        rows = self.timed("extend", stage, b.extend(state.bindings, counts.literal, self.relations), "bindings")
        if random:
            state.selector = selector
        if length == 0:
            self.first_search = search
        new = State(clause, rows, counts.bp, counts.bn, search, set(state.blacklist), state.uncovered, state.num_uncovered, state if random else None, tied or state.from_tie)
        return True, new

    def resume(self) -> State | None:
        """Continue the latest tie that can be extended; ties that finish or fail at once are used up on the way."""
        while self.ties and self.num_uncovered > self.most_uncovered:
            tie = self.ties.pop()
            counts = tie.literal.counts
            if need_regrow(tie.state.clause, counts.literal, counts.n):
                continue
            more, state = self.add(tie.state, tie.literal, False, True, tie.stats, None)
            if more:
                return state
        return None

    # data

    def covered_heads(self, state: State, literal: Literal) -> DataFrame:
        got = b.covered(state.bindings, literal, self.relations)
        return got.select(*(f"v{i}" for i in range(self.target.arity)), b.LABEL)

    def finish(self, state: State, counts: Counts) -> bool:
        """Accept the rule if it is precise on the examples, and remove the positives that it covers."""
        c, k = self.config, self.target.arity
        found = stage(self.covered_heads(state, counts.literal).distinct(), "heads")
        good, bad = found.where(F.col(b.LABEL)), found.where(~F.col(b.LABEL))
        p = b.with_heads(state.uncovered, good, k).count()
        n = b.with_heads(self.negatives, bad, k).count()
        precision = p / (p + n) if p + n else 0.0
        recall = p / state.num_uncovered if state.num_uncovered else 0.0
        if precision < c.minimum_true_precision and f1(precision, recall) < c.minimum_f_score:
            return False
        self.uncovered = stage(b.without_heads(self.uncovered, good, k), "uncovered")
        self.num_uncovered = self.uncovered.count()
        self.clauses.append(replace(state.clause.add(counts.literal)))
        return True

    def choose_bridge(self, state: State, selector: Selector, bridge: Literal, regular: Literal) -> bool:
        """Does the bridge keep more of the uncovered positives than the regular literal, which loses many?"""
        quota, x = self.config.memory_quota, selector.bridge.counts
        if quota is not None and 3 * 8 * (len(bridge.unbound) + state.clause.width) * (x.bp + x.bn) > quota:
            return False
        k = self.target.arity

        def kept(literal: Literal) -> int:
            good = self.covered_heads(state, literal).where(F.col(b.LABEL))
            return b.with_heads(state.uncovered, good, k).count()

        by_regular = kept(regular)
        if by_regular >= 0.8 * state.num_uncovered:
            return False
        return kept(bridge) >= 1.2 * by_regular
