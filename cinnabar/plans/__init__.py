"""Symbolic search: clauses, candidates, selection, the learner."""
