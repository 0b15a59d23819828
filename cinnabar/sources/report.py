"""What a learning run reports: text for people, a tab-separated row for scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cinnabar.plans.learner import Learned

COLUMNS = ("positives", "negatives", "covered_positives", "covered_negatives", "precision", "recall", "f1")


def lines(learned: Learned, metrics: DataFrame | None) -> list[str]:
    out = [f"Learning took {learned.seconds:.3f} seconds", f"Rules: {len(learned.clauses)}", *map(str, learned.clauses)]
    if metrics is not None:
        row = metrics.first()
        out += [f"{c}: {row[c]}" for c in COLUMNS]
    return out


def summary_row(positives: int, negatives: int, learned: Learned, metrics: DataFrame | None) -> str:
    """Training positives and negatives, seconds, covered test positives and negatives, precision, recall."""
    cells: list[object] = [positives, negatives, f"{learned.seconds:.3f}"]
    if metrics is not None:
        row = metrics.first()
        cells += [row["covered_positives"], row["covered_negatives"], row["precision"], row["recall"]]
    return "\t".join(map(str, cells))
