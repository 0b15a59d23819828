"""A JSON catalog of relations, and the text scan that loads them.

Text relations hold a tuple a line, fields split by '|'.  Empty lines and lines that start with '#' are skipped.  A
line with a wrong number of fields fails the job, whatever columns are read, and so does a field that is not of its
column's type: an integer, unless the attribute's "type" says otherwise.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.operators import bindings as b
from cinnabar.operators.partitioning import numbered
from cinnabar.plans.learner import Learned, Learner, LearnerConfig
from cinnabar.plans.model import Predicate
from cinnabar.plans.theory import metrics

_STRING_OR_COMMENT = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|#[^\n]*|/\*.*?\*/', re.S)


def strip_comments(text: str) -> str:
    return _STRING_OR_COMMENT.sub(lambda m: m[1] or " ", text)


#: What an attribute's "type" may be, and the column's.
TYPES = {"int": "bigint", "long": "bigint", "double": "double", "string": "string"}


@dataclass(frozen=True)
class Entry:
    """A relation of the catalog: the domain type of each field, None for skipped ones, and the columns' types."""

    name: str
    file: str
    fields: tuple[int | None, ...]
    key: int = -1
    num_positive: int | None = None
    kinds: tuple[str, ...] | None = None  # of all fields; bigint if not given

    @property
    def types(self) -> tuple[int, ...]:
        return tuple(t for t in self.fields if t is not None)


@dataclass(frozen=True)
class Catalog:
    target: Entry
    background: tuple[Entry, ...]
    test_file: str | None = None
    test_positive: int = 0

    @staticmethod
    def parse(text: str, folder: str = "") -> Catalog:
        """Background names without a relation are ignored; relations keep their order, the target comes last."""
        conf = json.loads(strip_comments(text))
        target, wanted = conf.get("target"), set(conf.get("background", ()))
        if not isinstance(target, str):
            raise ValueError("the catalog names no target")
        found: dict[str, Entry] = {}
        for r in conf.get("relations", ()):
            if r["name"] in found:
                raise ValueError(f"relation {r['name']!r} occurs twice")
            fields = []
            for a in r["attributes"]:
                if not isinstance(a.get("domain_type"), int) and not a.get("skip"):
                    raise ValueError(f"an attribute of {r['name']!r} has no domain type")
                if a.get("type", "int") not in TYPES:
                    raise ValueError(f"an attribute of {r['name']!r} is of no known type")
                fields.append(None if a.get("skip") else a["domain_type"])
            entry = Entry(r["name"], _at(folder, r["file"]), tuple(fields), int(r.get("key", -1)), r.get("num_positive"), tuple(TYPES[a.get("type", "int")] for a in r["attributes"]))
            if not -1 <= entry.key < len(entry.types):
                raise ValueError(f"{entry.name!r} has no column {entry.key}")
            found[r["name"]] = entry
        if target not in found or target in wanted:
            raise ValueError(f"the target {target!r} is no relation of its own")
        if not (found[target].num_positive or 0) > 0:
            raise ValueError("the target needs num_positive > 0")
        test = conf.get("test")
        if test is not None and not test.get("num_positive", 0) > 0:
            raise ValueError("the test needs num_positive > 0")
        return Catalog(found[target], tuple(e for n, e in found.items() if n in wanted), _at(folder, test["file"]) if test else None, test["num_positive"] if test else 0)

    @staticmethod
    def load(path: str, folder: str | None = None) -> Catalog:
        """Relative files start from the folder, or else from the catalog's own."""
        with open(path, encoding="utf-8") as f:
            return Catalog.parse(f.read(), os.path.dirname(path) if folder is None else folder)

    def predicates(self) -> dict[str, Predicate]:
        return {e.name: Predicate(i, e.name, e.types, e.key) for i, e in enumerate((*self.background, self.target))}

    def relations(self, spark: SparkSession) -> dict[Predicate, b.Relation]:
        named = self.predicates()
        return {named[e.name]: b.Relation(named[e.name], scan_text(spark, e.file, e.fields, e.kinds)) for e in self.background}

    def examples(self, spark: SparkSession) -> DataFrame:
        return labelled_text(spark, self.target.file, self.target.fields, self.target.num_positive, self.target.kinds)

    def test_examples(self, spark: SparkSession) -> DataFrame:
        if self.test_file is None:
            raise ValueError("the catalog has no test file")
        return labelled_text(spark, self.test_file, self.target.fields, self.test_positive, self.target.kinds)

    def learn(self, spark: SparkSession, config: LearnerConfig = LearnerConfig()) -> tuple[Learned, DataFrame | None]:  # noqa: B008
        """The rules, and their metrics on the test examples if there are any and the config asks for them."""
        named, relations = self.predicates(), self.relations(spark)
        target = named[self.target.name]
        learned = Learner(self.examples(spark), target, list(relations), relations, config).learn()
        return learned, metrics(learned.clauses, self.test_examples(spark), relations) if config.run_tests and self.test_file else None


def _at(folder: str, path: str) -> str:
    return path if not folder or os.path.isabs(path) or "://" in path else os.path.normpath(os.path.join(folder, path))


def _lines(spark: SparkSession, path: str, fields: tuple[int | None, ...], kinds: tuple[str, ...] | None, prefix: str, *order: str) -> DataFrame:
    lines = spark.read.text(path).select("value", *order).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", r"\|", -1)
    wrong = F.raise_error(F.concat(F.lit(f"not {len(fields)} fields: "), F.col("value"))).cast("array<string>")
    checked = lines.withColumn("_f", F.when(F.size(parts) == len(fields), parts).otherwise(wrong))
    kept = [i for i, t in enumerate(fields) if t is not None]
    names = lines.columns[1:]
    # every field of a kept column must be of its type (the cast fails on others) and every line have all fields
    ok = checked.where(F.size("_f") == len(fields))

    def value(i: int):
        kind = kinds[i] if kinds else "bigint"
        return F.col("_f")[i] if kind == "string" else F.trim(F.col("_f")[i]).cast(kind)

    return ok.select(*(value(i).alias(f"{prefix}{k}") for k, i in enumerate(kept)), *names)


def scan_text(spark: SparkSession, path: str, fields: tuple[int | None, ...], kinds: tuple[str, ...] | None = None) -> DataFrame:
    """c0, c1, ...: the fields that are not skipped."""
    return _lines(spark, path, fields, kinds, "c")


def labelled_text(spark: SparkSession, path: str, fields: tuple[int | None, ...], num_positive: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """v0, ..., label: the first num_positive tuples in file order are positive."""
    order = ("_metadata.file_path", "_metadata.file_block_start")
    rows = _lines(spark, path, fields, kinds, "v", *order).withColumn("_id", F.monotonically_increasing_id())
    at = numbered(rows, "file_path", "file_block_start", "_id")
    return at.withColumn(b.LABEL, F.col("row") < num_positive).drop("row", "file_path", "file_block_start", "_id")
