"""Many patterns found in many texts, in one pass over each text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton, which every task builds for itself; more patterns are searched in blocks.
PATTERN_BYTES = 1 << 20


class Patterns:
    """An automaton over texts: which of them a text holds."""

    def __init__(self, texts: list[str]):
        self.everywhere = {i for i, x in enumerate(texts) if x == ""}
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(texts):
            if x:
                self.automaton.add_word(x, i)
        if len(self.automaton):
            self.automaton.make_automaton()

    def held(self, text: str) -> set[int]:
        return self.everywhere | ({i for _, i in self.automaton.iter(text)} if len(self.automaton) else set())


def in_pattern_blocks(checks: DataFrame, size: Column, run: Callable[[list], DataFrame], most: int = PATTERN_BYTES) -> DataFrame:
    """run(rows) for blocks of checks of about ``most`` bytes, or one larger check; results together.  Only a block's rows reach the driver."""
    total = checks.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // most))
    blocks = [checks if n == 1 else checks.filter(F.pmod(F.xxhash64(*checks.columns), F.lit(n)) == i) for i in range(n)]
    return reduce(DataFrame.unionByName, [run(b.collect()) for b in blocks])


def count_holding(records: DataFrame, text: Column, checks: DataFrame, name: str, parts: str, most: int = PATTERN_BYTES) -> DataFrame:
    """name and matches: how many records hold all parts of each check (name, and parts, an array of texts); checks that none holds don't come.

    Each task adds up its own counts, so a row for each task and check is shuffled, whatever the number of records.
    """

    def run(rows: list) -> DataFrame:
        texts = sorted({x for r in rows for x in r[parts]})
        number = {x: i for i, x in enumerate(texts)}
        wanted = [(r[name], {number[x] for x in r[parts]}) for r in rows if r[parts]]
        # A check is looked at only where its longest part is held.
        by_part: dict[int, list[int]] = {}
        for i, (_, own) in enumerate(wanted):
            by_part.setdefault(max(own, key=lambda k: len(texts[k])), []).append(i)
        shared = records.sparkSession.sparkContext.broadcast((texts, wanted, by_part))

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            texts, wanted, by_part = shared.value
            patterns, counts = Patterns(texts), [0] * len(wanted)
            for f in frames:
                for x in f["text"]:
                    if x is not None:
                        found = patterns.held(x)
                        for k in found & by_part.keys():
                            for i in by_part[k]:
                                counts[i] += wanted[i][1] <= found
            some = [i for i, n in enumerate(counts) if n]
            if some:
                yield pd.DataFrame({"name": [wanted[i][0] for i in some], "n": [counts[i] for i in some]})

        return records.select(text.alias("text")).mapInPandas(count, "name string, n long")

    found = in_pattern_blocks(checks, F.aggregate(parts, F.lit(0), lambda a, x: a + F.octet_length(x)), run, most)
    return found.groupBy("name").agg(F.sum("n").alias("matches")).withColumnRenamed("name", name)


def first_holding(records: DataFrame, text: str, order: str, checks: DataFrame, name: str, most: int = PATTERN_BYTES) -> DataFrame:
    """name and text: the first record, by order and then by text, that holds each check's name; checks that none holds don't come."""
    kind = records.schema[order].dataType.simpleString()

    def run(rows: list) -> DataFrame:
        shared = records.sparkSession.sparkContext.broadcast([r[name] for r in rows])

        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = shared.value
            patterns, first = Patterns(names), {}
            for f in frames:
                for at, x in zip(f["at"], f["text"], strict=True):
                    if x is not None and at is not None and at == at:
                        for i in patterns.held(x):
                            if i not in first or (at, x) < first[i]:
                                first[i] = at, x
            if first:
                yield pd.DataFrame({"name": [names[i] for i in first], "at": [v[0] for v in first.values()], "text": [v[1] for v in first.values()]})

        return records.select(F.col(order).alias("at"), F.col(text).alias("text")).mapInPandas(find, f"name string, at {kind}, text string")

    found = in_pattern_blocks(checks.select(name).filter(F.col(name).isNotNull()).distinct(), F.octet_length(name), run, most)
    return found.groupBy("name").agg(F.min_by("text", F.struct("at", "text")).alias("text")).withColumnRenamed("name", name)
