"""First matching rule of many, by an index of the literals that patterns must contain.

Every pattern is parsed, and the longest run of characters that each of its matches holds goes into one automaton per archive.
A path is read once by the automaton; only rules whose literal occurs in it, and those without any, are tried, in their order.
So the work on a path grows with the rules that it resembles and not with the number of rules. Rules are driver-side
configuration and travel with the job; members are never shuffled.

Patterns are Python patterns; classes such as \\w hold ASCII only, as in the chain of `classify`. Null paths match no rule.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from re import _constants as kinds
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.functions.text import NESTED_MARK
from sievework.registry import PathRule

NO_RULE = -1
RULE_COLUMNS = "rule_no INT, rule_exclude STRING, rule_skip STRING, raw_label STRING, split_source STRING, rule_tries INT"


def needed_literal(pattern: str) -> str:
    """The longest run of characters that every match of the pattern contains; '' where there is none to be sure of."""
    tree = parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs: list[str] = []
    _collect(tree, runs, [""])
    return max(runs, key=len, default="")


def _collect(tree, runs: list[str], open_run: list[str]) -> None:
    """Add the literal runs of a sequence to `runs`. `open_run` holds the run that goes on, across groups that are passed once."""
    def close() -> None:
        runs.append(open_run[0])
        open_run[0] = ""

    for kind, value in tree:
        if kind is kinds.LITERAL:
            open_run[0] += chr(value)
        elif kind is kinds.IN and len(value) == 1 and value[0][0] is kinds.LITERAL:
            open_run[0] += chr(value[0][1])
        elif kind is kinds.AT:
            continue  # a place has no width
        elif kind is kinds.SUBPATTERN and not value[1] & re.IGNORECASE:
            own = [open_run[0]]
            _collect_group(value[3], runs, own)
            open_run[0] = own[0]
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] >= 1:
            close()
            inside = [""]
            _collect_group(value[2], runs, inside)
            runs.append(inside[0])
        else:
            close()
    runs.append(open_run[0])


def _collect_group(tree, runs: list[str], open_run: list[str]) -> None:
    before = len(runs)
    _collect(tree, runs, open_run)
    # what was open at the end of the group is not closed yet
    if len(runs) > before:
        runs.pop()


class RuleIndex:
    """The rules of one archive, given with their numbers."""

    def __init__(self, rules: Sequence[tuple[int, PathRule]]):
        import ahocorasick
        self.rules = {n: (re.compile(r.pattern, re.ASCII), r) for n, r in rules}
        by_literal = defaultdict(list)
        for n, r in rules:
            by_literal[needed_literal(r.pattern)].append(n)
        self.always = by_literal.pop("", [])
        self.words = None
        if by_literal:
            self.words = ahocorasick.Automaton()
            for literal, numbers in by_literal.items():
                self.words.add_word(literal, numbers)
            self.words.make_automaton()

    def first(self, path: str) -> tuple[int, re.Match | None, int]:
        """(number of the first rule that matches, its match, patterns tried)."""
        numbers = set(self.always)
        if self.words is not None:
            for _, found in self.words.iter(path):
                numbers.update(found)
        for tries, n in enumerate(sorted(numbers), 1):
            if match := self.rules[n][0].search(path):
                return n, match, tries
        return NO_RULE, None, len(numbers)


def _group(match: re.Match | None, name: str) -> str:
    return (match.groupdict().get(name) or "") if match else ""


def match_indexed(members: DataFrame, placed: Sequence[tuple[str | None, PathRule]], path_col: str = "member_path") -> DataFrame:
    """Add the columns of the first matching rule, as `classify.apply_archive_rules` does, and `rule_tries`.

    `placed` lists (archive, rule) in order; a rule without an archive holds for all. `members` has archive and the path.
    """
    columns = members.columns
    listed = sorted({a for a, _ in placed if a is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {a: RuleIndex([(n, r) for n, (b, r) in enumerate(placed) if b is None or b == a]) for a in [None, *listed]}
        for batch in batches:
            rows = []
            for archive, path in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                index = indexes.get(archive, indexes[None])
                number, match, tries = index.first(path) if path is not None else (NO_RULE, None, 0)
                rule = index.rules[number][1] if match else PathRule("")
                skip = rule.skip
                if path is not None and NESTED_MARK in path:
                    outer, _, more = index.first(path.partition(NESTED_MARK)[0])
                    tries += more
                    # a nested archive that is skipped is skipped with all that is in it
                    skip = (index.rules[outer][1].skip if outer != NO_RULE else None) or skip
                label = rule.label if rule.label is not None else _group(match, "label")
                rows.append((number, rule.exclude, skip, label, _group(match, "split") or None, tries))
            found = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(c, k) for c, k in zip(found, [pa.int32(), *[pa.string()] * 4, pa.int32()], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], [*columns, *[c.split()[0] for c in RULE_COLUMNS.split(", ")]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    return members.select("*", members["archive"].alias("_archive"), members[path_col].alias("_path")).mapInArrow(run, f"{kept}, {RULE_COLUMNS}")
