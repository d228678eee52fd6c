"""Rules by their literals: the same as the chain of all rules, in few tries."""

import random
import re

import pytest

from sievework.operators import classify
from sievework.operators.classify import apply_archive_rules
from sievework.operators.rule_index import RuleIndex, match_indexed, needed_literal
from sievework.registry import Archive, Dataset, PathRule


@pytest.mark.parametrize("pattern,literal", [
    ("abc", "abc"), ("^/train/(?P<label>[^/]+)/x", "/train/"), ("a(bc)d", "abcd"), ("(ab|cd)efg", "efg"), ("(?:xy)+z", "xy"), ("a?bcd*e", "bc"),
    ("(?i)abc", ""), ("[abc]", ""), ("a|b", ""), (r"\.jpe?g$", ".jp"), ("[x]yz", "xyz"), ("(?:a(?:b(c)))d?e", "abc"), ("(?=abc)d", "d"), ("x{3}yy", "yy"),
    (r"(?P<split>tr|xe)/(?P<label>\w+)/", "/"), ("", ""), ("(?i:abc)de", "de"), ("(ab)?(cde)", "cde")])
def test_literals(pattern, literal):
    assert needed_literal(pattern) == literal


def random_pattern(rng):
    parts = ["/", "a", "bc", "train", "te", r"\d+", "[^/]+", "(?P<label>[a-z]+)", "(x|yz)", "(?:q)?", ".", "_", "(?P<split>tr|te)", r"\.zip!/", "^", "$"]
    while True:
        pattern = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        try:
            re.compile(pattern)
        except re.error:
            continue
        return pattern


def test_every_match_holds_its_literal():
    rng = random.Random(1)
    for _ in range(3000):
        pattern = random_pattern(rng)
        path = "".join(rng.choice(["/", "a", "bc", "train", "te", "7", "x", "yz", "q", "_", ".zip!/"]) for _ in range(8))
        assert not re.search(pattern, path) or needed_literal(pattern) in path


def test_same_as_the_chain(spark, monkeypatch):
    rng = random.Random(4)
    rules = [PathRule(random_pattern(rng), *[rng.choice([None, None, f"{kind}{i}"]) for kind in ("l", "e", "s")]) for i in range(60)]
    one = Dataset("one", "c", 0, {}, {}, (), (Archive("a", tuple(rules[:30])), Archive("b", tuple(rules[30:]))))
    pieces = ["/", "a", "bc", "train", "te", "7", "x", "yz", "q", "_", ".zip!/"]
    paths = [(rng.choice("abz"), "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))), i) for i in range(600)] + [("a", "", 600), ("b", None, 601)]
    members = spark.createDataFrame(paths, "archive STRING, member_path STRING, size BIGINT")
    got = match_indexed(members, [(a.file, r) for a in one.archives for r in a.rules])
    assert sorted(map(tuple, got.drop("rule_tries").collect()), key=str) == sorted(map(tuple, apply_archive_rules(members, [one]).select(
        *got.drop("rule_tries").columns).collect()), key=str)
    chain = sorted(map(tuple, apply_archive_rules(members, [one]).collect()), key=str)
    monkeypatch.setattr(classify, "CHAIN_RULES", 10)
    assert sorted(map(tuple, apply_archive_rules(members, [one]).collect()), key=str) == chain
    assert match_indexed(members.limit(0), [("a", rules[0])]).count() == 0


def test_tries_do_not_grow_with_the_rules():
    """Of 5,000 rules a path meets those alone whose folder it names."""
    index = RuleIndex([(i, PathRule(f"^set{i:04d}/(train|test)/(?P<label>[^/]+)/")) for i in range(5000)])
    tries = [index.first(f"set{i:04d}/train/leaf/{i}.jpg") for i in range(0, 5000, 37)]
    assert [n for n, _, _ in tries] == list(range(0, 5000, 37)) and max(t for *_, t in tries) == 1
    assert index.first("other/train/leaf/1.jpg") == (-1, None, 0)
