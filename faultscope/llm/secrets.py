"""Secret scans: all rules in one pass over the bytes of a text.

The rules become one minimal automaton (``automaton``); a text is mapped to byte classes and
read once. Whenever a rule's match ends, the rule's reversed automaton finds its start, at or
behind the end of its last match, and the length test of the rule decides. Rules hold ASCII
only, so byte and character matching agree; spans are code points, end exclusive.

``assign``, ``access`` and ``hex`` are the base rules; the others add spans and take none
away. Tables depend on the rules alone and are broadcast. Edge cases: null text is empty;
repeated rows are scanned each; very long texts cost their length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .automaton import compile_backwards, compile_rules
from .common import batch_of, share, table


class Rule(NamedTuple):
    kind: str
    pattern: str
    least: int
    value: str | None = None  # the part whose length counts, behind this prefix of the match


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
_HEAD = f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?"
#: The base rules have the 16 hex digits and so on of the contract; a shorter match is dropped.
RULES = [
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", 12, _HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
    Rule("repo", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("key", "-----BEGIN [A-Z ]+PRIVATE KEY-----", 0),
    Rule("web", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
]
BASE = 3


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.forward = compile_rules([r.pattern for r in rules])
        self.backward = [compile_backwards(r.pattern) for r in rules]

    def start_of(self, rule: int, data: bytes, low: int, end: int) -> int:
        """The furthest start, not before ``low``, of a match that ends at ``end``."""
        classes, step, accept = self.backward[rule]
        state, start, at = 0, end, end
        while at > low and state >= 0:
            at -= 1
            state = step[state][classes[data[at]]]
            if state in accept:
                start = at
        return start

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, all matches before the length test."""
        f, state, found, last = self.forward, 0, [], [0] * len(self.rules)
        table, event = f.table, f.event
        for at, c in enumerate(data.translate(f.classes)):
            state = table[state + c]
            if state >= event:
                for rule in f.ended[state]:
                    found.append((self.start_of(rule, data, last[rule], at), rule, at))
                    last[rule] = at
        for rule in f.open.get(state, ()):
            found.append((self.start_of(rule, data, last[rule], len(data)), rule, len(data)))
        return found

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, sorted."""
        data = (text or "").encode()
        out, at, before = [], 0, 0
        for start, k, end in sorted(self.matches(data)):  # by start: code points are counted once over the text
            rule = self.rules[k]
            size = end - start
            if rule.value:
                size -= re.match(rule.value.encode(), data[start:end]).end()
            if size >= rule.least:
                at, before = start, before + len(data[at:start].decode())
                out.append((before, k, before + end - start))
        return sorted(out)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """One row per input row: id, found: array of (kind, start, stop) by start, then rule."""
    scanner = share(docs.sparkSession, Scanner(rules))
    schema = pa.schema([("id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        s = scanner.value
        for b in batches:
            if b.num_rows:
                yield batch_of(schema, [b.column(0), [[{"kind": rules[k].kind, "start": a, "stop": e} for a, k, e in s.scan(t.as_py())] for t in b.column(1)]])

    out = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, "id long, found array<struct<kind: string, start: long, stop: long>>")
    return out.withColumnRenamed("id", id_col)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*(r.kind for r in RULES[:BASE])))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in RULES[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
