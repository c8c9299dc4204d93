"""Quality rules as a short-circuit cascade.

Each task measures on its first documents what every rule costs and how often it rejects, orders the rules by
rejections per second, and stops at the first rule that rejects a document. A document is kept if no rule rejects it,
so the verdict doesn't depend on the order and is the same however rows are dealt to tasks.

Null and empty texts have no words and are rejected for having too few. Rows are judged one by one: repeated rows,
repeated ids and null ids get a verdict each. An empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import map_text

SYMBOLS = b"#*$%&|<>"
#: Documents on which a task measures its rules before it orders them.
SAMPLE = 200


class Document:
    """The measures of one text, each worked out when first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""
        self.words = self.text.split()
        self.n_words = len(self.words)
        self._got: dict[str, int] = {}

    def __getattr__(self, name: str) -> int:
        got = self.__dict__["_got"]
        if name not in got:
            if name not in MEASURES:
                raise AttributeError(name)
            got[name] = MEASURES[name](self)
        return got[name]


def code_points(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def word_chars(doc: Document) -> int:
    return code_points(b"".join(doc.words))


def n_symbols(doc: Document) -> int:
    return sum(doc.text.count(bytes([c])) for c in SYMBOLS)


def n_dup_lines(doc: Document) -> int:
    lines = [x for x in doc.text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def n_lines(doc: Document) -> int:
    return sum(1 for x in doc.text.split(b"\n") if x.strip())


def n_upper(doc: Document) -> int:
    codes = np.frombuffer(doc.text, np.uint8)
    return int(np.count_nonzero((codes >= 65) & (codes <= 90)))


def n_lower(doc: Document) -> int:
    codes = np.frombuffer(doc.text, np.uint8)
    return int(np.count_nonzero((codes >= 97) & (codes <= 122)))


def n_repeat_words(doc: Document, window: int = 5) -> int:
    """Words that some window of five words covers which occurs twice or more in the text. Exact: no hashes."""
    n = doc.n_words - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in doc.words), np.int64, doc.n_words)
    size, grams = len(ids), codes[:n]
    for step in range(1, window):  # a window's number is packed while it fits, and else renumbered
        if int(grams.max()) * size + size >= 1 << 62:
            grams = np.unique(grams, return_inverse=True)[1]
        grams = grams * size + codes[step : n + step]
    _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
    starts = counts[inverse] > 1
    if not starts.any():
        return 0
    change = np.zeros(doc.n_words + 1, np.int64)
    change[:n] += starts
    change[window : n + window] -= starts
    return int(np.count_nonzero(np.cumsum(change)[: doc.n_words]))


MEASURES: dict[str, Callable[[Document], int]] = {"word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": n_lines, "n_upper": n_upper, "n_lower": n_lower, "n_repeat_words": n_repeat_words}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


#: Rules of the base verdict, and those that the method adds. A clean text passes each with room to spare.
BASE = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda d: 100 * d.n_symbols > 30 * d.n_words),
    Rule("word_length", lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 25 * d.n_words),
    Rule("duplicate_lines", lambda d: 100 * d.n_dup_lines > 50 * d.n_lines),
    Rule("upper_case", lambda d: d.n_upper > d.n_lower and d.n_upper > 2 * d.n_words),
)


class Cascade:
    """Judges documents, and learns the order of its rules from the first of them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE):
        self.rules, self.sample, self.seen = list(rules), sample, 0
        self.seconds, self.rejected = dict.fromkeys((r.name for r in rules), 1e-9), dict.fromkeys((r.name for r in rules), 0)

    def keeps(self, text: bytes | None) -> bool:
        if self.seen < self.sample:
            self.seen += 1
            verdict = self._measure(text)
            if self.seen == self.sample:
                self.rules.sort(key=lambda r: -self.rejected[r.name] / self.seconds[r.name])
            return verdict
        doc = Document(text)
        return not any(rule.rejects(doc) for rule in self.rules)

    def _measure(self, text: bytes | None) -> bool:
        """All rules on a document of their own each, so that none gains from a measure that another asked for."""
        verdict = True
        for rule in self.rules:
            doc = Document(text)
            began = time.perf_counter()
            rejects = rule.rejects(doc)
            self.seconds[rule.name] += time.perf_counter() - began
            self.rejected[rule.name] += rejects
            verdict &= not rejects
        return verdict


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, report: bool = False) -> DataFrame:
    """keep columns and kept; with report also n_words, the four base measures and base_failed, for every document."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if report else []
    made = T.StructType([*[T.StructField(c, T.LongType()) for c in longs], *([T.StructField("base_failed", T.BooleanType())] if report else []), T.StructField("kept", T.BooleanType())])

    def work():
        cascade = Cascade(rules)

        def block(texts: list[bytes | None]) -> dict:
            got: dict[str, list] = {f.name: [] for f in made.fields}
            for x in texts:
                got["kept"].append(cascade.keeps(x))
                if report:
                    doc = Document(x)
                    for c in longs:
                        got[c].append(getattr(doc, c))
                    got["base_failed"].append(any(r.rejects(doc) for r in BASE))
            return {c: np.array(v, bool if c in ("kept", "base_failed") else np.int64) for c, v in got.items()}

        return block

    return map_text(docs, text, list(keep), made, work)


def filter_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns as they were, whatever their names."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    kept = judge(docs.toDF(*own), own[docs.columns.index(text)], tuple(own), rules).where("kept").drop("kept")
    return kept.toDF(*docs.columns)


#: DuckDB SQL for judge(report=True) over documents.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM d),
g AS (
  SELECT row, i, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 6)),
f AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
r AS (SELECT row, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words FROM f, (SELECT unnest(range(0, 5)) AS k) GROUP BY row),
a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, n_upper, n_lower
  FROM m LEFT JOIN r USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR (n_upper > n_lower AND n_upper > 2 * n_words)) AS kept
FROM b
"""
