"""Quality rules as a short-circuit cascade.

Base counts are returned for every row. A row that passes the base limits goes through the
rules one by one and leaves at the first that rejects it. The order comes from a random sample:
each rule's cost (seconds) and selectivity (share of rows that it rejects) are taken in the tasks
that hold the sample's rows, only their sums reach the driver, and rules are sorted by rejection per cost, greatest first. Rules are conjunctive, so the order
changes the work, never the verdict.

Edge cases: null text counts as no words (base fails); texts of any length are taken whole;
repeated rows get equal results; an empty table gives an empty result; only the id and text
columns are read, whatever else the input holds.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, strings, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
_SHOUT = re.compile(rb"(?<![^\x20\x09-\x0D])[A-Z]{2}[^\x20\x09-\x0Da-z]*(?![^\x20\x09-\x0D])")


class Text:
    """One text with its base counts; further counts are taken only when a rule asks."""

    __slots__ = ("text", "raw", "words", "n_words", "word_chars", "n_symbols", "lines")

    def __init__(self, text: str) -> None:
        self.text = text
        self.raw = text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()  # splits at exactly \x20 and \x09-\x0D
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(text.count(c) for c in SPACES)
        self.n_symbols = sum(text.count(c) for c in SYMBOLS)
        self.lines = None

    def dup_lines(self) -> int:
        seen, n, full = set(), 0, 0
        for line in self.raw.split(b"\n"):
            if line.strip():
                full += 1
                n += line in seen
                seen.add(line)
        self.lines = full
        return n

    def repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        pair = a[:-1] * np.int64(len(ids)) + a[1:]
        if len(ids) >= 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        triple = pair[:-1] * np.int64(len(ids)) + a[2:]
        order = np.sort(triple)
        twice = order[1:][order[1:] == order[:-1]]
        if not twice.size:
            return 0
        at = np.flatnonzero(np.isin(triple, np.unique(twice)))
        hit = np.zeros(n, bool)
        hit[at] = hit[at + 1] = hit[at + 2] = True
        return int(hit.sum())


#: name -> does the rule reject the text? Integer arithmetic only, so SQL gives the same.
RULES: dict[str, Callable[[Text, int], bool]] = {
    "symbols": lambda t, dup: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t, dup: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words,
    "exclamation": lambda t, dup: 10 * t.text.count("!") > t.n_words,
    "shouting": lambda t, dup: 10 * len(_SHOUT.findall(t.raw)) > 3 * t.n_words,
    "duplicate_lines": lambda t, dup: 10 * dup > 5 * (t.raw.count(b"\n") + 1),
}


COSTS = "rule string, n long, rejected long, seconds double"


def measure(texts: list[str]) -> dict[str, tuple[int, int, float]]:
    """Rule -> texts it was tried on (those of 50 words or more), how many it rejects, seconds."""
    rows = [t for t in map(Text, texts) if t.n_words >= 50]
    dups = [t.dup_lines() for t in rows]
    out = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejected = sum(rule(t, d) for t, d in zip(rows, dups))
        out[name] = len(rows), rejected, time.perf_counter() - began
    return out


def ranked(figures: dict[str, tuple[int, int, float]]) -> list[str]:
    """Rule names by rejection per cost; free of rows, the order of RULES."""
    rate = {name: rejected / n / max(seconds, 1e-9) for name, (n, rejected, seconds) in figures.items() if n}
    return sorted(RULES, key=lambda name: -rate.get(name, 0.0))


def estimate_order(texts: list[str]) -> list[str]:
    """Rule names by rejection per cost on ``texts``."""
    return ranked(measure(texts))


def sampled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """A random sample of all ``rows``: about ``sample_rows`` less four standard deviations, half as many at least."""
    n = rows.count()
    aim = max(sample_rows / 2, sample_rows - 4 * sample_rows**0.5)
    return rows if n <= sample_rows else rows.sample(aim / n, seed=10)


def measured_order(rows: DataFrame, sample_rows: int) -> list[str]:
    """The rules' order on a sample of ``rows``: tasks try the rules, the driver gets one row of sums a rule."""

    def run(batches):
        release()
        total = {name: (0, 0, 0.0) for name in RULES}
        for batch in batches:
            for name, found in measure(strings(batch.column(0))).items():
                total[name] = tuple(x + y for x, y in zip(total[name], found))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
        cols = zip(*[(name, *found) for name, found in total.items()])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in COSTS.split(", ")])

    sums = sampled(rows, sample_rows).select("text").mapInArrow(run, COSTS).groupBy("rule").agg(*[F.sum(x).alias(x) for x in ("n", "rejected", "seconds")])
    return ranked({r.rule: (r.n, r.rejected, r.seconds) for r in sums.collect()})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 500) -> DataFrame:
    """Base counts and the cascade's verdict for every row of ``docs``.

    ``sample_rows`` bounds the sample that orders the rules and nothing else.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = measured_order(rows, sample_rows)

    def run(batches):
        release()
        for batch in batches:
            out = []
            for text in strings(batch.column(1)):
                t = Text(text)
                dup, rep = t.dup_lines(), t.repeat_words()
                failed = t.n_words < 50 or 100 * rep > 50 * t.n_words
                by = "base" if failed else next((n for n in order if RULES[n](t, dup)), None)
                out.append((t.n_words, t.word_chars, t.n_symbols, dup, rep, failed, by is None, by))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts and verdict of all documents (``rejected_by`` depends on the measured order)."""
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g')) AS bangs, length(regexp_replace(text, '[^\n]', '', 'g')) + 1 AS n_lines,
    len(list_filter(ws, lambda x: regexp_full_match(x, '[A-Z]{2}[^a-z]*'))) AS shouts
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * bangs > n_words
       OR 10 * shouts > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines) AS kept
FROM b
"""
