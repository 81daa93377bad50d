"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths and of lines, worked out with numpy over whole
batches of texts, say how many characters of a text lie inside n-grams or lines that the same
text has elsewhere. A text is rejected when too much of it is repetition.

Defined cases: a null or empty text has no words and is rejected by the base rule (under 50
words); equal rows get equal results; an empty table gives an empty table; other columns are
not read by :func:`measure` and pass through :func:`keep` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, documents, map_batches, mix64, per_text, text_bytes, totals, word_spans

# n-gram length in words -> largest share of word characters that repeated n-grams may cover.
# Longer repeats are rarer by chance, so they are allowed less.
COVERAGE = {2: 0.60, 3: 0.50, 5: 0.45, 8: 0.40}
# Largest share of the characters of lines that may lie in lines met before.
LINE_COVERAGE = 0.40
# Largest share of words a text may have in symbol characters.
SYMBOLS_PER_WORD = 0.5
SYMBOLS = b"#*$%&|<>"
# Texts measured together; the working arrays are some hundred times their bytes.
TEXTS = 250

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"cover_{n} double" for n in COVERAGE)
    + ", cover_lines double"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] = same
    hit[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = hit
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        out[order[1:]] = s[1:] == s[:-1]
    return out


def _covered(word_hash: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its text has twice or more."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(len(word_hash), bool)
    roll = np.zeros(m, np.uint64)
    for i in range(n):
        roll = roll * np.uint64(0x100000001B3) + word_hash[i : i + m]
    inside = owner[:m] == owner[n - 1 :]
    at = np.flatnonzero(inside)
    keys = mix64(roll[at]) ^ mix64(owner[at].astype(np.uint64) + np.uint64(1))
    hit = at[_repeated(keys)]
    edge = np.zeros(len(word_hash) + 1, np.int64)
    edge[hit] += 1
    edge[hit + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def statistics(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> dict[str, np.ndarray]:
    """All figures of the texts between ``offsets``."""
    n = len(offsets) - 1
    start, end, n_words = word_spans(data, offsets)
    owner = per_text(n_words)
    sums = rolling.sums(data)
    # Code points are the bytes that do not continue one.
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[end] - points[start]
    word_chars = totals(chars, owner, n)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[data], out=marks[1:])

    hashes = rolling.ranges(sums, start, end) + mix64((end - start).astype(np.uint64))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]]}
    floor = np.maximum(word_chars, 1)
    for size in COVERAGE:
        hit = _covered(hashes, owner, size)
        if size == 3:
            out["n_repeat_words"] = totals(hit, owner, n)
        out[f"cover_{size}"] = totals(chars * hit, owner, n) / floor

    # Lines: cut at every newline and between texts; those without a word do not count.
    newline = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], newline + 1]))
    stop = np.sort(np.concatenate([newline, offsets[1:]]))
    line_owner = per_text(np.diff(np.searchsorted(newline, offsets)) + 1)
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, line_owner = begin[has_word], stop[has_word], line_owner[has_word]
    keys = rolling.ranges(sums, begin, stop) + mix64((stop - begin).astype(np.uint64))
    later = _later(mix64(keys) ^ mix64(line_owner.astype(np.uint64) + np.uint64(1)))
    line_chars = points[stop] - points[begin]
    out["n_dup_lines"] = totals(later, line_owner, n)
    out["cover_lines"] = totals(line_chars * later, line_owner, n) / np.maximum(totals(line_chars, line_owner, n), 1)
    return out


def verdict(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    good = ~failed & (s["cover_lines"] <= LINE_COVERAGE) & (s["n_symbols"] <= SYMBOLS_PER_WORD * s["n_words"])
    for size, most in COVERAGE.items():
        good &= s[f"cover_{size}"] <= most
    return failed, good


def measure(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per text: its figures and whether it is kept. No shuffle; one text at a time is the memory bound."""
    rolling = Rolling(9)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        s = statistics(*text_bytes(b.column(1)), rolling)
        failed, good = verdict(s)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        covers = [f"cover_{n}" for n in COVERAGE] + ["cover_lines"]
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(s[x]) for x in names), pa.array(failed), pa.array(good), *(pa.array(s[x]) for x in covers)],
            names=["doc_id", *names, "base_failed", "kept", *covers],
        )

    return map_batches(df, [F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")], one, SCHEMA, TEXTS)


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text passes, with all their columns; rows are judged where they lie."""
    rolling = Rolling(9)
    names = df.columns
    at = names.index(text)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                _, good = verdict(statistics(*text_bytes(part.column(at)), rolling))
                yield part.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir))


# Words of one text that lie in an n-gram which the text has more than once.
_COVER = """
  c{n} AS (SELECT doc_id, sum(length(w)) FILTER (WHERE hit) AS covered, count(*) FILTER (WHERE hit) AS words FROM (
    SELECT doc_id, w, bool_or(many) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {last} PRECEDING AND CURRENT ROW) AS hit FROM (
      SELECT doc_id, i, w, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS many FROM (
        SELECT doc_id, i, w, {gram} AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)))) GROUP BY doc_id)"""


def _cover(n: int) -> str:
    return _COVER.format(n=n, last=n - 1, gram=" || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))]))


SQL = (
    r"""WITH words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),"""
    + ",".join(map(_cover, COVERAGE))
    + r""",
  lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS dup FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  l AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup_lines, sum(length(line)) FILTER (WHERE dup) AS dup_chars, sum(length(line)) AS line_chars FROM lines GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY doc_id),
  f AS (SELECT d.doc_id, coalesce(t.n_words, 0)::BIGINT AS n_words, coalesce(t.word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(c3.words, 0)::BIGINT AS n_repeat_words, """
    + ", ".join(f"(coalesce(c{n}.covered, 0) / greatest(coalesce(t.word_chars, 0), 1))::DOUBLE AS cover_{n}" for n in COVERAGE)
    + """, (coalesce(l.dup_chars, 0) / greatest(coalesce(l.line_chars, 0), 1))::DOUBLE AS cover_lines
    FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id) """
    + " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in COVERAGE)
    + """)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND cover_lines <= """
    + f"{LINE_COVERAGE} AND n_symbols <= {SYMBOLS_PER_WORD} * n_words AND "
    + " AND ".join(f"cover_{n} <= {most}" for n, most in COVERAGE.items())
    + " AS kept, "
    + ", ".join(f"cover_{n}" for n in COVERAGE)
    + """, cover_lines
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)"""
)
