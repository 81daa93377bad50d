"""Aligning the tokens of two tokenizers by interval coalescing.

The tokens of both sides are byte ranges of the same text. All of them, of a whole batch of texts,
are sorted together by start (lexsort); a running maximum (maximum.accumulate) holds how far any
token so far reaches, and a group breaks where a start reaches that maximum: no token of either
side spans such a place. Within a group every pair of overlapping tokens is expanded from the
joint cuts of both sides. Pairs that end together are links.

Counts of linked pairs go over the whole corpus. Each batch of texts counts its own pairs first, so
a pair has one row per batch, however frequent it is; sums and the best partner of each B id are
ordinary aggregates, and the answers go back to the batches that asked. Texts are tokenized once:
a batch is stored as one packed row that keeps its links as numbers into its own list of pairs.

Defined cases: null and empty texts, and texts whose tokens do not spell their bytes, have no tokens:
figures are zero and the digest is empty; repeated rows each count; ties for the best partner are
all best; very long texts are tokenized whole, as batches of their own; an empty table gives an
empty table; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .bpe import _byte_letters
from .common import by_bytes, documents, text_bytes

# Most texts, and about the most bytes of text, that are counted together, and bytes tokenized together.
ROWS, BYTES, PART = 4000, 1 << 20, 1 << 18
# Parts of texts remembered per worker; the memory starts anew when full, results do not depend on it.
CACHE = 200_000
# Fixed value: how byte-level vocabularies cut texts before they merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = re.compile("[ -~\n\tÀ-ɏ]*+").fullmatch
# A pair of ids as one number: the A id times this, plus the B id. Larger than any vocabulary.
WIDTH = 1 << 24


def default_tokenizers() -> tuple[str, str]:
    """Places of the byte-level and the piece vocabulary, where the machine has them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """One tokenizer's ids for texts, and the bytes of each id."""

    def __init__(self, spell: list[bytes]):
        self.sizes = np.array([len(x) for x in spell], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.table = np.frombuffer(b"".join(spell), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all tokens, joined."""
        size = self.sizes[ids]
        stop = np.cumsum(size)
        return self.table[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.at[ids] - (stop - size), size)]


class ByteLevel(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        of = {c: b for b, c in enumerate(_byte_letters())}
        spell = [b""] * (max(self.model.get_vocab(True).values()) + 1)
        for t, i in self.model.get_vocab(True).items():
            spell[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        super().__init__(spell)

        spec = json.loads(self.model.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.ranked = None
        if self.splits and all(x < y for x, y in zip(merged, merged[1:])):
            # Ids grow with merge rank, so ranks alone say the same; a faster encoder for plain parts.
            import tiktoken

            ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if all(c in of for c in t) and t not in {x["content"] for x in spec["added_tokens"]}}
            self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, parts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.model.encode_batch_fast(parts, add_special_tokens=False)]
        # Kinds of letters that tables of different age may hold different views of go the library's way.
        plain = [PLAIN(p) is not None for p in parts]
        rest = iter(self.model.encode_batch_fast([p for p, x in zip(parts, plain) if not x], add_special_tokens=False))
        return [self.ranked(p) if x else next(rest).ids for p, x in zip(parts, plain)]


class Pieces(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spell = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            spell.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())
        super().__init__(spell)

        # No piece goes on over a space.
        self.splits = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size()))

    def ids(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in parts], num_threads=1)  # it adds the space itself


class Both:
    """Ids of texts from both sides, with a memory for parts of texts.

    Before a space between other signs and a plain letter or sign neither side has a token that goes
    on: there texts are cut, and each part is tokenized once as long as it is remembered. Sides
    for which this does not hold get whole texts.
    """

    def __init__(self, a: str, b: str):
        self.sides = ByteLevel(a), Pieces(b)
        self.split = re.compile("(?<=\\S)(?= [!-~À-ɏ])" if all(s.splits for s in self.sides) else "(?!)")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        # Ids of all known parts, one after the other, and where each part's begin.
        self.ids_of = [np.zeros(0, np.int32) for _ in self.sides]
        self.begin = [np.zeros(1, np.int64) for _ in self.sides]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of all texts, joined, and the number of ids of each; none for an empty text."""
        if len(self.known) > CACHE:
            self._forget()
        known = self.known
        rows = [self.split.split(" " + t) if t else [] for t in texts]
        new = list({p for r in rows for p in r}.difference(known))
        known.update(zip(new, range(len(known), len(known) + len(new))))
        for k, side in enumerate(self.sides):
            got = side.ids(new)
            self.ids_of[k] = np.concatenate([self.ids_of[k], np.fromiter(chain.from_iterable(got), np.int32)])
            self.begin[k] = np.concatenate([self.begin[k], self.begin[k][-1] + np.cumsum([len(x) for x in got], dtype=np.int64)])
        parts = np.fromiter((known[p] for r in rows for p in r), np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        out = []
        for ids, begin in zip(self.ids_of, self.begin):
            size = begin[parts + 1] - begin[parts]
            stop = np.cumsum(size)
            joined = ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[parts] - (stop - size), size)]
            out.append((joined.astype(np.int64), np.bincount(of, weights=size, minlength=len(rows)).astype(np.int64)))
        if any(len(p) > 1000 for p in new):
            self._forget()  # a very long part would be remembered for nothing
        return out


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Both:
    """One pair per worker process."""
    return Both(a, b)


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the group of each interval, from 0; groups are what no common cut divides."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens of two gapless rows of tokens over the same bytes, given their ends.

    Between two neighbouring cuts of either side lies exactly one token of each.
    """
    cuts = np.sort(np.concatenate([a_end, b_end]), kind="stable")  # two rising rows: a merge
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], len(cuts) > 0)] if len(cuts) else cuts
    return np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)


class Aligned:
    """The tokens, groups and links of a batch of texts.

    ``a_ids``, ``b_ids``: tokens of all texts that both sides spell, joined; ``a_group``, ``b_group``
    their groups; ``link_a``, ``link_b``: linked tokens, as places in those; per text ``n_a``,
    ``n_b``, ``n_groups`` and ``n_links``.
    """

    def __init__(self, texts: list[str | None], both: Both):
        a, b = both.sides
        some = [t or "" for t in texts]
        raw, off = text_bytes(pa.array([" " + t if t else "" for t in some], pa.string()))
        size = np.diff(off)
        sides = []
        for ids, count in both.ids(some):
            sides.append((ids, np.repeat(np.arange(len(some)), count)))
        good = size > 0
        for side, (ids, owner) in zip((a, b), sides):
            spelled = np.bincount(owner, weights=side.sizes[ids], minlength=len(some)).astype(np.int64) if len(ids) else np.zeros(len(some), np.int64)
            good &= spelled == size
        for side, (ids, owner) in zip((a, b), sides):
            mine = ids[good[owner]] if len(ids) else ids
            want = raw[np.repeat(good, size)]
            same = np.concatenate([[0], np.cumsum(side.spelled(mine) != want)])
            at = np.concatenate([[0], np.cumsum(np.where(good, size, 0))])
            good &= same[at[1:]] == same[at[:-1]]
        # Bytes of the texts that count, one after the other: a cut at every text's end is common to both.
        tokens = []
        for side, (ids, owner) in zip((a, b), sides):
            keep = good[owner] if len(ids) else np.zeros(0, bool)
            tokens.append((ids[keep], owner[keep], np.cumsum(side.sizes[ids[keep]])))
        (self.a_ids, a_owner, a_end), (self.b_ids, b_owner, b_end) = tokens
        n = len(some)
        self.n_a, self.n_b = np.bincount(a_owner, minlength=n), np.bincount(b_owner, minlength=n)
        start = np.concatenate([a_end - a.sizes[self.a_ids], b_end - b.sizes[self.b_ids]])
        group = coalesce(start, np.concatenate([a_end, b_end]))
        self.a_group, self.b_group = group[: len(a_end)], group[len(a_end) :]
        first = np.ones(len(a_end), bool)
        first[1:] = self.a_group[1:] != self.a_group[:-1]
        self.n_groups = np.bincount(a_owner[first], minlength=n)
        i, j = overlaps(a_end, b_end)
        together = a_end[i] == b_end[j]
        self.link_a, self.link_b = i[together], j[together]
        self.n_links = np.bincount(a_owner[self.link_a], minlength=n)

    def spelled_groups(self) -> list[bytes]:
        """Per text its groups in decimal ids: ``a1,a2|b1;a3|b2,b3``."""
        ids = np.concatenate([self.a_ids, self.b_ids])
        group = np.concatenate([self.a_group, self.b_group])
        side = np.repeat([0, 1], [len(self.a_ids), len(self.b_ids)])
        order = np.lexsort((side, group))  # stable, so tokens of a side keep their order
        ids, group, side = ids[order], group[order], side[order]
        last = np.ones(len(ids), bool)
        last[:-1] = group[1:] != group[:-1]
        turn = np.zeros(len(ids), bool)
        turn[:-1] = side[1:] > side[:-1]
        digits, at = _decimals(int(ids.max(initial=0)))
        size = at[ids + 1] - at[ids] + 1
        stop = np.cumsum(size)
        out = np.empty(stop[-1] if len(stop) else 0, np.uint8)
        text = np.ones(len(out), bool)
        text[stop - 1] = False
        places = np.arange(len(out)) + np.repeat(at[ids] - (stop - size), size)
        out[text] = digits[places[text]]
        out[stop - 1] = np.where(last, ord(";"), np.where(turn, ord("|"), ord(",")))
        tokens = self.n_a + self.n_b
        ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(tokens)])]
        raw = out.tobytes()
        return [raw[s : e - 1] if e > s else b"" for s, e in zip(ends[:-1], ends[1:])]


@lru_cache(maxsize=4)
def _decimals_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    spelled = [str(i).encode() for i in range(n + 1)]
    return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n at least, joined, and where each begins."""
    return _decimals_to((1 << max(n, 1).bit_length()) - 1)


PACKED = "batch long, pairs array<long>, uses array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, links binary"
FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _width(pairs: int) -> str:
    """Type that holds places in a list of pairs."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def pack(df: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per batch of texts: figures of its texts, its distinct pairs with their uses, and links as places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a, b)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for x in by_bytes(batches, 1, ROWS, BYTES):
            codes, told = [], []
            # Tokens are held for a part of the batch only, links as one number each.
            for y in by_bytes([x], 1, ROWS, PART):
                al = Aligned(y.column(1).to_pylist(), both)
                codes.append(al.a_ids[al.link_a] * WIDTH + al.b_ids[al.link_b])
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in al.spelled_groups()]
                told.append((al.n_a, al.n_b, al.n_groups, al.n_links, sha))
            pairs, place, uses = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            row = [number, pairs, uses, x.column(0).to_pylist(), *[np.concatenate(c) for c in list(zip(*told))[:4]], [h for t in told for h in t[4]], place.astype(_width(len(pairs))).tobytes()]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PACKED_ARROW)], schema=PACKED_ARROW)

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PACKED)


_LONGS = pa.list_(pa.int64())
PACKED_ARROW = pa.schema(
    [("batch", pa.int64()), ("pairs", _LONGS), ("uses", _LONGS), ("doc_id", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS),
     ("groups_sha256", pa.list_(pa.string())), ("links", pa.binary())]
)


def pair_counts(packed: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold a pair anywhere, and whether no pair of its B id has more."""
    uses = packed.select(F.explode(F.arrays_zip("pairs", "uses")).alias("u")).groupBy(F.col("u.pairs").alias("pair")).agg(F.sum("u.uses").alias("n"))
    # A B id has at most as many partners as the A vocabulary has ids.
    most = F.max("n").over(Window.partitionBy(F.col("pair") % WIDTH))
    return uses.select("pair", "n", (F.col("n") == most).alias("best"))


def align(df: DataFrame, a: str | None = None, b: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per text the numbers of tokens, groups and links, of links with the best partner, the sum of link counts, and the digest of its groups."""
    if a is None or b is None:
        a, b = default_tokenizers()
    packed = cut(pack(df, a, b, text, key), "aligned")
    counts = cut(pair_counts(packed), "pair-counts")
    asked = packed.select("batch", F.explode("pairs").alias("pair"))
    answers = asked.join(counts, "pair").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("answer"))
    answers = answers.select("batch", F.transform("answer", lambda x: x["n"]).alias("n"), F.transform("answer", lambda x: x["best"]).alias("best"))
    whole = packed.drop("pairs", "uses").join(answers, "batch", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in (x.slice(i, 1).to_pylist()[0] for i in range(x.num_rows)):
                place = np.frombuffer(r["links"], _width(len(r["n"] or [])))
                at = np.concatenate([[0], np.cumsum(r["n_links"])])
                sums = []
                for v in (r["best"], r["n"]):
                    run_ = np.concatenate([[0], np.cumsum(np.array(v or [], np.int64)[place])])
                    sums.append(run_[at[1:]] - run_[at[:-1]])
                cols = [r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *sums]
                arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(r["groups_sha256"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in FIGURES.split(", ")])

    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "n", "best").mapInArrow(run, FIGURES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
