"""BPE encoding by backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton finds every vocabulary token inside a piece of text. From each position
the longest one is tried first and accepted only if it is compatible with the token before it: two
neighbours are compatible when merging their joint text again yields exactly those two. If none
fits, the last token is given up for a shorter one; positions found to lead nowhere are marked, so
each is visited once and the work is linear. A chain of compatible neighbours is unique, hence it
is what merging by rank gives.

Decoding gathers token strings from one byte array through a table of offsets.

Defined cases: null and empty texts have no tokens and decode to the empty string; equal texts get
equal tokens; an empty table gives an empty table; texts of any length are encoded whole, piece by
piece; other columns are not read. Letters and digits that joined Unicode after the tokenizers
library's tables were made are the one known difference (some 17,000 code points, all unassigned
in Unicode 15): here they count as letters or digits, there as other signs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches

# The mark that ends a word's last symbol inside this module; a private-use character that no
# byte maps to.
_END = "\ue000"
# Pieces remembered per worker; the memory starts anew when full, results do not depend on it.
CACHE = 500_000


def default_vocabulary() -> str:
    """Place of the public word-level vocabulary, where the machine has one."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Pairs:
    """Which tokens may stand next to each other in a merged text.

    ``rank`` holds for each pair of parts the id that they merge to, ``parts`` for each id its two
    parts. Ids must grow with merge rank. A pair is incompatible if some merge across its border
    would happen before the merges that built the two tokens.
    """

    def __init__(self, rank: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]]):
        self.rank, self.parts = rank, parts
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 4 * CACHE:
                self.known.clear()
            found = self.known[key] = self._border_holds(left, right)
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo merges from the youngest back. At each moment `left` and `right` touch the border;
        # if they merge at all they must do so later than the merge undone last.
        undone = None
        while True:
            merged = self.rank.get((left, right))
            if merged is not None and (undone is None or merged < undone):
                return False
            # The younger of the two was built last; on a tie the left one, as merging runs from the left.
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                undone, left = left, a[1]
            else:
                # A merge of equal rank to the left of the border would have come first.
                undone, right = right + 1, b[0]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if not suffix or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("only vocabularies with a mark at word ends and without unknown tokens are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.letters = _byte_letters()
        inner = {t: (t[: -len(suffix)] + _END if t.endswith(suffix) else t) for t in self.ids}
        of = {inner[t]: i for t, i in self.ids.items()}
        rank, parts = {}, {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            rank[(x, y)] = z
            parts[z] = (x, y)
        ids = list(parts)
        if any(i >= j for i, j in zip(ids, ids[1:])):
            raise ValueError("ids must grow with the rank of merges")
        self.pairs = Pairs(rank, parts)
        self.automaton = ahocorasick.Automaton()
        whole = set(range(max(of.values()) + 1)) - set(parts)
        for i, (a, b) in parts.items():
            # A token whose own text would be merged another way never comes out of merging.
            if a in whole and b in whole and self._stays(i):
                whole.add(i)
        for t, i in of.items():
            if i in whole:
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[int, ...]] = {}

        names = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            names[i] = t
        raw = [t.encode() + b" " for t in names]
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        self.translate = {b: c for b, c in enumerate(self.letters)}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _stays(self, token: int) -> bool:
        """No merge crosses the border between the token's two parts before the token's own."""
        rank, parts = self.pairs.rank, self.pairs.parts
        left, right = parts[token]
        while True:
            x, y = parts.get(left), parts.get(right)
            if x is None and y is None:
                return True
            if y is None or (x is not None and left > right):
                undone, left = left, x[1]
            else:
                undone, right = right + 1, y[0]
            merged = rank.get((left, right))
            if merged is not None and merged < undone:
                return False

    def piece(self, word: str) -> tuple[int, ...]:
        """Ids of one piece, given in byte letters."""
        text = word + _END
        n = len(text)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (size, token) in self.automaton.iter(text):
            starting[last + 1 - size].append((size, token))
        # Matches come by end, so at each start the longest is the last one.
        dead = bytearray(n + 1)
        chain: list[tuple[int, int, int]] = []  # token, its size, which match of its start it is
        at, choice = 0, len(starting[0]) - 1
        while at < n:
            options = starting[at]
            before = chain[-1][0] if chain else None
            while choice >= 0:
                size, token = options[choice]
                if not dead[at + size] and (before is None or self.pairs.compatible(before, token)):
                    break
                choice -= 1
            if choice >= 0:
                chain.append((token, size, choice))
                at += size
                if at < n:
                    choice = len(starting[at]) - 1
            elif chain:
                dead[at] = 1
                _, size, choice = chain.pop()
                at -= size
                choice -= 1
            else:
                raise ValueError(f"no tokens for {word!r}")
        return tuple(t for t, _, _ in chain)

    def encode(self, text: str) -> np.ndarray:
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return np.array(out, "<u4")

    def _plain(self, text: str, out: list[int]) -> None:
        # Lower-casing goes by single characters: the final-sigma rule of str.lower is not applied.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        cache = self.cache
        for w in self.split.findall(text):
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.piece(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.translate))
                if len(w) < 64:
                    cache[w] = ids
            out += ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by spaces, as UTF-8."""
        if not len(ids):
            return b""
        begin, end = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        size = end - begin
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(begin - (stop - size), size)
        return self.table[at[:-1]].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, ids): the tokens of each text as little-endian unsigned 32-bit integers."""
    path = path or default_vocabulary()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        ids = [v.encode(x or "").tobytes() for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_batches(df, [F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")], one, "doc_id long, ids binary", 200)


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids)."""
    path = path or default_vocabulary()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        out = [v.decode(np.frombuffer(x or b"", "<u4")).decode() for x in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_batches(df, ["doc_id", "ids"], one, "doc_id long, text string", 200)


def digest(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per text the number of tokens and the SHA-256 of the ids and of the decoded text; one pass, no shuffle."""
    path = path or default_vocabulary()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        n, ids, decoded = [], [], []
        for x in b.column(1).to_pylist():
            e = v.encode(x or "")
            n.append(len(e))
            ids.append(sha(e.tobytes()))
            decoded.append(sha(v.decode(e)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(df, [F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")], one, schema, 200)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
