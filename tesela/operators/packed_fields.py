"""Several values packed in one text field, one row per value with its position.

A dialect is a set of separators and a kind of quote. Under each dialect the cheapest reading of a text
is found (every separator outside quotes either separates or belongs to a value), where a known value
costs its code length, minus log2 of its share of all values, and any other text costs its characters.
The dialect of least total length wins. Code lengths come from a first, distributed pass that reads every
distinct text with equal lengths and counts the values; the second pass reads each row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest codebook that is sent to the executors; values beyond it are coded by their characters.
CODEBOOK_BOUND = 100_000
_MISSING = {"", "-", "n/d", "no disponible"}


@dataclass(frozen=True)
class Spec:
    """What may stand in a packed field."""

    separators: tuple[str, ...] = (";", "|", "#", "\n", "\t", ",", "/", " - ", " y ")
    quotes: tuple[tuple[str, str], ...] = (('"', '"'), ("'", "'"), ("«", "»"))
    brackets: tuple[tuple[str, str], ...] = (("[", "]"),)
    pattern: str | None = None  # what surrounds a value; group 1 is the value
    width: int | None = None  # values of one width may follow each other without separators
    most_separators: int = 64  # that one value may hold itself
    char_bits: float = 8.0
    split_bits: float = 2.0
    dialect_bits: float = 5.0


SUBJECTS = Spec()
CODES = Spec(separators=(";", "|", "#", "\n", "\t", ",", "/", " - ", " y ", " "), pattern=r"(?:CPV[\s:]*)?(\d{8})(?:-\d)?(?:\s*\([^)]*\))?", width=8)


def value_key(text: str) -> str:
    return " ".join(text.split()).casefold()


@dataclass
class Reader:
    """Reads texts of one field; keeps what it has read, as texts repeat."""

    spec: Spec
    bits: dict[str, float]
    default_bits: float | None = None  # of a value that fits the pattern but is not in the codebook
    seen: dict[str, list[str]] = field(default_factory=dict)
    pieces: dict[str, tuple[str, float, bool]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        s = self.spec
        self.pattern = re.compile(s.pattern, re.I) if s.pattern else None
        self.finders = {x: re.compile(rf"(?:^|\s+){re.escape(x.strip())}(?:\s+|$)" if x.startswith(" ") and x.strip() else r"[  ]+" if x == " " else rf"\s*(?:{re.escape(x)}\s*)+" if not x.isspace() else rf"[  ]*(?:{re.escape(x)}[  ]*)+") for x in s.separators}
        self.doubled = [q for q, c in s.quotes if q == c]

    def clean(self, piece: str) -> str:
        p = piece.strip()
        for a, b in self.spec.brackets:
            if len(p) >= 2 and p.startswith(a) and p.endswith(b):
                p = p[1:-1].strip()
        for a, b in self.spec.quotes:
            if len(p) >= 2 and p.startswith(a) and p.endswith(b) and self._closes(p, a, b):
                p = p[1:-1].strip()
                break
        for q in self.doubled:
            p = p.replace(q + q, q)
        if self.pattern and (m := self.pattern.fullmatch(p)):
            return m[1]
        return p

    @staticmethod
    def _closes(p: str, a: str, b: str) -> bool:
        """The first quote is closed by the last one, not before."""
        inner = p[1:-1]
        return b not in inner if a != b else a not in inner.replace(a + a, "")

    def cost(self, value: str) -> tuple[float, bool]:
        if not value:
            return 0.0, True
        b = self.bits.get(value_key(value))
        if b is not None:
            return b, True
        if self.default_bits is not None and self.pattern and self.pattern.fullmatch(value):
            return self.default_bits, True
        return 16 + self.spec.char_bits * len(value), False

    def piece(self, text: str) -> tuple[str, float, bool]:
        """The value in a piece, its bits and whether it is known; kept, as the dialects share most pieces."""
        got = self.pieces.get(text)
        if got is None:
            v = self.clean(text)
            if len(self.pieces) > 200_000:
                self.pieces.clear()
            got = self.pieces[text] = (v, *self.cost(v))
        return got

    def opaque(self, text: str, a: str, b: str) -> list[tuple[int, int]]:
        spans, i = [], 0
        while (i := text.find(a, i)) >= 0:
            j = i + 1
            while (j := text.find(b, j)) >= 0 and a == b and text.startswith(b + b, j):
                j += 2
            if j < 0:
                break
            spans.append((i, j + 1))
            i = j + 1
        return spans

    def read_as(self, text: str, separators: tuple[str, ...], quote: tuple[str, str] | None) -> tuple[float, bool, list[str]]:
        """Cheapest reading under one dialect: bits, whether all values are known, the values."""
        s = self.spec
        spans = self.opaque(text, *quote) if quote else []
        cuts = sorted({m.span() for x in separators for m in self.finders[x].finditer(text) if not any(p < m.end() and m.start() < q for p, q in spans)})
        kept, last = [], 0
        for a, b in cuts:  # separators side by side are one
            if kept and a < kept[-1][1]:
                kept[-1] = (kept[-1][0], max(b, kept[-1][1]))
            else:
                kept.append((a, b))
        starts, ends = [0, *(b for _, b in kept)], [*(a for a, _ in kept), len(text)]
        n = len(starts)
        best: list[tuple[float, bool, int, str]] = [(0.0, True, 0, "")]
        for j in range(1, n + 1):
            top = None
            for i in range(max(0, j - 1 - s.most_separators), j):
                v, c, known = self.piece(text[starts[i] : ends[j - 1]])
                c += best[i][0] + (s.split_bits if i else 0)
                if top is None or c < top[0]:
                    top = (c, known and best[i][1], i, v)
            best.append(top)
        values, j = [], n
        while j:
            if best[j][3]:
                values.append(best[j][3])
            j = best[j][2]
        bits = best[n][0] + s.dialect_bits * (len(separators) + (quote is not None))
        return bits, best[n][1], values[::-1]

    def read(self, text: str | None) -> list[str]:
        if text is None or value_key(text) in _MISSING:
            return []
        got = self.seen.get(text)
        if got is None:
            got = self._read(text)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[text] = got
        return got

    def _read(self, text: str) -> list[str]:
        s = self.spec
        t = text.strip()
        for a, b in s.brackets:
            if t.startswith(a) and t.endswith(b):
                t = t[1:-1].strip()
        if s.width and t.isdigit() and len(t) % s.width == 0:  # the dialect without separators: one parse, which no other can undercut
            return [t[i : i + s.width] for i in range(0, len(t), s.width)]
        present = [x for x in s.separators if (x if x.isspace() else x.strip()) in t and self.finders[x].search(t)]
        quotes = [None, *(q for q in s.quotes if q[0] in t and q[1] in t)]
        best: tuple[float, bool, list[str]] | None = None
        for size in range(len(present) + 1):
            for chosen in combinations(present, size):
                for q in quotes:
                    got = self.read_as(t, chosen, q)
                    if best is None or got[0] < best[0]:
                        best = got
            if best[1]:
                break
        return best[2]


@lru_cache(maxsize=8)
def _reader(spec: Spec, book: tuple[tuple[str, float], ...], default_bits: float | None) -> Reader:
    return Reader(spec, dict(book), default_bits)


def _items(column: str, spec: Spec, book: tuple[tuple[str, float], ...], default_bits: float | None) -> Callable:
    def read(s: pd.Series) -> pd.Series:
        r = _reader(spec, book, default_bits)
        return s.map(r.read, na_action=None) if len(s) else pd.Series([], dtype=object)

    return F.pandas_udf(lambda s: read(s), "array<string>")(F.col(column).cast("string"))


def codebook(texts: DataFrame, column: str, spec: Spec, vocabulary: DataFrame | None, bound: int = CODEBOOK_BOUND) -> tuple[tuple[tuple[str, float], ...], float]:
    """Code lengths of the known values of a field, and that of a value never met.

    vocabulary: one column of known values, or None: then the texts without any separator are the known
    values. At most ``bound`` values, those met most often first, are kept; the driver never holds more.
    """
    distinct = texts.select(F.col(column).cast("string").alias("text")).where("text is not null and trim(text) <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    # a fixed number of parts, as few bytes of text are much work
    distinct = distinct.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism)
    if vocabulary is None:
        plain = _items("text", spec, (), 0.0)
        known = distinct.withColumn("items", plain).where(F.size("items") == 1).select(F.explode("items").alias("value"), "n").groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
        words = [r["value"] for r in known.orderBy(F.desc("n"), "value").limit(bound).collect()]
    else:
        c = vocabulary.columns[0]
        met = distinct.groupBy(F.col("text").alias(c)).agg(F.sum("n").alias("n"))
        known = vocabulary.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias(c)).distinct().join(met, c, "left")
        words = [r[c] for r in known.orderBy(F.desc_nulls_last("n"), c).limit(bound).collect()]
    keys = sorted({value_key(str(w)) for w in words})
    even = math.log2(max(2, len(keys)))
    first = tuple((k, even) for k in keys)
    counts = distinct.select(F.explode(_items("text", spec, first, even)).alias("value"), "n").withColumn("value", F.lower(F.trim(F.regexp_replace("value", r"\s+", " "))))
    counts = counts.groupBy("value").agg(F.sum("n").alias("n"))
    book = {k: 0 for k in keys}
    spark = texts.sparkSession
    known = spark.createDataFrame([(k,) for k in keys], "value string") if keys else None
    total = 0
    if known is not None:
        for r in counts.join(F.broadcast(known), "value", "left_semi").collect():  # at most as many rows as the codebook
            book[r["value"]] = r["n"]
            total += r["n"]
    total += len(book) + 1
    return tuple((k, -math.log2((n + 1) / total)) for k, n in sorted(book.items())), math.log2(total)


def unpack(df: DataFrame, column: str, spec: Spec, vocabulary: DataFrame | None = None, keep: tuple[str, ...] = (), least: int = 1, out: tuple[str, str] = ("item_pos", "item")) -> DataFrame:
    """keep columns, position from 1 and item: one row per item of every row that holds ``least`` or more.

    Null, blank and stand-in texts hold no item; empty pieces are not counted; repeated items stay, also in
    repeated rows; an empty table gives an empty one. Columns not named in ``keep`` never clash, as they are
    left out. No shuffle of rows: only distinct texts are counted, then each row is read where it lies.
    """
    book, none = codebook(df, column, spec, vocabulary)
    items = df.select(*keep, _items(column, spec, book, none).alias("__items"))
    return items.where(F.size("__items") >= least).select(*keep, F.posexplode("__items").alias("__p", out[1])).select(*keep, (F.col("__p") + 1).cast("int").alias(out[0]), out[1])
