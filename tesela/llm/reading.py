"""Reading level of each document, by a latent difficulty model of words and documents.

A Rasch-style model with two parameters for a word (or pair of words): the log-odds that word w occurs in
document d are a(w) + b(w) * (level(d) - 2) + log of the length of d. A word of positive difficulty b is one of
demanding texts. Levels and words are estimated in turn over all documents: given the words, the level of a
document is the one of greatest conditional likelihood (which words occur, given how many) on a grid, which takes
only the number of its words and the sum of their b; given the
levels, the parameters of a word solve its logistic likelihood by Newton steps, which take only the number of
documents it occurs in, the sum of their levels, and how many documents have which level and length. Both
sums are made where the documents lie. A bounded sample of labelled documents starts the iteration, fixes the
scale in each language and pulls weakly on its own documents, so that wrong labels give way.

In the end each sentence or line gets its level by the same likelihood; those of the level that holds most
words are the main text, whose own latent level is the document's.

Words are hashed into SLOTS slots, so the model has the same size for every corpus and no word is left out.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.session import stage_table

SLOTS = 1 << 18
#: At most so many labelled documents anchor the scale (chosen by a hash of their ids where there are more).
LABEL_BOUND = 10_000
LEVELS = (1, 2, 3)
#: Levels on which likelihoods are evaluated, and lengths (in half octaves of distinct words and pairs).
GRID = np.arange(0.5, 3.51, 0.25)
LENGTHS = 32
#: Rounds at most, documents in which a word must occur to say something, strength of the words' priors, of a label and of the middle level.
ROUNDS, LEAST, RIDGE, PULL, PRIOR = 10, 4.0, 4.0, 30.0, 0.05
_TAG = re.compile(r"<[^<>]{1,300}>")


def _plain(c: str) -> str:
    """Small letter without accent, line end for what parts sentences, or a blank."""
    if c in ".!;\n\r":
        return "\n"
    t = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
    return t if len(t) == 1 and t.isascii() and t.isalpha() else " "


_LATIN = bytes(ord(_plain(chr(c))) for c in range(256))
_FEATURES = "doc_id bigint, lang string, label int, n_words int, ids array<int>, seg_words array<int>, seg_ids array<array<int>>"


def segments(text: str) -> list[list[str]]:
    """Words of each sentence or line, in small letters without accents and markup; letters beyond Latin-1 part words."""
    t = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
    t = t.replace("?", ".").encode("latin-1", "replace").translate(_LATIN).decode("ascii")
    return [w for s in t.split("\n") if (w := s.split())]


def _unique(owner: np.ndarray, slot: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each owner in order, and their offsets."""
    both = np.sort(owner.astype(np.int64) * SLOTS + slot)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    return (both % SLOTS).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(both // SLOTS, minlength=owners))]).astype(np.int32)


class Slots(dict):
    """Slots of words, kept as words repeat; of pairs of neighbours by mixing theirs."""

    def __missing__(self, word: str) -> int:
        self[word] = i = zlib.crc32(word.encode()) % SLOTS
        return i

    def lists(self, segs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment and slot of every word and pair of all segments, and the words of each segment."""
        if len(self) > 1_000_000:
            self.clear()
        size = np.array([len(s) for s in segs], dtype=np.int64)
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(segs)), dtype=np.int64, count=int(size.sum()))
        owner = np.repeat(np.arange(len(segs)), size)
        near = owner[1:] == owner[:-1] if len(ids) else np.zeros(0, dtype=bool)
        pairs = ((ids[:-1] * 2654435761 + ids[1:] * 40503 + 12345) >> 7) % SLOTS
        return np.concatenate([owner, owner[:-1][near]]), np.concatenate([ids, pairs[near]]), size


def _features(batches: Iterator) -> Iterator:
    slots = Slots()
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column(1).to_pylist()
        by_doc = [segments(t) for t in texts]
        n_segs = np.array([len(x) for x in by_doc], dtype=np.int64)
        owner, slot, size = slots.lists([s for x in by_doc for s in x])
        seg_flat, seg_off = _unique(owner, slot, int(n_segs.sum()))
        doc_of = np.repeat(np.arange(b.num_rows), n_segs)
        ids, ids_off = _unique(np.repeat(doc_of, np.diff(seg_off)), seg_flat, b.num_rows)
        seg_at = pa.array(np.concatenate([[0], np.cumsum(n_segs)]).astype(np.int32))
        inner = pa.ListArray.from_arrays(pa.array(seg_off), pa.array(seg_flat))
        columns = [b.column(0), b.column(2), b.column(3), pa.array(np.array([len(t.split()) for t in texts], dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ids_off), pa.array(ids)), pa.ListArray.from_arrays(seg_at, pa.array(size.astype(np.int32))), pa.ListArray.from_arrays(seg_at, inner)]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _FEATURES.split(", ")])


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Slots of the segments of every text that isn't null, with the label where there is one."""
    lab = labels.where(F.col("reading_level").isin(*LEVELS)).groupBy("doc_id").agg(F.min("reading_level").alias("label"))
    rows = docs.where("text is not null").select("doc_id", "text", "lang").join(lab, "doc_id", "left").select("doc_id", "text", "lang", F.col("label").cast("int").alias("label"))
    return stage_table(rows.mapInArrow(_features, _FEATURES), "reading")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def length_of(n: np.ndarray) -> np.ndarray:
    """Class of length of lists of n slots."""
    return np.minimum(np.rint(2 * np.log2(np.maximum(n, 1))).astype(np.int64), LENGTHS - 1)


class Model:
    """Base odds and difficulty of each slot, the scale of each language and the slots of languages."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.base, self.difficulty = np.full(SLOTS, -20.0, dtype=np.float32), np.zeros(SLOTS, dtype=np.float32)
        self.norm = np.zeros(len(GRID))
        self.by_language = np.zeros((max(1, len(languages)), SLOTS), dtype=np.float32)
        self.scales: list[tuple[np.ndarray, np.ndarray]] = [(np.array([1.0, 3.0]), np.array([1.0, 3.0]))] * max(1, len(languages))

    @staticmethod
    def offsets(length: np.ndarray) -> np.ndarray:
        return (length / 2 * np.log(2.0)).astype(np.float32)

    def update(self, n: np.ndarray, s: np.ndarray, docs: np.ndarray, steps: int = 2, block: int = 20_000) -> float:
        """Newton steps of the words' logistic likelihoods; the largest change of a difficulty that counts.

        n: documents of each slot; s: sum of their levels less 2; docs: number of documents by level and length.
        """
        at_level, at_length = np.nonzero(docs)
        weight = docs[at_level, at_length].astype(np.float32)
        g, o = (GRID[at_level] - 2).astype(np.float32), self.offsets(at_length)
        known = np.flatnonzero(n >= LEAST)
        first = self.base[known] < -15
        share = np.log((n[known] + 0.5) / max(1.0, float((weight * np.exp(o)).sum())))
        self.base[known[first]] = share[first]
        before = self.difficulty[known].copy()
        for lo in range(0, len(known), block):
            w = known[lo : lo + block]
            a, b, nw, sw = self.base[w].copy(), self.difficulty[w].copy(), n[w].astype(np.float32), s[w].astype(np.float32)
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(a[:, None] + b[:, None] * g + o, -30, 30)))
                v = p * (1 - p) * weight
                p *= weight
                f1, f2 = nw - p.sum(axis=1), sw - p @ g - RIDGE * b
                h11, h12, h22 = v.sum(axis=1) + 0.1, v @ g, v @ (g * g) + RIDGE
                det = np.maximum(h11 * h22 - h12 * h12, 1e-6)
                a += np.clip((h22 * f1 - h12 * f2) / det, -1, 1)
                b += np.clip((h11 * f2 - h12 * f1) / det, -1, 1)
            self.base[w], self.difficulty[w] = a, b
        # what a word more costs at each level: the share of each word among all, given that one occurs
        a, b = self.base[known].astype(np.float64), self.difficulty[known].astype(np.float64)
        self.norm = np.array([np.logaddexp.reduce(a + b * g) if len(known) else 0.0 for g in GRID - 2])
        return float(np.abs(self.difficulty[known] - before).max(initial=0.0))

    def raw(self, ids: np.ndarray, offsets: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Latent level of each list of slots, between the points of the grid, and how much its words say about it."""
        num = np.concatenate([[0.0], np.cumsum(self.difficulty[ids], dtype=np.float64)])
        den = np.concatenate([[0.0], np.cumsum(np.abs(self.difficulty[ids]), dtype=np.float64)])
        total, said = num[offsets[1:]] - num[offsets[:-1]], den[offsets[1:]] - den[offsets[:-1]]
        seen = np.concatenate([[0], np.cumsum(self.base[ids] > -15)])
        like = total[:, None] * (GRID - 2) - (seen[offsets[1:]] - seen[offsets[:-1]])[:, None] * self.norm - PRIOR * (GRID - 2) ** 2
        if label is not None:
            like = like - np.where(np.isnan(label), 0.0, PULL)[:, None] * (GRID - np.nan_to_num(label, nan=2.0)[:, None]) ** 2
        top = np.clip(like.argmax(axis=1), 1, len(GRID) - 2)
        at = np.arange(len(top))
        l0, l1, l2 = like[at, top - 1], like[at, top], like[at, top + 1]
        bend = np.minimum(l0 - 2 * l1 + l2, -1e-9)
        return np.clip(GRID[top] + 0.25 * np.clip((l0 - l2) / (2 * bend), -1, 1), GRID[0], GRID[-1]), said

    def language(self, names: list, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of the language as given, else the one whose slots fit best."""
        at = {k: i for i, k in enumerate(self.languages)}
        out = np.array([at.get(x, -1) for x in names], dtype=np.int64)
        for i in np.flatnonzero(out < 0):
            own = ids[offsets[i] : offsets[i + 1]]
            out[i] = int(self.by_language[:, own].sum(axis=1).argmax()) if len(own) else 0
        return out

    def scaled(self, raw: np.ndarray, language: np.ndarray) -> np.ndarray:
        out = raw.copy()
        for k, (x, y) in enumerate(self.scales):
            at = language == k
            out[at] = np.interp(raw[at], x, y)
        return out

    def rescale(self, raw: np.ndarray, label: np.ndarray, language: np.ndarray) -> None:
        """The scale maps the median raw level of each label to it, and the cut that parts two labels best to their middle.

        A language that lacks a level takes the common scale.
        """

        def between(low: np.ndarray, high: np.ndarray) -> float:
            """The middle of the cuts with (nearly) fewest labels on the wrong side."""
            x = np.unique(np.concatenate([low, high]))
            cuts = np.concatenate([[x[0] - 0.01], (x[1:] + x[:-1]) / 2, [x[-1] + 0.01]])
            wrong = (low.size - np.searchsorted(np.sort(low), cuts)) / low.size + np.searchsorted(np.sort(high), cuts) / high.size
            best = np.flatnonzero(wrong <= wrong.min() + 0.02)
            return float((cuts[best[0]] + cuts[best[-1]]) / 2)

        def points(at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            by = [(k, raw[at & (label == k)]) for k in LEVELS if (at & (label == k)).any()]
            if len(by) < 2:
                return None
            found = [(float(np.median(by[0][1])), float(by[0][0]))]
            for (k0, r0), (k1, r1) in zip(by, by[1:], strict=False):
                found += [(between(r0, r1), (k0 + k1) / 2), (float(np.median(r1)), float(k1))]
            return np.maximum.accumulate([p[0] for p in found]) + np.arange(len(found)) * 1e-6, np.array([p[1] for p in found])

        common = points(np.ones(len(raw), dtype=bool)) or (np.array([1.0, 3.0]), np.array([1.0, 3.0]))
        for k in range(len(self.scales)):
            at = language == k
            full = all((at & (label == v)).sum() >= 3 for v in LEVELS)
            self.scales[k] = (points(at) if full else None) or common


def _sums(model):
    """Sums per slot over the documents of a partition, and (slot -1 - cell) how many have which level and length."""

    def run(batches):
        m = model.value
        n, s, docs = np.zeros(SLOTS), np.zeros(SLOTS), np.zeros((len(GRID), LENGTHS))
        for b in batches:
            if not b.num_rows:
                continue
            ids, offsets = _lists(b.column(2))
            label = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            level, _ = m.raw(ids, offsets, label)
            level = m.scaled(level, m.language(b.column(0).to_pylist(), ids, offsets))
            cell = np.rint((np.clip(level, GRID[0], GRID[-1]) - GRID[0]) / 0.25).astype(np.int64)
            per = np.diff(offsets)
            np.add.at(docs, (cell, length_of(per)), 1.0)
            n += np.bincount(ids, minlength=SLOTS)
            s += np.bincount(ids, np.repeat(GRID[cell] - 2, per), SLOTS)
        at, cells = np.flatnonzero(n), np.flatnonzero(docs.ravel())
        if len(at) or len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - cells]).astype(np.int32)), pa.array(np.concatenate([n[at], docs.ravel()[cells]])), pa.array(np.concatenate([s[at], np.zeros(len(cells))]))], names=["slot", "n", "s"])

    return run


def fit(feats: DataFrame, rounds: int = ROUNDS, label_bound: int = LABEL_BOUND, tolerance: float = 0.05) -> Model:
    """The words' parameters from all documents; only sums per slot and the bounded labelled sample reach the driver."""
    spark = feats.sparkSession
    # languages of a corpus are few; each is a row of SLOTS numbers in the model
    langs = [r["lang"] for r in feats.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    m = Model(langs)
    rows = feats.where(F.col("lang").isin(*langs)).select("lang", F.explode("ids").alias("slot")).groupBy("lang", "slot").count().toPandas() if langs else None  # at most SLOTS rows a language
    if rows is not None and len(rows):
        at = {k: i for i, k in enumerate(langs)}
        m.by_language[rows["lang"].map(at).to_numpy(), rows["slot"].to_numpy()] = rows["count"].to_numpy()
        m.by_language = np.log((m.by_language + 0.1) / (m.by_language.sum(axis=1, keepdims=True) + 0.1 * SLOTS))
    known = feats.where("label is not null and size(ids) > 0").select("doc_id", "label", "lang", "ids").orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_bound).toPandas()
    if not len(known):
        return m
    ids = np.concatenate(known["ids"].to_numpy())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in known["ids"]])])
    label, language = known["label"].to_numpy().astype(float), m.language(known["lang"].tolist(), ids, offsets)
    per = np.diff(offsets)
    docs = np.zeros((len(GRID), LENGTHS))
    np.add.at(docs, (np.rint((label - GRID[0]) / 0.25).astype(np.int64), length_of(per)), 1.0)
    m.update(np.bincount(ids, minlength=SLOTS).astype(float), np.bincount(ids, np.repeat(label - 2, per), SLOTS), docs, steps=6)
    m.rescale(m.raw(ids, offsets)[0], label, language)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(m)  # SLOTS numbers a part, at every size of the corpus
        sums = feats.select("lang", F.col("label").cast("double"), "ids").mapInArrow(_sums(sent), "slot int, n double, s double")
        got = sums.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
        n, s, docs = np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(len(GRID) * LENGTHS)
        words, cells = got[got["slot"] >= 0], got[got["slot"] < 0]
        n[words["slot"]], s[words["slot"]], docs[-1 - cells["slot"].to_numpy()] = words["n"], words["s"], cells["n"]
        moved = m.update(n, s, docs.reshape(len(GRID), LENGTHS))
        m.rescale(m.raw(ids, offsets)[0], label, language)
        sent.unpersist()
        if moved < tolerance:
            break
    return m


def levels(feats: DataFrame, model: Model, least_words: int = 0) -> DataFrame:
    """doc_id, reading_level, score of every document with at least ``least_words`` words.

    Segments of the level that holds most words (ties go to the level nearer that of the whole text) are the main
    text; score is its latent level, scaled, and reading_level the nearest of LEVELS. Texts without a known word get 2.
    """
    sent = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, offsets = _lists(b.column(2))
            language = m.language(b.column(1).to_pylist(), ids, offsets)
            raw, said = m.raw(ids, offsets)
            score = np.where(said > 0, m.scaled(raw, language), 2.0)
            seg = b.column(4)
            first = seg.offsets[0].as_py()
            seg_at = seg.offsets.to_numpy() - first
            inner = seg.values.slice(first, int(seg_at[-1]))
            words = _lists(b.column(3))[0].astype(float)
            if len(inner):
                s_ids, s_off = _lists(inner)
                owner = np.repeat(np.arange(b.num_rows), np.diff(seg_at))
                s_raw, s_said = m.raw(s_ids, s_off)
                level = np.clip(np.rint(m.scaled(s_raw, language[owner])), 1, 3).astype(int)
                votes = np.zeros((b.num_rows, 3))
                np.add.at(votes, (owner, level - 1), np.where(s_said > 0, words, 0.0))
                best = (votes - 1e-3 * np.abs(np.array([[1.0, 2.0, 3.0]]) - score[:, None])).argmax(axis=1) + 1
                main = (level == best[owner]) & (s_said > 0)
                rows = np.repeat(main, np.diff(s_off))
                m_ids, m_off = _unique(np.repeat(owner, np.diff(s_off))[rows], s_ids[rows], b.num_rows)
                m_raw, m_said = m.raw(m_ids, m_off)
                # the main text keeps to the level of its segments, which its latent level refines
                score = np.where(m_said > 0, np.clip(m.scaled(m_raw, language), best - 0.49, best + 0.49), score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(np.rint(score), 1, 3).astype(np.int32)), pa.array(score)], names=["doc_id", "reading_level", "score"])

    return feats.where(F.col("n_words") >= least_words).select("doc_id", "lang", "ids", "seg_words", "seg_ids").mapInArrow(run, "doc_id bigint, reading_level int, score double")
