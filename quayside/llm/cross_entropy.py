"""LM scoring (operator 2): the cross-entropy difference of a target and a background model.

Both are bigram word models over one vocabulary: every word of all documents, and one class for the start
of text.  The background counts every document, the target those labelled as good.  Words and bigrams are
counted exactly, by 64-bit keys, and the models grow with the corpus.  The models are matched: counts of
the background are scaled to the target's number of words, so that smoothing weighs alike in both, and a
document is scored by what the others say, its own counts taken out of the models that hold it:

    p(w) = (s c(w) + FLOOR) / (s n + FLOOR N),   p(w | v) = (s c(v, w) + PRIOR p(w)) / (s c(v) + PRIOR)

with s = 1 in the target, its words by those of all documents in the background, and N the words of all
documents, more than the vocabulary can have.  A document's score is the mean over its words of target
loss less background loss, in nats: the lower, the nearer to the target.

No model is held as a whole.  Texts are coded in slices of about ``CHARS`` characters, one row each.  A
slice counts its own words and bigrams and deals the sorted keys out in ranges, as many as there are
slices, so a range holds about as much as a slice does.  Each range adds up its keys over all slices and
sends every slice the whole counts of its keys, in the order of the keys.  A frequent word has one entry
a slice, so no key is hot.

Defined cases: null or empty text has no words, losses and score null, n_words 0; without any word of a
labelled document the target is uniform and s = 1; several labels of one document count as good if one is;
null ids and null labels are no target; repeated rows count and are scored each time; ids may be of any
type; extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import U, by_plane, from_planes, mix, shared_table, slices, word_hashes, words

CHARS, PRIOR, FLOOR = 4_500_000, 4.0, 0.01
#: Up to so many labelled ids go to every executor (8 bytes each); beyond it texts and labels are merge-joined.
FEW_LABELS = 1_000_000
#: Stands in for the hash of the start of text.
START = U(2)
SLICE = "slice long, docs long, docs_good long, n long, n_good long"


def cell_of(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Keys of bigrams by both words' hashes."""
    return mix(before.astype(U) * U(0x9E3779B97F4A7C15) + now.astype(U))


def one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def coded(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, good_col: str) -> DataFrame:
    """One row for each slice of the texts: its totals, ids, good, sizes, codes of words, and the words' sorted hashes."""
    good = shared_table(labels.where(F.col(good_col) == 1).select(F.col(id_col).alias("id")).where("id is not null").distinct()).withColumn("good", F.lit(True))
    good = F.broadcast(good) if good.count() <= FEW_LABELS else good.hint("merge")
    flagged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(good, "id", "left").select("id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    kind = flagged.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, chars=CHARS):
                offsets, codes, dictionary = words(part.column("text"))
                names, place = np.unique(word_hashes(dictionary), return_inverse=True)
                sizes, good = np.diff(offsets), part.column("good").to_numpy(zero_copy_only=False)
                totals = [number, int((sizes > 0).sum()), int((sizes[good] > 0).sum()), len(codes), int(sizes[good].sum())]
                steps = np.diff(names, prepend=U(0))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x]) for x in totals), one(part.column("id")), one(part.column("good")), one(pa.array(sizes.astype(np.int32))),
                     pa.array([by_plane(place[codes].astype(np.int32))]), pa.array([by_plane(steps)])],
                    names=["slice", "docs", "docs_good", "n", "n_good", "ids", "good", "sizes", "codes", "names"],
                )
                number += 1

    return flagged.mapInArrow(code, f"{SLICE}, ids array<{kind}>, good array<boolean>, sizes array<int>, codes binary, names binary")


class Slice:
    """The events of a slice.  Classes are its words, in the order of their hashes, and last the start of text."""

    def __init__(self, row: pa.StructScalar) -> None:
        self.sizes = row["sizes"].values.to_numpy().astype(np.int64)
        self.good = row["good"].values.to_numpy(zero_copy_only=False)
        self.names = np.cumsum(from_planes(row["names"].as_py(), U), dtype=U)
        self.word = from_planes(row["codes"].as_py(), np.int32).astype(np.int64)
        known = len(self.names)
        self.before = np.empty(len(self.word), np.int64)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = known
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        cells, self.cell = np.unique(self.before * (known + 1) + self.word, return_inverse=True)
        hashes = np.append(self.names, START)
        #: keys of words, then of bigrams, and their order
        self.keys = np.concatenate([self.names, cell_of(hashes[cells // (known + 1)], hashes[cells % (known + 1)])])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs in all documents, and in those of the target."""
        at = np.concatenate([self.word, self.cell + len(self.names)])
        mine = np.tile(self.good[self.doc], 2)
        return np.bincount(at, minlength=len(self.keys)), np.bincount(at[mine], minlength=len(self.keys))


def own_counts(doc: np.ndarray, event: np.ndarray) -> np.ndarray:
    """For each token, how often its document has its event; ``doc`` rises."""
    order = np.argsort(event, kind="stable")
    d, e = doc[order], event[order]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1]))) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(e)))
    out = np.empty(len(e), np.int64)
    out[order] = np.repeat(size, size)
    return out


def dealt(texts: DataFrame, ranges: int) -> DataFrame:
    """(part, slice, size, steps, n, good): each slice's keys in a range, as byte planes of their steps, and their counts."""
    width = U(((1 << 64) - 1) // ranges)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_struct_array():
                s = Slice(row)
                n, good = (x[s.order].astype(np.int32) for x in s.counts())
                keys = s.keys[s.order]
                part = np.minimum(keys // width, U(ranges - 1)).astype(np.int64)
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(keys))
                planes = [[by_plane(f(a, b)) for a, b in zip(starts, ends)] for f in (lambda a, b: np.diff(keys[a:b], prepend=U(0)), lambda a, b: n[a:b], lambda a, b: good[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[starts]), pa.array(np.full(len(starts), row["slice"].as_py(), np.int64)), *(pa.array(x, pa.binary()) for x in planes)],
                    names=["part", "slice", "steps", "n", "good"],
                )

    return texts.select("slice", "good", "sizes", "codes", "names").mapInArrow(deal, "part long, slice long, steps binary, n binary, good binary")


def summed(group: pa.Table) -> pa.Table:
    """Whole counts of a range's keys, for each slice in the order of its keys."""
    rows = [[x.as_py() for x in group[c]] for c in ("steps", "n", "good")]
    keys = [np.cumsum(from_planes(x, U), dtype=U) for x in rows[0]]
    ends = np.cumsum([len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    out = []
    for counts in rows[1:]:
        total = np.add.reduceat(np.concatenate([from_planes(x, np.int32) for x in counts]).astype(np.int64)[order], np.flatnonzero(new))
        out.append(pa.array([by_plane(x) for x in np.split(total[at], ends[:-1])], pa.binary()))
    return pa.Table.from_arrays([group["slice"].combine_chunks(), group["part"].combine_chunks(), *out], names=["slice", "part", "n", "good"])


def token_losses(s: Slice, whole: np.ndarray, good: np.ndarray, total: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each token under target and background, by the whole counts of the slice's keys."""
    known, all_words = len(s.names), total["n"]
    words_of, cells_of = own_counts(s.doc, s.word), own_counts(s.doc, s.cell)
    # a history's own count is that of the word before, and 1 at the start
    past_of = np.append(1, words_of[:-1])
    past_of[s.before == known] = 1
    size = s.sizes[s.doc]
    out = []
    for counts, n, docs, scale, mine in (
        (good, total["n_good"], total["docs_good"], 1.0, s.good[s.doc].astype(np.int64)),
        (whole, all_words, total["docs"], total["n_good"] / all_words if total["n_good"] else 1.0, 1),
    ):
        past = np.append(counts[:known], docs)
        single = (scale * (counts[s.word] - mine * words_of) + FLOOR) / (scale * (n - mine * size) + FLOOR * all_words)
        pair = scale * (counts[known:][s.cell] - mine * cells_of) + PRIOR * single
        out.append(-np.log(pair / (scale * (past[s.before] - mine * past_of) + PRIOR)))
    return out[0], out[1]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality") -> DataFrame:
    """(id_col, n_words, target_loss, background_loss, score) of every document."""
    texts = shared_table(coded(docs, labels, id_col, text_col, good_col))
    row = texts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "docs_good", "n", "n_good")), F.count("*").alias("slices")).first()
    total = row.asDict()
    whole = dealt(texts, max(1, total["slices"])).groupBy("part").applyInArrow(summed, "slice long, part long, n binary, good binary")

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_batches()[0].to_struct_array()[0]
        s, right = Slice(row), right.sort_by("part")
        whole, good = np.zeros(len(s.keys), np.int64), np.zeros(len(s.keys), np.int64)
        for out, c in ((whole, "n"), (good, "good")):
            if len(s.keys):
                out[s.order] = np.concatenate([from_planes(x.as_py(), np.int64) for x in right[c]])
        each = token_losses(s, whole, good, total)
        high, low = (np.bincount(s.doc, weights=x, minlength=len(s.sizes)) / np.maximum(s.sizes, 1) for x in each)
        none = s.sizes == 0
        return pa.Table.from_arrays(
            [row["ids"].values, pa.array(s.sizes), pa.array(high, mask=none), pa.array(low, mask=none), pa.array(high - low, mask=none)],
            names=["id", "n_words", "target_loss", "background_loss", "score"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.groupBy("slice").cogroup(whole.groupBy("slice")).applyInArrow(losses, f"id {kind}, n_words long, target_loss double, background_loss double, score double")
    return found.withColumnRenamed("id", id_col)
