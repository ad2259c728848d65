"""Language ID (operator 9): interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a character model of order five over letters: a word is its lower-cased letters
(runs of other characters count as one blank) between blanks, and contexts do not reach across words.
The highest order has counts, lower orders count distinct left neighbours, and each order interpolates
with the next lower one down to a uniform floor.  All languages share one set of grams, so one search
in a sorted array of 64-bit gram hashes yields every language's log-probability; a gram that no
language has falls back to its context's back-off weight and the shorter gram.

A text's loss under a language is its nats per character.  The lowest loss wins.  Calibration rows,
kept apart from the counts, fix the spread of the winner's loss by text length; a text whose loss lies
``REJECT_SPREADS`` spreads above its language's middle, and nearer to the losses that other languages'
calibration rows have there than to that middle, is rejected, as is a text without a letter.
``score`` is the posterior of the winner with a temperature fitted on the calibration rows.

The models learn from a bounded sample: at most about ``PER_LANGUAGE`` labelled documents of each
language and ``ALL_LANGUAGES`` in all, drawn by a hash of the id where they are stored, after a count of the
languages; a sixth of them calibrates (with many languages fewer: ``CALIBRATION`` losses in all), but for languages with under
``FEW_ROWS`` documents, which all teach.  Every gram of the sample is counted and kept.  Where the table of
grams times languages would have more than ``CELLS`` entries, each language has sorted arrays of its own instead, made in
a task of its own; both give the same losses.  Every whole text is scored.

Defined cases: null text, or text without a letter: ``und``, score 0, rejected.  Null labels and null
texts teach nothing.  Without any labelled row every text is ``und``.  Ties go to the language that
sorts first.  Rows are scored one by one, so repeated rows and null ids give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import U, mix, shared_table, slices, words

ORDER, PER_LANGUAGE, REJECT_SPREADS, FEW_ROWS = 5, 2000, 12.0, 20
#: Labelled documents of all languages together; more languages have fewer each.
ALL_LANGUAGES = 400_000
#: Losses (rows times languages) that calibration gathers at most.
CALIBRATION = 20_000_000
#: Up to so many entries (4 bytes each, all languages' in one row) the grams of all languages share one table.  Either way gives the same losses.
CELLS = 20_000_000
#: Up to so many different labels (and their counts) go to every executor; beyond it the draw is a merge join.
FEW_LABELS = 50_000
FLOOR_CHARS = 1 << 12  # characters that the uniform floor spreads over
SEED = 17


def letters_of(dictionary: pa.Array) -> list[str]:
    """Words as letters with single blanks for runs of other characters, without outer blanks."""
    text = pc.replace_substring_regex(dictionary, r"[^\p{L}\p{M}]+", " ")
    return pc.utf8_trim(text, " ").to_pylist()


def grams(names: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each letter and closing blank with its order-1 predecessors: (word number, codes).

    Blanks stand before the word's first letter.  A blank inside a name starts a new word's context.
    """
    text = " ".join(names) + " "
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    blank = code == 32
    # distance to the latest blank before each position
    at = np.arange(len(code))
    latest = np.maximum.accumulate(np.where(blank, at, -1))
    before = np.concatenate([[-1], latest[:-1]])
    rows = np.empty((len(code), order), np.int64)
    rows[:, -1] = code
    for back in range(1, order):
        far = np.full(len(code), 32, np.int64)
        far[back:] = code[:-back]
        rows[:, order - 1 - back] = np.where(at - back > before, far, 32)
    # names may hold blanks, so word numbers come from lengths
    number = np.repeat(np.arange(len(names)), np.fromiter((len(x) + 1 for x in names), np.int64, len(names)))
    return number, rows


def gram_hash(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), rows.shape[1], U)
    for j in range(rows.shape[1]):
        h = h * U(0x9E3779B97F4A7C15) + rows[:, j].astype(U) + U(1)
    return mix(h)


@dataclass
class Models:
    """Sorted gram hashes by order with log-probabilities, and context hashes with back-off weights."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    mean: np.ndarray | None = None
    alien: np.ndarray | None = None  # per language: how far above the middle a rejected loss lies at least
    spread: np.ndarray | None = None  # per language: a, b of variance a + b / characters
    own: list[Models] = field(default_factory=list)  # each language's own arrays, if they don't share a table

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities (rows, languages) of each row's last character after the others."""
        if self.own:
            return np.concatenate([m.score(rows) for m in self.own], axis=1)
        order = len(self.keys)
        out = np.zeros((len(rows), len(self.languages)), np.float32)
        todo = np.arange(len(rows))
        for n in range(order, 0, -1):
            part = rows[todo, order - n :]
            h = gram_hash(part)
            at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][at] == h
            out[todo[hit]] += self.logp[n - 1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            c = gram_hash(rows[todo, order - n : -1])
            at = np.minimum(np.searchsorted(self.contexts[n - 1], c), len(self.contexts[n - 1]) - 1)
            known = self.contexts[n - 1][at] == c
            out[todo[known]] += self.backoff[n - 1][at[known]]
        out[todo] -= np.float32(np.log(FLOOR_CHARS))
        return out


def kneser_ney(counts: pa.Table, order: int = ORDER) -> Models:
    """Models from rows (lang, gram, n): how often each language has each gram of ``order`` characters."""
    coded = counts["lang"].combine_chunks().dictionary_encode()
    languages = sorted(coded.dictionary.to_pylist())
    k = len(languages)
    number = np.array([languages.index(x) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    rows = np.frombuffer("".join(counts["gram"].to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, order)

    def tallied(rows: np.ndarray, lang: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different rows in the order of their hashes: (hashes, rows, sums by language)."""
        keys, first, place = np.unique(gram_hash(rows), return_index=True, return_inverse=True)
        return keys, rows[first], np.bincount(place * k + lang, weights=weight, minlength=len(keys) * k).reshape(len(keys), k).astype(np.float64)

    by_order = {order: tallied(rows, number, counts["n"].to_numpy())}
    for n in range(order - 1, 0, -1):  # below the highest order: in how many longer grams
        _, longer, c = by_order[n + 1]
        at, lang = np.nonzero(c > 0)
        by_order[n] = tallied(longer[at, 1:], lang, None)
    models, below = Models(languages), None
    for n in range(1, order + 1):
        keys, rows, c = by_order[n]
        ones, twos = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(np.where(ones + 2 * twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5), 0.1, 0.9)
        contexts, at = np.unique(gram_hash(rows[:, :-1]), return_inverse=True)
        total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
        np.add.at(total, at, c)
        np.add.at(kinds, at, c > 0)
        shorter = below[1][np.searchsorted(below[0], gram_hash(rows[:, 1:]))] if below else np.full_like(c, 1.0 / FLOOR_CHARS)
        tot = np.maximum(total[at], 1)
        p = np.where(total[at] > 0, np.maximum(c - discount, 0) / tot + discount * kinds[at] / tot * shorter, shorter)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        models.keys.append(keys)
        models.logp.append(np.log(p).astype(np.float32))
        models.contexts.append(contexts)
        models.backoff.append(np.log(back).astype(np.float32))
        below = keys, p
    return models


def by_language(counts: DataFrame) -> Models:
    """Models of which each language's is made in a task from its own counts, all of them; what comes back are finished arrays."""
    arrays = ("keys", "logp", "contexts", "backoff")
    kinds = (U, np.float32, U, np.float32)

    def make(table: pa.Table) -> pa.Table:
        made = kneser_ney(table)
        columns = [pa.array([getattr(made, name)[n].tobytes() for n in range(ORDER)], pa.binary()) for name in arrays]
        return pa.table([pa.array(made.languages * ORDER), pa.array(range(ORDER), pa.int32()), *columns], names=["lang", "n", *arrays])

    schema = "lang string, n int, " + ", ".join(f"{name} binary" for name in arrays)
    found: dict[str, Models] = {}
    for r in sorted(counts.select("lang", "gram", "n").groupBy("lang").applyInArrow(make, schema).collect(), key=lambda r: (r["lang"], r["n"])):
        own = found.setdefault(r["lang"], Models([r["lang"]]))
        for name, kind in zip(arrays, kinds, strict=True):
            x = np.frombuffer(r[name], kind)
            getattr(own, name).append(x.reshape(-1, 1) if kind is np.float32 else x)
    return Models(sorted(found), own=[found[x] for x in sorted(found)])


def losses(models: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(nats per character by text and language, characters counted)."""
    offsets, codes, dictionary = words(texts)
    names = letters_of(dictionary)
    some = np.fromiter((bool(x) for x in names), bool, len(names))
    size = np.where(some, np.fromiter((len(x) + 1 for x in names), np.int64, len(names)), 0)
    table = np.zeros((len(names), len(models.languages)))
    if some.any():
        number, rows = grams([x for x in names if x])
        # a word number rises by one at each word, so sums by word are sums of runs
        table[some] = np.add.reduceat(models.score(rows).astype(np.float64), np.searchsorted(number, np.arange(some.sum())), axis=0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = np.bincount(doc, weights=size[codes], minlength=len(offsets) - 1)
    total = np.stack([np.bincount(doc, weights=table[codes, j], minlength=len(n)) for j in range(len(models.languages))], 1)
    return -total / np.maximum(n, 1)[:, None], n


def decide(models: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(winner's number or -1, score, rejected, loss) of each text."""
    loss, n = losses(models, texts)
    best = loss.argmin(1)
    low = loss[np.arange(len(loss)), best]
    gap = (loss - low[:, None]) * (np.minimum(n, 200) * models.temperature)[:, None]
    score = 1.0 / np.exp(-np.clip(gap, 0, 700)).sum(1)
    away = low - models.mean[best]
    a, b = models.spread[best].T
    rejected = (away > np.maximum(REJECT_SPREADS * np.sqrt(a + b / np.maximum(n, 1)), models.alien[best])) | (n == 0)
    return np.where(n > 0, best, -1), np.where(n > 0, score, 0.0), rejected, low


def calibrate(models: Models, loss: np.ndarray, n: np.ndarray, truth: list[str]) -> None:
    """Fit the temperature and each language's spread of losses on rows that the counts have not seen.

    ``loss`` (rows, languages) and ``n`` characters of each row, and its label.
    """
    k = len(models.languages)
    models.mean, models.spread = np.full(k, np.log(FLOOR_CHARS)), np.tile([1.0, 1.0], (k, 1))
    models.alien = np.full(k, np.log(FLOOR_CHARS))
    right = np.array([models.languages.index(x) if x in models.languages else -1 for x in truth], np.int64)
    use = (n > 0) & (right >= 0)
    loss, n, right = loss[use], n[use], right[use]
    if not len(n):
        return
    grid = 2.0 ** np.arange(-6, 3)
    gap = (loss - loss.min(1, keepdims=True)) * np.minimum(n, 200)[:, None]
    cost = [(gap[np.arange(len(n)), right] * t + np.log(np.exp(-np.clip(gap * t, 0, 700)).sum(1))).mean() for t in grid]
    models.temperature = float(grid[int(np.argmin(cost))])
    own = loss[np.arange(len(n)), right]
    for j in range(k):
        mine = right == j
        if mine.sum() < 5:
            continue
        models.mean[j] = np.median(own[mine])
        other = np.median(loss[~mine, j]) if (~mine).any() else np.log(FLOOR_CHARS)
        models.alien[j] = max(other - models.mean[j], 0.0) / 2
        square, share = (own[mine] - models.mean[j]) ** 2, 1.0 / n[mine]
        # variance a + b / n: long texts give a, all together give b
        long = n[mine] >= np.median(n[mine])
        a = max(square[long].mean(), 1e-4)
        b = max((np.maximum(square - a, 0).sum()) / share.sum(), 1.0)
        models.spread[j] = a, b


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = PER_LANGUAGE) -> Models | None:
    """Train on at most about ``per_language`` labelled documents of each language, ``ALL_LANGUAGES`` in all; None without any."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("h"))
    sizes = shared_table(named.groupBy("lang").agg(F.count("*").alias("size")))
    labels = sizes.count()
    if not labels:
        return None
    steps = 1 << 20
    per_language = max(FEW_ROWS, min(per_language, ALL_LANGUAGES // labels))
    share = min(1.0, CALIBRATION * 6 / (labels * labels * per_language))  # of the rows set aside
    # counted first, so that the draw needs no shuffle of texts
    each = F.broadcast(sizes) if labels <= FEW_LABELS else sizes.hint("merge")
    drawn = named.join(each, "lang").where(F.pmod("h", F.lit(steps)) < F.ceil(F.lit(float(per_language) * steps) / F.col("size")))
    aside = (F.pmod(F.shiftright("h", 24), F.lit(6)) == 0) & (F.col("size") >= FEW_ROWS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                offsets, codes, dictionary = words(part.column("text"))
                names = letters_of(dictionary)
                for lang in sorted(set(langs)):
                    mine = np.repeat(langs == lang, np.diff(offsets))
                    uses = np.bincount(codes[mine], minlength=len(names))
                    kept = [i for i in np.flatnonzero(uses) if names[i]]
                    if not kept:
                        continue
                    number, rows = grams([names[i] for i in kept])
                    keys, at = np.unique(gram_hash(rows), return_index=True)
                    n = np.bincount(np.searchsorted(keys, gram_hash(rows)), weights=uses[kept][number])
                    texts = rows[at].astype(np.uint32).tobytes().decode("utf-32-le")
                    found = [texts[i * ORDER : (i + 1) * ORDER] for i in range(len(at))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(found), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = drawn.where(~aside).select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    counts = shared_table(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # every language's loss has to be known for every text: in one table of all grams, or language by language
    shared_table_fits = counts.select("gram").distinct().count() * labels <= CELLS
    models = kneser_ney(counts.toArrow()) if shared_table_fits else by_language(counts)
    if not models.languages:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                loss, n = losses(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(n), pa.array(loss.tolist(), pa.list_(pa.float64()))], names=["lang", "n", "loss"])

    # numbers only, as many rows as the sample has at most
    rows = drawn.where(aside & (F.pmod(F.shiftright("h", 34), F.lit(steps)) < F.lit(share * steps))).select("lang", "text").mapInArrow(lose, "lang string, n double, loss array<double>").collect()
    loss = np.array([r["loss"] for r in rows], np.float64).reshape(len(rows), len(models.languages))
    calibrate(models, loss, np.array([r["n"] for r in rows], np.float64), [r["lang"] for r in rows])
    return models


def judged(docs: DataFrame, models: Models | None, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` as _0, _1, ..., then lang_pred, score, rejected and loss (nats per character)."""
    src = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    if models is None:
        return src.drop("text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True), "loss": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(models)
    own = src.columns[:-1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, "und"], dtype=object)
        for batch in batches:
            for part in slices(batch):
                best, score, rejected, loss = decide(shared.value, part.column("text"))
                found = [pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected), pa.array(loss, mask=best < 0)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *found], names=[*own, "lang_pred", "score", "rejected", "loss"])

    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in src.schema.fields[:-1]]
    return src.mapInArrow(label, ", ".join([*kinds, "lang_pred string, score double, rejected boolean, loss double"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score, rejected, loss of every document."""
    found = judged(docs, fit(docs, id_col, text_col, lang_col), text_col, [id_col])
    return found.select(F.col("_0").alias(id_col), held_out("_0").alias("held_out"), "lang_pred", "score", "rejected", "loss")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is found; those that the models reject go."""
    found = judged(docs, fit(docs, id_col, text_col, lang_col), text_col, docs.columns).where("not rejected")
    return found.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
