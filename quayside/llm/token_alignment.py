"""Cross-tokenizer alignment (operator 13): which tokens of one tokenizer cover the bytes of another's.

Two tokenizers cut the same bytes.  In a slice of texts their tokens are the rows of two incidence matrices over
the slice's bytes, in compressed sparse rows made by hand: ``indptr`` holds where a token's bytes begin and end, ``indices`` the bytes.

* Overlap links are the non-zeros of A·Bᵀ: Gustavson's row product merges, for each byte of a token of A, the row of Bᵀ, which is the
  one token of B that holds the byte; equal columns are side by side and are added up, which gives the shared bytes.
* Offsets where tokens of both end cut the bytes into groups.  The product of the group incidences, A·Gᵀ with G·Bᵀ, gives all pairs of
  tokens that share a group.  Its rows are merged by token id, with multiplicities, group by group, so that a long
  group of repeated tokens costs its different ids and not the square of its tokens; rows are taken in blocks of ``LINKS`` products.

How often a pair of ids is linked in the corpus (in how many documents) is counted exactly.  Documents are stored as the ids of their
different pairs, in blocks of ``BLOCK_CHARS`` of text.  A pair counts once for each block with the block's number of documents,
is summed over all blocks, and its count goes back once to each block that has it; there the documents look it up.  So neither a
frequent pair nor a long document is dealt out by its key, and what is shuffled are a block's different pairs.

Defined cases: a null or empty text, and a text whose tokens don't join to a blank and the text, has no tokens, counts of 0 and an empty digest; special tokens'
strings in texts are plain text; a text longer than a slice is a slice of its own; rows are independent, so null ids, repeated rows
and other columns of any name need no care (repeated rows count as documents of their own); an empty table has no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayside.llm.common import shared_table, slices

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of text in one block of stored documents; a longer text is a block of its own.
BLOCK_CHARS = 6_000_000
#: Products of a group's rows worked out at once.
LINKS = 4_000_000
#: Words whose pieces a worker remembers; it starts anew when full.
CACHE = 600_000
#: Fixed value: how byte-level BPE cuts texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space side by side, or the mark of a blank in pieces.
TOGETHER = re.compile(r"\s\s|▁")
WIDE = 1 << 20  # a pair of ids is a * WIDE + b; a slice has fewer than 2**23 texts


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer of a ``tokenizers`` file; ``parts`` are the bytes of each id."""

    def __init__(self, path: str = A_FILE) -> None:
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet = byte_alphabet()
        vocab = told["model"]["vocab"]
        self.parts = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in told["added_tokens"])]))
        added = {t["id"] for t in told["added_tokens"]}
        ranks = {}
        for token, i in vocab.items():
            self.parts[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
            if i not in added:
                ranks[self.parts[i]] = i
        # Ranks by id say the same as the merges if merge k makes the k-th token after the single bytes.
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        usual = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order and usual else None
        # Its pattern cuts before each blank that stands alone, so that words between such blanks are cut independently.
        self.by_word = self.fast is not None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and the ids of a blank and each text."""
        if self.fast:
            try:
                return flat([self.fast.encode_to_numpy(" " + t) for t in texts])
            except BaseException as error:  # its pattern engine gives up on some very long runs
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return flat([self.own.encode(" " + t, add_special_tokens=False).ids for t in texts])


class Pieces:
    """A SentencePiece model; ``parts`` are the bytes of each id."""

    def __init__(self, path: str = B_FILE) -> None:
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.own.vocab_size()
        names = [self.own.id_to_piece(i) for i in range(n)]
        self.parts = [bytes([int(x[3:5], 16)]) if self.own.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

        # Where no piece holds a blank after another character, words between single blanks are cut independently.
        self.by_word = not any("▁" in x.lstrip("▁") for x in names)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts and the ids of each text, before which the model puts a blank."""
        return flat(self.own.encode(texts, num_threads=1))


def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of lists, all their numbers)."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    if lists and all(isinstance(x, np.ndarray) for x in lists):
        return offsets, np.concatenate(lists).astype(np.int64)
    return offsets, np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(offsets[-1]))


class Spelling:
    """The bytes of all tokens, one after another, to compare what tokens join to."""

    def __init__(self, parts: list[bytes]) -> None:
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def matches(self, offsets: np.ndarray, ids: np.ndarray, wholes: list[bytes]) -> np.ndarray:
        """For each text whether its tokens join to ``wholes`` and none of them is empty."""
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        made = self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], size)]
        whole = b"".join(wholes)
        if len(whole) == len(made) and (np.diff(ends[offsets]) == [len(w) for w in wholes]).all() and (size > 0).all() and (np.frombuffer(whole, np.uint8) == made).all():
            return np.ones(len(wholes), bool)
        bounds = ends[offsets]
        return np.array([made[s:e].tobytes() == w and bool((size[a:b] > 0).all()) for s, e, a, b, w in zip(bounds[:-1], bounds[1:], offsets[:-1], offsets[1:], wholes, strict=True)], bool)


def kept_lists(keep: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if keep.all():
        return offsets, ids
    return np.concatenate([[0], np.cumsum(np.diff(offsets)[keep])]).astype(np.int64), ids[np.repeat(keep, np.diff(offsets))]


def csr(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Incidence of tokens and bytes that follow one another: (indptr, indices)."""
    indptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return indptr, np.arange(indptr[-1], dtype=np.int64)


def transposed(indptr: np.ndarray, indices: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """The transpose of an incidence in compressed sparse rows."""
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    order = np.argsort(indices, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(indices, minlength=columns))]).astype(np.int64), rows[order]


def row_product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's product of two incidences: rows, columns and values of its non-zeros, in order."""
    (aptr, acol), (bptr, bcol) = a, b
    width = np.diff(bptr)[acol]  # each non-zero of A brings a row of B
    rows = np.repeat(np.repeat(np.arange(len(aptr) - 1), np.diff(aptr)), width)
    ends = np.cumsum(width)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width) + np.repeat(bptr[:-1][acol], width)
    columns = bcol[at]
    if not len(rows):
        return rows, columns, rows
    if (np.diff(rows) < 0).any() or ((np.diff(rows) == 0) & (np.diff(columns) < 0)).any():
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])]))
    return rows[new], columns[new], np.diff(np.append(new, len(rows)))


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token pairs with shared bytes, and how many: A·Bᵀ over bytes."""
    a, b = csr(a_sizes), csr(b_sizes)
    return row_product(a, transposed(*b, columns=int(b[0][-1])))


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """indptr of A's and of B's tokens by group: a group ends where tokens of both end."""
    a, b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    ends = np.intersect1d(a, b, assume_unique=True)  # no token is empty
    return tuple(np.concatenate([[0], np.searchsorted(x, ends, side="right")]).astype(np.int64) for x in (a, b))


def merged_ids(ptr: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group incidence with equal ids of a group merged: (indptr, ids, multiplicities)."""
    group = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    key, many = np.unique(group * WIDE + ids, return_counts=True)
    return np.concatenate([[0], np.cumsum(np.bincount(key // WIDE, minlength=len(ptr) - 1))]).astype(np.int64), key % WIDE, many


def summed(key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of what they have."""
    order = np.argsort(key)
    key, many = key[order], many[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(many, new) if len(new) else many


def linked_ids(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair of ids, links) from the merged group incidences of A and B; ``doc``: the document of each group.

    Row by row of A: its group's row of B is brought, multiplicities multiply, equal pairs of a document are added up.
    """
    (aptr, aid, amany), (bptr, bid, bmany) = a, b
    row_group = np.repeat(np.arange(len(aptr) - 1), np.diff(aptr))
    width = np.diff(bptr)[row_group]
    ends = np.cumsum(width)
    key, many, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(aid):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, side="right")))
        w = width[at:stop]
        row = np.repeat(np.arange(at, stop), w)
        col = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(bptr[:-1][row_group[at:stop]], w)
        part = summed(doc[row_group[row]] * WIDE**2 + aid[row] * WIDE + bid[col], amany[row] * bmany[col])
        key, many = summed(np.concatenate([key, part[0]]), np.concatenate([many, part[1]])) if len(key) else part
        at = stop
    return key // WIDE**2, key % WIDE**2, many


class Aligner:
    """Both tokenizers with the lengths of their tokens and the strings of the groups' digest."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> None:
        self.a, self.b = a, b
        self.spelled = [Spelling(t.parts) for t in (a, b)]
        most = max(len(x.sizes) for x in self.spelled)
        self.words: dict[str, int] = {}
        self.known = [(np.zeros(1, np.int64), np.zeros(0, np.int64))] * 2
        self.by_word = a.by_word and b.by_word
        self.told = np.array([f"{i}{mark}" for mark in ",|;" for i in range(most)], dtype=object)
        self.most = most

    def cut(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Offsets and ids of A and of B for texts that aren't empty.

        Where white space always stands alone, each different word between blanks goes to the tokenizers once.
        """
        plain = np.array([self.by_word and not TOGETHER.search(" " + t) and t[-1] != " " for t in texts], bool)
        whole = [t for t, ok in zip(texts, plain, strict=True) if not ok]
        out = [t.encode(whole) for t in (self.a, self.b)]
        if not plain.any():
            return out
        lists = pc.split_pattern(pa.array([t for t, ok in zip(texts, plain, strict=True) if ok], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        none = np.zeros(1, np.int64), np.zeros(0, np.int64)
        words, at, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()
        if len(self.words) + len(words) > CACHE:
            self.words, self.known = {}, [none, none]
        new = [w for w in words if w not in self.words]
        if new:
            ends = np.cumsum([1 + len(w.encode()) for w in new])
            for k, t in enumerate((self.a, self.b)):  # all new words as one text, cut again where they end
                _, ids = t.encode([" ".join(new)])
                start, known = self.known[k]
                at_end = 1 + np.searchsorted(np.cumsum(self.spelled[k].sizes[ids]), ends)
                self.known[k] = np.concatenate([start, start[-1] + at_end]), np.concatenate([known, ids])
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[at]
        for k, (start, ids) in enumerate(self.known):
            size = np.diff(start)[number]
            ends = np.concatenate([[0], np.cumsum(size)])
            joined = ids[np.arange(ends[-1]) + np.repeat(start[number] - ends[:-1], size)]
            own = ends[bounds]
            if plain.all():
                out[k] = own, joined
            else:
                parts = [iter(np.split(x, o[1:-1])) for o, x in ((own, joined), out[k])]
                out[k] = flat([next(parts[0 if ok else 1]) for ok in plain])
        return out

    def digests(self, a_ptr: np.ndarray, a_ids: np.ndarray, b_ptr: np.ndarray, b_ids: np.ndarray, first: np.ndarray) -> list[str]:
        """SHA-256 of the groups of each document; ``first``: the first group of each document, and the end."""
        a_many, b_many = np.diff(a_ptr), np.diff(b_ptr)
        starts = a_ptr[:-1] + b_ptr[:-1]
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        ga, gb = np.repeat(np.arange(len(a_many)), a_many), np.repeat(np.arange(len(b_many)), b_many)
        a_at = starts[ga] + np.arange(len(a_ids)) - a_ptr[:-1][ga]
        b_at = starts[gb] + a_many[gb] + np.arange(len(b_ids)) - b_ptr[:-1][gb]
        out[a_at], out[b_at] = a_ids, b_ids
        out[starts + a_many - 1] += self.most  # the last of A in a group
        out[starts + a_many + b_many - 1] += 2 * self.most
        bounds = np.append(starts, len(out))[first].tolist()
        told = self.told[out].tolist()
        return [hashlib.sha256("".join(told[s:e])[:-1].encode()).hexdigest() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]

    def texts(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, and the different pairs of each text with their links."""
        n = len(texts)
        own = [i for i, t in enumerate(texts) if t]
        given = [texts[i] for i in own]
        wholes = [(" " + t).encode() for t in given]
        cut = self.cut(given)
        keep = self.spelled[0].matches(*cut[0], wholes) & self.spelled[1].matches(*cut[1], wholes)
        at = np.array(own, np.int64)[keep]
        (a_off, a_ids), (b_off, b_ids) = (kept_lists(keep, *x) for x in cut)
        a_size, b_size = self.spelled[0].sizes[a_ids], self.spelled[1].sizes[b_ids]
        a_ptr, b_ptr = groups(a_size, b_size)
        first = np.searchsorted(a_ptr, a_off)  # documents end where groups do
        doc = np.repeat(np.arange(len(at)), np.diff(first))
        pair_doc, pair, many = linked_ids(merged_ids(a_ptr, a_ids), merged_ids(b_ptr, b_ids), doc)
        crossing, _, _ = overlaps(a_size, b_size)
        token_doc = np.repeat(np.arange(len(at)), np.diff(a_off))
        out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_pairs")}
        out["n_a"][at], out["n_b"][at], out["n_groups"][at] = np.diff(a_off), np.diff(b_off), np.diff(first)
        out["n_links"][at] = np.bincount(pair_doc, many, len(at)).astype(np.int64)
        out["n_overlaps"][at] = np.bincount(token_doc[crossing], minlength=len(at))
        out["n_pairs"][at] = np.bincount(pair_doc, minlength=len(at))
        told = [""] * n
        for i, x in zip(at.tolist(), self.digests(a_ptr, a_ids, b_ptr, b_ids, first), strict=True):
            told[i] = x
        return out | {"groups_sha256": told, "pair": pair, "many": many}


@functools.lru_cache(maxsize=2)
def worker_aligner(a_file: str, b_file: str) -> Aligner:
    """One for all tasks of a worker process, so that its words stay known."""
    return Aligner(ByteLevel(a_file), Pieces(b_file))


KEPT = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]
ALIGNED = "block string, {id}, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Every document (id, text) with its counts, and its different pairs of linked ids; blocks are numbered within a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = worker_aligner(a_file, b_file)
        task, block, chars = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                got = aligner.texts(texts)
                size = pc.sum(pc.fill_null(pc.binary_length(part.column("text")), 0)).as_py()
                if chars and chars + size > BLOCK_CHARS:
                    block, chars = block + 1, 0
                chars += size
                ends = pa.array(np.concatenate([[0], np.cumsum(got["n_pairs"])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}.{block}"] * len(texts)), part.column("id"), *(pa.array(got[k]) for k in KEPT), pa.array(got["groups_sha256"], pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(got["pair"])), pa.ListArray.from_arrays(ends, pa.array(got["many"]))],
                    ["block", "id", *KEPT, "groups_sha256", "pairs", "links"],
                )

    return docs.mapInArrow(work, ALIGNED.format(id=f"id {docs.schema['id'].dataType.simpleString()}"))


def looked_up():  # noqa: ANN201
    """For the documents of a block and its pairs with their counts: n_best and count_sum of each document."""

    def work(docs: pa.Table, counts: pa.Table) -> pa.Table:
        docs, counts = docs.combine_chunks(), counts.combine_chunks()
        pair = counts.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, many, best = pair[order], counts.column("docs").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order]
        n = docs.num_rows
        width = pc.list_value_length(docs.column("pairs")).to_numpy()
        row = np.repeat(np.arange(n), width)
        own = pc.list_flatten(docs.column("pairs")).to_numpy()
        links = pc.list_flatten(docs.column("links")).to_numpy()
        total, winners = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(own):
            at = np.searchsorted(pair, own)
            np.add.at(total, row, links * many[at])
            np.add.at(winners, row, np.where(best[at], links, 0))
        columns = [docs.column(c) for c in ("id", *KEPT)]
        return pa.table([*columns, pa.array(winners), pa.array(total), docs.column("groups_sha256")], names=["id", *KEPT, "n_best", "count_sum", "groups_sha256"])

    return work


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum, groups_sha256 of every document."""
    stored = shared_table(aligned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), a_file, b_file))
    seen = shared_table(stored.select("block", F.explode("pairs").alias("pair")).groupBy("block", "pair").agg(F.count("*").alias("n")))
    a_id = F.shiftright("pair", 20)
    counts = seen.groupBy("pair").agg(F.sum("n").alias("docs"))
    # an id of A has no more pairs than B has ids
    counts = shared_table(counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(a_id))))
    known = seen.select("block", "pair").join(counts.hint("merge"), "pair")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in [*KEPT, "n_best", "count_sum"]) + ", groups_sha256 string"
    return stored.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(looked_up(), schema).withColumnRenamed("id", id_col)
