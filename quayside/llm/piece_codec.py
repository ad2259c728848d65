"""SentencePiece encoding and decoding (operator 1): a streaming lattice with early commits.

Encoding walks a normalised text once.  For each position it keeps one backpointer: the last piece of
the best encoding of the text up to there.  The next piece can start no further back than the longest
piece is long, so only the backpointer paths from that window survive; as soon as they all run through
one boundary, the ids before it are committed and forgotten.  Memory is bounded by the window, not by
the text.

What "best" means is the model's: a unigram model takes the highest sum of piece scores (Viterbi); a
BPE model takes the encoding that its merges make, which is the only one whose neighbouring pieces all
are what the merges make of the two together, so a backpointer is the piece that is stable after the
piece before it.  Both give the ids of the reference implementation of the model.  Runs of blanks,
whose pieces have tied ranks in some BPE models, follow the merges themselves.

Where no piece holds a blank after another character, each word is such a converged boundary.  The
words that a worker meets first in some texts are then taken through the lattice together, position by
position, as NumPy arrays; the ids of words are kept in a cache of bounded size.

Decoding joins the pieces' bytes; byte pieces make up characters that the vocabulary lacks, and the
blank put before the text goes.

Defined cases: null text is encoded as null ids and decoded as null; empty text has no ids; lone bytes
that are no UTF-8 decode as U+FFFD; ids outside the vocabulary are an error; rows are independent, so
null ids, repeated rows and extra columns need no care.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import U, mix, slices

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries of a worker's cache of words and of piece pairs; it starts anew when full.
CACHE = 600_000
#: Longest word of the joint lattice, and slots of its table of piece pairs.
JOINT, SLOTS = 48, 1 << 21
BASE = U(0x9E3779B97F4A7C15)


class Codec:
    """One model: its vocabulary, the lattice and the caches of a worker."""

    def __init__(self, path: str = MODEL) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        plain = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        self.names = [self.model.id_to_piece(i) for i in range(n)]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: self.model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.unk = self.model.unk_id()
        self.bytes = {b: i for i in range(n) if self.model.is_byte(i) for b in [int(self.names[i][3:5], 16)]}
        low = min(self.scores.values(), default=0.0)
        self.unknown_score = low - 10.0
        # Unigram scores are log-probabilities; those of a BPE vocabulary are its ranks, whole numbers.
        self.bpe = all(float(s).is_integer() for s in self.scores.values())
        self.by_word = not any(BLANK in x.lstrip(BLANK) for x in self.ids)
        runs = [x for x in self.ids if len(x) > 1 and not x.strip(BLANK)]
        mixed = [x for x in self.ids if x.startswith(BLANK * 2) and x.strip(BLANK)]
        rest = [s for x, s in self.scores.items() if x.strip(BLANK) and len(x) > 1]
        self.runs_last = not mixed and (not runs or not rest or max(self.scores[x] for x in runs) < min(rest))
        self.chunk = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.spaces: dict[int, list[int]] = {}
        stored = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else x.replace(BLANK, " ").encode() for i, x in enumerate(self.names)]
        stored[self.unk] = " ⁇ ".encode()
        self.stored = pa.array(stored, pa.binary())
        # pieces by hash: a bitmap of 2**20 slots first, then a sorted array
        known = sorted((self.string_hash(x), i) for x, i in self.ids.items())
        self.hashes, self.numbers = np.array([h for h, _ in known], U), np.array([i for _, i in known], np.int64)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(self.hashes >> U(44)).astype(np.int64)] = True
        self.pair_keys, self.pair_stable = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    @staticmethod
    def string_hash(text: str) -> int:
        h = np.zeros(1, U)
        for c in text:
            h = h * BASE + U(ord(c) + 1)
        return int(mix(h)[0])

    # -- the merges themselves, for short strings and runs of blanks

    def merged(self, text: str) -> list[str]:
        """Pieces that the merges make of a text: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != both or after[i] != j:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in parts if x is not None]

    def stable(self, left: str, piece: str) -> bool:
        """Whether the merges make these two pieces, side by side, of their text; ``left`` may be empty."""
        found = self.pairs.get((left, piece))
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[left, piece] = self.merged(left + piece) == ([left, piece] if left else [piece])
        return found

    # -- the lattice

    def spelled(self, piece: str) -> list[int]:
        """Ids of a piece, or of a character that the vocabulary lacks."""
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unk]

    def lattice(self, text: str) -> Iterator[int]:
        """Ids of a text, committed as soon as all surviving paths meet."""
        width = self.longest
        done = 0  # everything before is committed
        start: dict[int, int] = {0: 0}  # position -> where its last piece starts
        score: dict[int, float] = {0: 0.0}
        for end in range(1, len(text) + 1):
            self._step(text, end, done, start, score)
            if end - done >= 4 * width or end == len(text):
                live = {end} if end == len(text) else {i for i in range(max(done, end - width + 1), end + 1) if i in start}
                while len(live) > 1:  # walk the latest back until all agree
                    last = max(live)
                    live.discard(last)
                    live.add(start[last] if last > done else done)
                (meet,) = live
                path, at = [], meet
                while at > done:
                    path.append((start[at], at))
                    at = start[at]
                for a, b in reversed(path):
                    yield from self.spelled(text[a:b])
                # the piece that ends at ``meet`` is still needed as a left neighbour
                keep = start[meet] if meet > 0 else 0
                for i in [i for i in start if i < meet]:
                    del start[i]
                    score.pop(i, None)
                start[meet] = keep
                done = meet

    def _step(self, text: str, end: int, done: int, start: dict[int, int], score: dict[int, float]) -> None:
        best = None
        for at in range(max(done, end - self.longest), end):
            if at not in start:
                continue
            piece = text[at:end]
            known = self.scores.get(piece)
            if known is None and end - at > 1:
                continue
            if self.bpe:
                left = text[start[at] : at]
                if known is None or self.stable(left if left in self.scores else "", piece):
                    start[end] = at
                    return
                continue
            total = score[at] + (self.unknown_score if known is None else known)
            if best is None or total > best:
                best, start[end] = total, at
        if best is not None:
            score[end] = best

    def stable_pairs(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``stable`` of many pairs of piece ids, -1 for no left piece."""
        key = (left + 1) << 32 | piece
        slot = (mix(key.view(U)) & U(SLOTS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if not len(new):
            return self.pair_stable[slot]
        out = self.pair_stable[slot]
        keys, back = np.unique(key[new], return_inverse=True)
        names = self.names
        found = np.array([self.stable(names[(k >> 32) - 1] if k >> 32 else "", names[k & 0xFFFFFFFF]) for k in keys.tolist()], bool)
        out[new] = found[back]
        self.pair_keys[slot[new]], self.pair_stable[slot[new]] = key[new], found[back]
        return out

    def joint_lattice(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as bytes, of different words.

        The BPE lattice of ``lattice`` for all words at once: for each end, the longest piece first.
        """
        out: dict[str, bytes] = {}
        words = sorted(words, key=len)
        size = np.fromiter(map(len, words), np.int64, len(words))
        lo = 0
        while lo < len(words):
            hi = min(int(np.searchsorted(size, max(8, size[lo] + 3), side="right")), lo + 40_000)
            out |= self._joint(words[lo:hi], size[lo:hi])
            lo = hi
        return out

    def _joint(self, words: list[str], size: np.ndarray) -> dict[str, bytes]:
        n, width = len(words), int(size[-1])
        code = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, width).T.astype(U) + U(1)
        before = np.zeros((width + 1, n), U)  # hashes of the words' beginnings
        power = [U(1)]
        with np.errstate(over="ignore"):
            for e in range(width):
                before[e + 1] = before[e] * BASE + code[e]
                power.append(power[-1] * BASE)
        # the last piece's id; -1 at the start, -2 where nothing ends, -10 - c for a character c without a piece
        last, start = np.full((width + 1, n), -2, np.int64), np.zeros((width + 1, n), np.int64)
        last[0] = -1
        for e in range(1, width + 1):
            open_ = np.flatnonzero(size >= e)
            for at in range(max(0, e - self.longest), e):
                if not len(open_):
                    break
                some = open_[last[at, open_] != -2]
                h = mix(before[e, some] - before[at, some] * power[e - at])
                hit = self.likely[(h >> U(44)).astype(np.int64)]
                some, h = some[hit], h[hit]
                place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[place] == h
                some, piece = some[hit], self.numbers[place[hit]]
                if len(some):
                    ok = self.stable_pairs(np.maximum(last[at, some], -1), piece)
                    last[e, some[ok]], start[e, some[ok]] = piece[ok], at
                    open_ = open_[last[e, open_] == -2]
                if at == e - 1 and len(open_):
                    lone = open_[~self.has_piece(before[e, open_] - before[at, open_] * power[1])]
                    last[e, lone], start[e, lone] = -10 - (code[at, lone].astype(np.int64) - 1), at
        place, ids = size.copy(), []
        row = np.arange(n)
        while (place > 0).any():
            ids.append(np.where(place > 0, last[place, row], -1))
            place = np.where(place > 0, start[place, row], 0)
        spelt = np.stack(ids[::-1], 1)
        count = (spelt != -1).sum(1)
        odd = (spelt < -1).any(1)
        narrow = spelt.astype(np.int32)
        out = {}
        for i, w in enumerate(words):
            if odd[i]:
                pieces = [self.spelled(chr(-10 - x)) if x < 0 else [x] for x in spelt[i, -count[i] :].tolist()]
                out[w] = np.array([x for p in pieces for x in p], np.int32).tobytes()
            else:
                out[w] = narrow[i, -count[i] :].tobytes()
        return out

    def has_piece(self, hashed: np.ndarray) -> np.ndarray:
        h = mix(hashed)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[place] == h

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of blanks and the word after them."""
        blanks = len(chunk) - len(chunk.lstrip(BLANK))
        if not self.bpe or blanks < 2:
            return list(self.lattice(chunk))
        if not self.runs_last:
            return [i for x in self.merged(chunk) for i in self.spelled(x)]
        if blanks == len(chunk):
            return self.run(blanks)
        tail = list(self.lattice(chunk[blanks - 1 :]))
        lone = tail[0] == self.ids.get(BLANK)
        return self.run(blanks) + tail[1:] if lone else self.run(blanks - 1) + tail

    def run(self, blanks: int) -> list[int]:
        found = self.spaces.get(blanks)
        if found is None:
            if len(self.spaces) >= 1000:
                self.spaces.clear()
            found = self.spaces[blanks] = [i for x in self.merged(BLANK * blanks) for i in self.spelled(x)]
        return found

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        texts = [self.model.normalize(x) if x else "" for x in texts]
        if not self.by_word:
            return [np.fromiter(self.lattice(x), np.int32) for x in texts]
        chunks = [self.chunk.findall(x) for x in texts]
        new: set[str] = set()
        for found in chunks:
            new.update(set(found).difference(self.words))
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = {w for found in chunks for w in found}
        joint = [w for w in new if len(w) <= JOINT and not w.startswith(BLANK * 2)] if self.bpe else []
        self.words.update(self.joint_lattice(joint))
        other = {w: np.array(self.encode_chunk(w), np.int32).tobytes() for w in new if w not in self.words}
        get = self.words.get
        return [np.frombuffer(b"".join([x if (x := get(w)) is not None else other[w] for w in found]), np.int32) for found in chunks]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of the id lists that ``offsets`` cuts ``ids`` into."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.names)):
            raise ValueError("an id is outside the vocabulary")
        parts = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.stored.take(pa.array(ids)).cast(pa.large_binary()))
        texts = [x.decode("utf-8", "replace") for x in pc.binary_join(parts, pa.scalar(b"", pa.large_binary())).to_pylist()]
        return [x[1:] if x.startswith(" ") else x for x in texts]


_CODECS: dict[str, Codec] = {}


def codec(path: str = MODEL) -> Codec:
    """The worker's codec for a model file; the file is at this path on every machine."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def id_lists(texts: pa.Array, model: Codec) -> tuple[np.ndarray, np.ndarray]:
    got = model.encode_all(texts.to_pylist())
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
    return offsets, np.concatenate(got) if got else np.zeros(0, np.int32)


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = MODEL) -> DataFrame:
    """Columns ``keep``, then ids array<int>, n_tokens long, decoded string.

    ``decoded`` is what ``decode`` makes of the ids.
    """
    src = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    own = src.columns[:-1]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for part in slices(batch, chars=2_000_000):
                text = part.column("text")
                offsets, ids = id_lists(text, model)
                none = text.is_null()
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=none)
                count = pa.array(np.diff(offsets), mask=none.to_numpy(zero_copy_only=False))
                decoded = pa.array(model.decode(offsets, ids), pa.string(), mask=none.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), lists, count, decoded], names=[*own, "ids", "n_tokens", "decoded"])

    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in src.schema.fields[:-1]]
    out = src.mapInArrow(spell, ", ".join([*kinds, "ids array<int>, n_tokens long, decoded string"]))
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "ids", "n_tokens", "decoded")


def decode(rows: DataFrame, keep: list[str], ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """Columns ``keep``, then decoded string, from lists of ids."""
    src = rows.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(ids_col).cast("array<int>").alias("ids"))
    own = src.columns[:-1]

    def unspell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            ids = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            texts = model.decode(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False))
            decoded = pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), decoded], names=[*own, "decoded"])

    kinds = [f"`{x.name}` {x.dataType.simpleString()}" for x in src.schema.fields[:-1]]
    out = src.mapInArrow(unspell, ", ".join([*kinds, "decoded string"]))
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "decoded")
