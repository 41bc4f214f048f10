"""SentencePiece encoding with exact N-best segmentation, and decoding.

The ids of a text are the model's own: what the library gives for it, byte
fallback included.  Beside them stand the N best segmentations of the lattice.
The pieces of a model file span a lattice over a text; a segmentation's score
is the sum of its pieces' scores.  Forward Viterbi scores give, for every
position, the best score of all that lies before it.  Backward A* search starts
at the end and extends partial segmentations to the left; the forward score of
where one has come to is exactly what it can still gain, so segmentations leave
the agenda in order of their scores, and the first N are the N best.

No piece of the files here holds a word mark behind another character, and a
character that no piece holds stands alone, so what lies between is independent
in the lattice, and no merge crosses it: the library and the search see each
different word once, and a worker keeps up to twice ``CACHED`` of them.  Texts are taken, and rows given out, in slices of
about ``_SLICE`` bytes.  The N best of a text then need, beside
the best of every word, only the N - 1 words whose second best costs least:
another word would give N texts that are at least as good without it.  The
combination is exact, up to the choice among equal scores.

Scores are whole millionths of a nat, so sums and ties are exact.  A unigram
model's scores are taken as they are.  A BPE model's are the ranks of its
merges; they become log-probabilities by Zipf's law, -log(rank + 1) less a
constant.  A character without a piece costs ``UNKNOWN`` nats more than the
rarest piece and is spelled in byte pieces.

Decoding inverts ids of either kind: it joins the pieces, turns runs of byte
pieces into text, word marks into spaces, and drops the space that encoding put
in front.  A word mark that a text holds itself comes back as a space, as the
format has it; ``decoded`` compares with that.

Defined cases: a null text counts as empty, an empty text has no pieces and one
segmentation; equal rows give equal rows; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.suffixtree import Table
from plumbline.llm.text import bound_batches, sliced

N_BEST, CACHED, UNKNOWN, UNIT = 4, 50_000, 10.0, 1_000_000
MARK = "▁"
_NONE = -(1 << 60)
_STEP, _ARRAYS, _CELLS, _SLICE = np.uint64(0x9E3779B97F4A7C15), 32, 60_000, 1 << 20
#: Characters of a word whose edges are made in stretches; of a word that is kept; bytes of ids that end a generation.
_FAR, _KEPT, _LARGE = 4096, 64, 1 << 16
#: Words that the library sees at once; ids that are decoded at once.
_TOGETHER, _DECODED = 256, 1 << 16


class Model:
    """Pieces of a model file with whole-number scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        raw = [sp.get_score(i) for i in plain]
        if all(x <= 0 and x == int(x) for x in raw):
            share = log(sum(1 / (1 - x) for x in raw))
            raw = [-log(1 - x) - share for x in raw]
        self.pieces = {sp.id_to_piece(i): (i, round(x * UNIT)) for i, x in zip(plain, raw)}
        self.unknown = min(round(x * UNIT) for x in raw) - round(UNKNOWN * UNIT)
        self.longest = max(map(len, self.pieces))
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.spell = [b""] * size
        for i in plain:
            self.spell[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.spell[i] = bytes([b])
        known = {c for p in self.pieces for c in p} | {MARK}
        inside = "".join(map(re.escape, sorted(known - {MARK})))
        apart = all(MARK not in p.lstrip(MARK) for p in self.pieces)
        self.chunks = re.compile(f"{MARK}+[{inside}]*|[{inside}]+|[^{MARK}{inside}]" if apart else f"(?:{MARK}|[{inside}])+|[^{MARK}{inside}]").findall
        self.unk = sp.unk_id()
        # A character that no piece holds parts a word from the mark that the library puts in front.
        self.sp, self.guard = sp, next(c for c in map(chr, range(10, 0x110000)) if c not in known)
        self.skip = len(sp.encode(self.guard))
        self.parting = self.bytes.get(ord(self.guard)) if ord(self.guard) < 128 else None
        self.flat, self.sizes = np.frombuffer(b"".join(self.spell), np.uint8), np.array(list(map(len, self.spell)))
        self.starts = np.cumsum(self.sizes) - self.sizes
        keys = np.array([self.hash(p) for p in self.pieces], np.uint64)
        self.table = Table(keys, np.arange(len(keys)))
        self.numbers = np.array([i for i, _ in self.pieces.values()], np.int64)
        self.values = np.array([x for _, x in self.pieces.values()], np.int64)

    @staticmethod
    def hash(piece: str) -> int:
        """As ``Words`` computes it for all substrings at once."""
        h = 0
        for c in piece:
            h = (h ^ ord(c)) * int(_STEP) & (1 << 64) - 1
        return h | 1

    def split(self, text: str) -> list[str]:
        """Marked words of a text."""
        return self.chunks(MARK + text.replace(" ", MARK)) if text else []

    def ids(self, word: str, cuts: list[int]) -> list[int]:
        """Of a segmentation given by its positions from 0 to the end."""
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            known = self.pieces.get(word[a:b])
            out += [known[0]] if known else [self.bytes.get(x, self.unk) for x in word[a:b].encode()]
        return out

    def own_ids(self, words: list[str]) -> list[bytes]:
        """What the library gives for marked words, as 32-bit little-endian numbers."""
        out: list[bytes] = []
        for k in range(0, len(words), _TOGETHER):
            part = words[k : k + _TOGETHER]
            if self.parting is not None:  # together, with the guard between them
                flat = np.array(self.sp.encode("".join([self.guard + w for w in part]).replace(MARK, " ")), "<i4")
                at = np.flatnonzero(flat == self.parting)
                if len(at) == len(part):
                    raw, cuts = flat.tobytes(), [*(4 * at).tolist(), 4 * len(flat)]
                    out += [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:])]
                    continue
            found = self.sp.encode([self.guard + w.replace(MARK, " ") for w in part], num_threads=1)  # a word is the guard itself
            out += [np.array(x[self.skip :], "<i4").tobytes() for x in found]
        return out

    def edges(self, word: str) -> Edges:
        """For each end less one, the (start, score) of every piece that ends there; a character without a piece stands alone."""
        return _Far(self, word) if len(word) > _FAR else _known_edges(self, word, 0, len(word))


Edges = Sequence[list[tuple[int, int]]]


def _known_edges(of: Model, word: str, low: int, high: int) -> list[list[tuple[int, int]]]:
    """The edges of the ends above ``low`` and up to ``high``."""
    get, out = of.pieces.get, []
    for j in range(low + 1, high + 1):
        here = []
        for i in range(j - 1, max(-1, j - 1 - of.longest), -1):
            known = get(word[i:j])
            if known:
                here.append((i, known[1]))
            elif i == j - 1:
                here.append((i, of.unknown))
        out.append(here)
    return out


class _Far(Sequence):
    """The edges of a long word, made for one stretch of ``_FAR`` ends at a time."""

    def __init__(self, of: Model, word: str):
        self.of, self.word, self.low, self.held = of, word, -1, []

    def __len__(self) -> int:
        return len(self.word)

    def __getitem__(self, j: int) -> list[tuple[int, int]]:
        if j >= len(self.word):
            raise IndexError(j)
        if j // _FAR != self.low:
            self.low = j // _FAR
            self.held = _known_edges(self.of, self.word, j - j % _FAR, min(len(self.word), j - j % _FAR + _FAR))
        return self.held[j % _FAR]


@cache
def model(path: str) -> Model:
    return Model(path)


def forward(edges: Edges) -> tuple[array, array]:
    """Best score up to each position, and where the last piece of it starts."""
    best, back = array("q", [0]), array("q", [0])
    for here in edges:
        top, at = _NONE, 0
        for i, s in here:
            if best[i] + s > top:
                top, at = best[i] + s, i
        best.append(top)
        back.append(at)
    return best, back


def path(back: array) -> list[int]:
    """Positions of the best segmentation, from 0 to the end."""
    cuts = [len(back) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def second(edges: Edges, best: array, back: array) -> int | None:
    """Score of the second best segmentation: the best over pieces that the best one lacks."""
    n = len(edges)
    after = array("q", [_NONE]) * n + array("q", [0])
    own, top = n, None  # own: the end of the best one's piece that lies at or before j
    for j in range(n, 0, -1):
        if after[j] > _NONE:
            for i, s in edges[j - 1]:
                if after[j] + s > after[i]:
                    after[i] = after[j] + s
                if (own != j or back[j] != i) and (top is None or best[i] + s + after[j] > top):
                    top = best[i] + s + after[j]
        if own == j:
            own = back[j]
    return top


def n_best(edges: Edges, best: array, n: int) -> Iterator[tuple[int, int]]:
    """(score, number of pieces) of the n best, by A* from the end with the forward scores as heuristic.

    Every entry of the agenda stands for a segmentation of just its score and
    no two for the same one, so as many entries as are still wanted suffice.
    """
    agenda, given, order = [(-best[-1], 0, len(edges), 0, 0)], 0, 0
    while agenda and given < n:
        _, _, at, done, size = agenda.pop(0)
        if not at:
            given += 1
            yield done, size
            continue
        for i, s in edges[at - 1]:
            order -= 1  # of equal ones the newest goes first, so that one way is walked to its end
            entry = (-(best[i] + s + done), order, i, done + s, size + 1)
            if len(agenda) < n - given or entry < agenda[-1]:
                insort(agenda, entry)
                del agenda[n - given :]


class Words(dict):
    """Word to its row: score, cost of its second best, number of pieces, ids of its best, the model's own ids.

    Two generations of ``CACHED`` words of up to ``_KEPT`` characters each: words
    that are met again move to the new one, the old one is dropped when that is full.
    """

    def __init__(self, of: Model):
        self.of = of
        self.scores, self.costs, self.rows, self.owns = array("q"), array("q"), [], []
        self.reset()

    def reset(self) -> None:
        """Starts a generation."""
        self.old = ({w: k for w, k in self.items() if len(w) <= _KEPT}, self.scores, self.costs, self.rows, self.owns)
        self.clear()
        self.scores, self.costs, self.sizes, self.rows, self.owns, self.others, self.large = array("q"), array("q"), array("i"), [], [], {}, False

    def add(self, word: str, score: int, cost: int, ids: bytes, own: bytes) -> int:
        self.scores.append(score)
        self.costs.append(cost)
        self.sizes.append(len(ids) // 4)
        self.rows.append(ids)
        self.owns.append(own)
        self.large |= len(ids) > _LARGE
        k = self[word] = len(self.rows) - 1
        return k

    def extend(self, words: list[str], scores: list[int], costs: list[int], rows: list[bytes], owns: list[bytes]) -> None:
        """Adds many at once."""
        k = len(self.rows)
        self.scores.extend(scores)
        self.costs.extend(costs)
        self.sizes.extend([len(x) // 4 for x in rows])
        self.rows.extend(rows)
        self.owns.extend(owns)
        self.update(zip(words, range(k, k + len(words))))

    def __missing__(self, word: str) -> int:
        at, *columns = self.old
        if word in at:
            return self.add(word, *(x[at[word]] for x in columns))
        edges = self.of.edges(word)
        best, back = forward(edges)
        other = second(edges, best, back)
        return self.add(word, best[-1], -1 if other is None else best[-1] - other, np.array(self.of.ids(word, path(back)), "<i4").tobytes(), *self.of.own_ids([word]))

    def alternatives(self, word: str, n: int) -> list[tuple[int, int]]:
        """Score and size of the word's n best, each against its best."""
        found = self.others.get((word, n))
        if found is None:
            edges, at = self.of.edges(word), self[word]
            own = [(s - self.scores[at], size - self.sizes[at]) for s, size in n_best(edges, forward(edges)[0], n)]  # one id a piece: a character without a piece has no other way
            found = self.others[word, n] = [(0, 0), *own[1:]]
        return found

    def fill(self, words: set[str]) -> None:
        """Adds new words, those of one length at a time as arrays; long ones one by one."""
        by_size: dict[int, list[str]] = {}
        again, (old, *columns) = list(words & self.old[0].keys()), self.old
        at = list(map(old.__getitem__, again))
        self.extend(again, *(list(map(x.__getitem__, at)) for x in columns))
        for w in words.difference(again):
            by_size.setdefault(len(w), []).append(w)
        for size, same in by_size.items():
            if size > _ARRAYS or len(same) < 8:
                for w in same:
                    self[w]
                continue
            step = max(8, _CELLS // size)
            for k in range(0, len(same), step):
                self._fill(same[k : k + step], size)

    def _fill(self, same: list[str], size: int) -> None:
        """The same as ``__missing__`` for words of one length: forward and backward scores, the best path and the best piece beside it."""
        n, of = len(same), self.of
        codes = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(n, size).astype(np.uint64)
        score: dict[tuple[int, int], np.ndarray] = {}
        piece: dict[tuple[int, int], np.ndarray] = {}
        for i in range(size):
            h, keys = np.zeros(n, np.uint64), []
            for j in range(i, min(size, i + of.longest)):
                h = (h ^ codes[:, j]) * _STEP
                keys.append(h | np.uint64(1))
            hit, at = of.table.find(np.concatenate(keys))
            known, number = np.where(hit, of.values[at], _NONE).reshape(-1, n), np.where(hit, of.numbers[at], -1).reshape(-1, n)
            known[0][number[0] < 0] = of.unknown
            for k in range(len(keys)):
                if not k or (number[k] >= 0).any():
                    score[i, i + 1 + k], piece[i, i + 1 + k] = known[k], number[k]
        best, back, last = [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], [np.zeros(n, np.int64)]
        for j in range(1, size + 1):
            top, at, own = np.full(n, 2 * _NONE), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(j - 1, max(-1, j - 1 - of.longest), -1):
                if (i, j) in score:
                    now = best[i] + score[i, j]
                    more = now > top
                    top, at, own = np.where(more, now, top), np.where(more, i, at), np.where(more, piece[i, j], own)
            best.append(top)
            back.append(at)
            last.append(own)
        after = [np.full(n, _NONE) for _ in range(size)] + [np.zeros(n, np.int64)]
        path = np.zeros((n, size + 1), bool)
        path[:, size] = True
        rows, other = np.arange(n), np.full(n, _NONE)
        for j in range(size, 0, -1):
            path[rows, back[j]] |= path[:, j]
            for i in range(j - 1, max(-1, j - 1 - of.longest), -1):
                if (i, j) in score:
                    now = np.maximum(after[j] + score[i, j], _NONE)
                    after[i] = np.maximum(after[i], now)
                    beside = ~(path[:, j] & (back[j] == i))
                    other = np.where(beside, np.maximum(other, best[i] + now), other)
        ids = np.stack(last[1:], axis=1)
        taken = path[:, 1:]
        odd = (taken & (ids < 0)).any(axis=1)
        flat, ends = ids[taken].astype("<i4"), np.cumsum(taken.sum(axis=1)).tolist()
        raw = flat.tobytes()
        cost = np.where(other > _NONE // 2, best[size] - other, -1).tolist()
        cut, own = [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)], of.own_ids(same)
        if odd.any():  # spelled in bytes: one by one
            plain = np.flatnonzero(~odd).tolist()
            self.extend([same[k] for k in plain], best[size][plain].tolist(), [cost[k] for k in plain], [cut[k] for k in plain], [own[k] for k in plain])
            for k in np.flatnonzero(odd).tolist():
                self[same[k]]
        else:
            self.extend(same, best[size].tolist(), cost, cut, own)


def segment(text: str, words: Words, n: int, found: list[str] | None = None) -> tuple[bytes, bytes, list[int], list[int]]:
    """The model's own ids, those of the best segmentation, and the scores and sizes of the n best; found: the text's words."""
    if not text:
        return b"", b"", [0], [0]
    found = words.of.split(text) if found is None else found
    at = list(map(words.__getitem__, found))
    rows = np.array(at)
    own_ids, ids = b"".join(map(words.owns.__getitem__, at)), b"".join(map(words.rows.__getitem__, at))
    score, size = int(np.frombuffer(words.scores, np.int64)[rows].sum()), len(ids) // 4
    costs = np.frombuffer(words.costs, np.int64)[rows]
    open_ = np.flatnonzero(costs >= 0)
    if len(open_) > n - 1:
        open_ = open_[np.argpartition(costs[open_], n - 2)[: n - 1]]
    top = [(0, 0)]  # score and size, each against the best
    for k in open_.tolist():
        own = words.alternatives(found[k], n)
        top = sorted(((a + s, b + z) for a, b in top for s, z in own), key=lambda x: -x[0])[:n]
    return own_ids, ids, [score + a for a, _ in top], [size + b for _, b in top]


def segments(texts: list[str], words: Words, n: int) -> Iterator[tuple[bytes, bytes, list[int], list[int]]]:
    """``segment`` of each text; what is new in all of them is added together."""
    if len(words) > CACHED or words.large:
        words.reset()
    found = [words.of.split(t) for t in texts]
    words.fill(set().union(*found) - words.keys())
    for t, ws in zip(texts, found):
        yield segment(t, words, n, ws)


def decode(ids: Sequence[int] | np.ndarray, of: Model) -> str:
    """The text of a list of ids."""
    every, raw = np.asarray(ids, np.int64), []
    for k in range(0, len(every), _DECODED):
        part = every[k : k + _DECODED]
        size = of.sizes[part]
        ends = np.cumsum(size)
        raw.append(of.flat[np.repeat(of.starts[part] - ends + size, size) + np.arange(ends[-1])].tobytes())
    text = b"".join(raw).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


_workers: dict[str, Words] = {}


def encode(docs: DataFrame, file: str, n: int = N_BEST, ids: bool = False) -> DataFrame:
    """``(doc_id, n_pieces, ids_crc32, best_score, best_crc32, n_best, nbest_scores, nbest_pieces, decoded)`` of every row, and ``ids`` if wanted.

    n_pieces, ids_crc32 and ids are of the model's own ids, best_crc32 is of the
    best segmentation's; checksums see ids as 32-bit little-endian numbers.
    decoded: do the own ids decode to the text?
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.setdefault(file, Words(model(file)))
        for batch in sliced(batches, size=_SLICE):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            own, best, scores, sizes = zip(*segments(texts, words, n))
            lists = [np.frombuffer(raw, "<i4") for raw in own]
            columns = [
                pa.array(map(len, lists), pa.int64()),
                pa.array(map(zlib.crc32, own), pa.int64()),
                pa.array([s[0] / UNIT for s in scores], pa.float64()),
                pa.array(map(zlib.crc32, best), pa.int64()),
                pa.array(map(len, scores), pa.int32()),
                pa.array([[x / UNIT for x in s] for s in scores], pa.list_(pa.float64())),
                pa.array(sizes, pa.list_(pa.int32())),
                pa.array([decode(x, words.of) == t.replace(MARK, " ") for t, x in zip(texts, lists)], pa.bool_()),
            ]
            names = ["doc_id", "n_pieces", "ids_crc32", "best_score", "best_crc32", "n_best", "nbest_scores", "nbest_pieces", "decoded"]
            if ids:
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *lists]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)

    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_pieces long, ids_crc32 long, best_score double, best_crc32 long, n_best int, nbest_scores array<double>, nbest_pieces array<int>, decoded boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * ids)


def decode_frame(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(x or [], of) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    bound_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
