"""Score kernels that run inside tasks: a block of questions against the rows a task reads.

Memory is fixed by ``CELLS``, whatever the numbers of questions and rows: rows come in slices, and of a
slice only what can still reach a question's best rows is kept. Scores are rounded before they are
compared, ties fall to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RANK_DIGITS = 9
#: Numbers that a kernel holds at once.
CELLS = 4_000_000
#: Scores this far below a bound may still round up to it.
MARGIN = 10.0**-RANK_DIGITS


def first_per_group(group: np.ndarray, limit: int) -> np.ndarray:
    """The places of the first ``limit`` members of every run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    return np.flatnonzero(place < limit)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places ``first[i], first[i] + 1, ...``, ``counts[i]`` of them, one after the other."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class RunningBest:
    """The ``limit`` best rows a task has seen for each of ``questions`` questions.

    ``floor`` is the score a row has to reach: that of a question's last kept row, once it has ``limit``.
    """

    def __init__(self, questions: int, limit: int):
        self.limit = limit
        self.floor = np.full(questions, -np.inf)
        self.question = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, "U1")
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, question: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """Candidates by question and row; ``ids`` of all rows are sorted, so rows compare like ids."""
        score = np.round(score, RANK_DIGITS)
        near = score >= self.floor[question]
        question, score, row = question[near], score[near], row[near]
        order = np.lexsort((row, -score, question))
        at = order[first_per_group(question[order], self.limit)]
        if len(at):
            self.pending.append((question[at], score[at], ids[row[at]]))
            if sum(len(p[0]) for p in self.pending) >= len(self.floor) * self.limit or not np.isfinite(self.floor).all():
                self.settle()

    def settle(self) -> None:
        """Merge the candidates and raise the floors."""
        parts = [(self.question, self.score, self.id), *self.pending]
        question, score, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.pending = []
        order = np.lexsort((ids, -score, question))
        order = order[first_per_group(question[order], self.limit)]
        self.question, self.score, self.id = question[order], score[order], ids[order]
        count = np.bincount(self.question, minlength=len(self.floor))
        full = np.flatnonzero(count == self.limit)
        self.floor[full] = self.score[np.cumsum(count)[full] - 1]

    def batches(self, names: list[str], score: str) -> Iterator[pa.RecordBatch]:
        """``(query_id, chunk_id, score)`` rows of what was kept."""
        self.settle()
        for at in range(0, len(self.question), 1 << 16):
            part = slice(at, at + (1 << 16))
            asked = pa.array(names, pa.string()).take(pa.array(self.question[part]))
            found = [asked, pa.array(self.id[part].tolist(), pa.string()), pa.array(self.score[part], pa.float64())]
            yield pa.RecordBatch.from_arrays(found, names=["query_id", "chunk_id", score])


class CosineBest:
    """Exact best rows by the product of unit vectors."""

    def __init__(self, wanted: np.ndarray, limit: int, cells: int = CELLS):
        self.wanted, self.cells = wanted, cells
        self.best = RunningBest(len(wanted), limit)

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Take in unit vectors with sorted ids."""
        rows = max(1, min(4096, self.cells // max(1, vectors.shape[1]) // 4))
        for low in range(0, len(vectors), rows):
            part = vectors[low : low + rows]
            # No row is closer to a question than the slice's centre plus the slice's radius allow.
            centre = part.mean(axis=0)
            radius = np.sqrt(((part - centre) ** 2).sum(axis=1).max())
            alive = np.flatnonzero(self.wanted @ centre + radius >= self.best.floor - 2 * MARGIN)
            step = max(1, self.cells // len(part))
            for at in range(0, len(alive), step):
                self._slice(alive[at : at + step], part, low, ids)

    def _slice(self, asked: np.ndarray, part: np.ndarray, low: int, ids: np.ndarray) -> None:
        scores = self.wanted[asked] @ part.T
        least = self.best.floor[asked]
        limit = self.best.limit
        if len(part) > limit and not np.isfinite(least).all():
            least = np.maximum(least, np.partition(scores, len(part) - limit, axis=1)[:, len(part) - limit])
        near = scores >= least[:, None] - MARGIN
        if int(near.sum()) > 2 * limit * len(asked):
            # Many rows tie around the last place: of equal ones only the first by id can stay.
            rounded = np.round(scores, RANK_DIGITS)
            least = self.best.floor[asked]
            if len(part) > limit:
                least = np.maximum(least, np.partition(rounded, len(part) - limit, axis=1)[:, len(part) - limit])
            ties = rounded == least[:, None]
            near = (rounded > least[:, None]) | (ties & (np.cumsum(ties, axis=1) <= limit))
        question, row = np.nonzero(near)
        self.best.add(asked[question], scores[question, row], row + low, ids)


class WeightedWords:
    """Questions as words with weights, by word and by question; words of a question by rising weight."""

    def __init__(self, question: np.ndarray, word: np.ndarray, weight: np.ndarray, questions: int, words: int):
        order = np.lexsort((word, weight, question))
        self.question, self.word, self.weight = question[order], word[order], weight[order]
        self.questions, self.words = questions, words
        self.counts = np.bincount(self.question, minlength=questions)
        self.first = np.cumsum(self.counts) - self.counts
        total = np.cumsum(np.maximum(self.weight, 0))  # a row may lack a word that weighs negative
        before = np.concatenate([[0.0], total])[self.first]
        # What a question's words up to this one can add up to, at a gain of 1.
        self.reach = total - before[self.question]
        by_word = np.argsort(self.word, kind="stable")
        self.by_word = by_word
        self.uses = np.bincount(self.word, minlength=words)
        self.word_first = np.cumsum(self.uses) - self.uses


class Bm25Best:
    """Exact best rows by summed word weights times gains, of which ``most`` is the largest possible.

    A row can only reach a question's floor with one of the words without which the others, at their
    largest gains, stay below it. Rows are found by those words alone, then scored on all words.
    """

    def __init__(self, asked: WeightedWords, limit: int, most: float, cells: int = CELLS):
        self.asked, self.most, self.cells = asked, most, cells
        self.best = RunningBest(asked.questions, limit)

    def add(self, row: np.ndarray, word: np.ndarray, gain: np.ndarray, ids: np.ndarray) -> None:
        """Take in distinct (row, word) pairs, sorted, with their gains; ids of rows are sorted."""
        uses = np.cumsum(self.asked.uses[word])
        low, rows, small = 0, len(ids), 8 * self.best.limit
        while low < rows:
            lo = int(np.searchsorted(row, low))
            done = uses[lo - 1] if lo else 0
            # So many rows as meet at most ``cells`` question words; few at first, to get floors early.
            high = int(row[hi]) if (hi := int(np.searchsorted(uses, done + self.cells, "right"))) < len(row) else rows
            high = max(low + 1, min(high, low + small))
            hi = int(np.searchsorted(row, high))
            self._slice(row[lo:hi], word[lo:hi], gain[lo:hi], ids)
            low, small = high, small * 4

    def _slice(self, row: np.ndarray, word: np.ndarray, gain: np.ndarray, ids: np.ndarray) -> None:
        asked = self.asked
        needed = asked.reach[asked.by_word] * self.most >= self.best.floor[asked.question[asked.by_word]] - 2 * MARGIN
        entries = asked.by_word[needed]
        uses = np.bincount(asked.word[entries], minlength=asked.words)
        first = np.cumsum(uses) - uses
        times = uses[word]
        found = entries[ranges(first[word], times)]
        cells = np.unique(np.repeat(row, times) * asked.questions + asked.question[found])
        words_of = asked.counts[cells % asked.questions]
        size = (int(row[-1]) - int(row[0]) + 1) * asked.questions if len(row) else 0
        if size <= self.cells and asked.uses[word].sum() <= words_of.sum():
            self._add_up(row, word, gain, cells, size, ids)
        else:
            self._look_up(row, word, gain, cells, words_of, ids)

    def _add_up(self, row: np.ndarray, word: np.ndarray, gain: np.ndarray, cells: np.ndarray, size: int, ids: np.ndarray) -> None:
        """Meet all words of the slice's rows with the questions that use them."""
        asked = self.asked
        times = asked.uses[word]
        entry = asked.by_word[ranges(asked.word_first[word], times)]
        base = int(row[0]) * asked.questions
        cell = np.repeat(row * asked.questions - base, times) + asked.question[entry]
        score = np.bincount(cell, weights=np.repeat(gain, times) * asked.weight[entry], minlength=size)[cells - base]
        some = score > 0
        self.best.add(cells[some] % asked.questions, score[some], cells[some] // asked.questions, ids)

    def _look_up(self, row: np.ndarray, word: np.ndarray, gain: np.ndarray, cells: np.ndarray, words_of: np.ndarray, ids: np.ndarray) -> None:
        """Look up all words of a question among those of a row."""
        asked = self.asked
        ends = np.cumsum(words_of)
        pairs = row * asked.words + word
        at = 0
        while at < len(cells):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.cells, "right")))
            part, counts = cells[at:end], words_of[at:end]
            question, holder = part % asked.questions, part // asked.questions
            entry = ranges(asked.first[question], counts)
            of = np.repeat(np.arange(len(part)), counts)
            wanted = holder[of] * asked.words + asked.word[entry]
            place = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            held = pairs[place] == wanted
            score = np.bincount(of[held], weights=asked.weight[entry[held]] * gain[place[held]], minlength=len(part))
            some = score > 0
            self.best.add(question[some], score[some], holder[some], ids)
            at = end
