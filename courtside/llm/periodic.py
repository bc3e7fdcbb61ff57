"""Periodic runs of words, found by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of length ``max(6, 4 * q)``
or more, that no neighbouring word extends keeping the period.

The words of a group of documents become one sequence of numbers, different in every document. Rounds of block
compression (a repeated symbol and its count become one symbol) and pair compression (symbols fall into left and right
ones; each left one followed by a right one becomes a symbol with it) make a run-length grammar over it: equal symbols of
a round stand for equal words, and equal stretches are cut alike but for a few symbols at their ends. How far two
positions agree, forwards or backwards, is answered by climbing to larger symbols while both begin one and these are
equal, and down again at a difference. A run of period p spans three periods of starts, so the positions ``0, 3p, 6p ...``
of every period p are candidates enough (a harmonic sum of them); both extensions of a candidate give the run exactly.
There is no suffix array and no comparison of all pairs of positions.

Rows stay in their partitions: there is no shuffle, and a hot document costs its own task only. Null texts and empty
ones have no words and no runs; texts of any length are read whole (one that is longer than a group is a group of its
own); repeated rows get a row each; an empty table gives an empty result; columns that are not asked for are left out,
and those kept must not be named like a result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.frames import map_texts, quoted, with_fields

#: Least length of a run in words and in periods, words in a group of documents, candidates extended at a time.
LEAST_WORDS, LEAST_PERIODS = 6, 4
GROUP_WORDS, CANDIDATES = 1 << 16, 1 << 17
#: Random halves of the symbols of which a round takes the one that makes most pairs.
HALVES = 4
WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order: what ASCII white space divides; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")


class Grammar:
    """The symbols of all rounds over one sequence, each round between two ends that equal nothing, as flat arrays."""

    def __init__(self, words: np.ndarray):
        rng = np.random.default_rng(0)
        symbols, size = np.unique(words, return_inverse=True)[1].astype(np.int64), np.ones(len(words), np.int64)
        rounds, at = [], 0
        while True:
            m = len(symbols)
            one = {"symbol": symbols, "size": size, "right": np.ones(m, np.int64), "left": np.ones(m, np.int64)}
            rounds.append(one)
            if m <= 1:
                break
            at += 1
            if at % 2:
                begins, key = self._blocks(symbols, one)
            else:
                begins, key = self._pairs(symbols, rng)
            if len(begins) < m:
                symbols = np.unique(key, return_inverse=True)[1].astype(np.int64)
                size = np.add.reduceat(size, begins)
            else:
                rounds.pop()
                continue
            one["begins"] = begins
        self._join(rounds)

    @staticmethod
    def _blocks(symbols: np.ndarray, one: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where blocks of equal symbols begin, and a key of each. Symbols that occur once can match nothing, so stretches of them are one block too."""
        m, once = len(symbols), np.bincount(symbols)[symbols] == 1
        kind = np.where(once, -1, symbols)
        begins = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        count = np.diff(np.append(begins, m))
        of = np.repeat(np.arange(len(begins)), count)
        here = np.arange(m)
        one["right"] = np.where(once, 1, (begins + count)[of] - here)
        one["left"] = np.where(once, 1, here - begins[of] + 1)
        return begins, symbols[begins] * (count.max() + 1) + count

    @staticmethod
    def _pairs(symbols: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Where what is left begins once each left symbol before a right one is joined with it, and a key of each."""
        kinds, best, most = int(symbols.max()) + 1, None, -1
        for _ in range(HALVES):
            right = rng.integers(0, 2, kinds, np.int8).astype(bool)[symbols]
            joined = ~right[:-1] & right[1:]
            if (n := int(joined.sum())) > most:
                best, most = joined, n
        if not most:  # the first symbol is the only left one: no two equal ones are neighbours
            best = (symbols[:-1] == symbols[0]) & (symbols[1:] != symbols[0])
        begins = np.flatnonzero(np.concatenate(([True], ~best)))
        first = np.append(best, False)[begins]
        return begins, symbols[begins] * (kinds + 1) + np.where(first, symbols[np.minimum(begins + 1, len(symbols) - 1)] + 1, 0)

    def _join(self, rounds: list[dict]) -> None:
        """Lay the rounds behind one another; each has an end before and behind its symbols."""
        offset = np.concatenate(([0], np.cumsum([len(r["symbol"]) + 2 for r in rounds])))
        wide = lambda x, a, b: np.concatenate(([a], x, [b]))
        self.symbol = np.concatenate([wide(r["symbol"], -1, -2) for r in rounds])
        self.size = np.concatenate([wide(r["size"], 0, 0) for r in rounds])
        self.run = {1: np.concatenate([wide(r["right"], 1, 1) for r in rounds]), -1: np.concatenate([wide(r["left"], 1, 1) for r in rounds])}
        self.up = np.arange(len(self.symbol))
        self.edge = {1: np.zeros(len(self.symbol), bool), -1: np.zeros(len(self.symbol), bool)}
        self.down = {1: np.arange(len(self.symbol)), -1: np.arange(len(self.symbol))}
        self.words = offset[1]
        for k, r in enumerate(rounds[:-1]):
            low, high, begins = offset[k], offset[k + 1], r["begins"]
            m, n = len(r["symbol"]), len(begins)
            lasts = np.append(begins[1:], m) - 1
            self.up[low : low + m + 2] = high + wide(np.repeat(np.arange(n), lasts - begins + 1) + 1, 0, n + 1)
            for way, at in ((1, begins), (-1, lasts)):
                children = low + wide(at + 1, 0, m + 1)
                self.down[way][high : high + n + 2] = children
                self.edge[way][children] = True

    def agreement(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words agree from positions ``a`` and ``b`` (different ones of a pair), forwards (1) or backwards (-1), these included."""
        x, y, total, open_ = a + 1, b + 1, np.zeros(len(a), np.int64), np.arange(len(a))
        symbol, up, edge, down, run, size = self.symbol, self.up, self.edge[way], self.down[way], self.run[way], self.size
        while len(open_):
            px, py = up[x], up[y]
            climb = edge[x] & edge[y] & (symbol[px] == symbol[py])
            same = symbol[x] == symbol[y]
            step = np.where(same & ~climb, np.minimum(run[x], run[y]), 0)
            total[open_] += step * size[x]
            going = climb | same | (x >= self.words)
            x = np.where(climb, px, np.where(same, x + way * step, down[x]))[going]
            y = np.where(climb, py, np.where(same, y + way * step, down[y]))[going]
            open_ = open_[going]
        return total


def _candidates(words: np.ndarray, longest: int):
    """Arrays ``(position, period)`` in order of the period, of the grid's positions whose word comes again a period later."""
    at, periods, held = [], [], 0
    for p in range(1, longest // LEAST_PERIODS + 1):
        here = words[: len(words) - p : 3 * p]
        i = np.flatnonzero(here == words[p :: 3 * p][: len(here)]) * (3 * p)
        if len(i):
            at.append(i)
            periods.append(np.full(len(i), p))
            held += len(i)
        if held >= CANDIDATES:
            yield np.concatenate(at), np.concatenate(periods)
            at, periods, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(periods)


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows ``(start, length, period)`` of one stretch, that of the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = (rows[1:, :2] == rows[:-1, :2]).all(1)
    return rows[np.concatenate((np.ones(min(1, len(rows)), bool), ~again))]


def runs_of(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """The runs of a sequence of numbers, one row ``(start, length, period)`` each, by start, then period.

    ``longest`` bounds the length of a run (that of the longest document).
    """
    longest = len(words) if longest is None else longest
    found, grammar = [], None
    inside, period = np.full(len(words) + 1, -1), np.zeros(0, np.int64)
    for i, p in _candidates(words, longest):
        # within a known run whose period divides p, the candidate gives that run again
        known = inside[i]
        again = known >= 0
        again[again] = (inside[(i + p)[again]] == known[again]) & (p[again] % period[known[again]] == 0)
        i, p = i[~again], p[~again]
        if not len(i):
            continue
        grammar = grammar or Grammar(words)
        ahead, behind = grammar.agreement(i, i + p, 1), np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        behind[inner] = grammar.agreement(i[inner] - 1, (i + p)[inner] - 1, -1)
        length = p + ahead + behind
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        rows = _smallest(np.stack([(i - behind)[long], length[long], p[long]], 1))
        for k, (start, n, _) in enumerate(rows[np.argsort(rows[:, 2], kind="stable")].tolist(), len(period)):
            part = inside[start : start + n]
            part[part < 0] = k
        period = np.concatenate((period, np.sort(rows[:, 2])))
        found.append(rows)
    rows = _smallest(np.concatenate([np.zeros((0, 3), np.int64), *found]))
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of ``n`` words, whether no run contains it behind that run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _groups(sizes: np.ndarray):
    """Ranges of documents of about ``GROUP_WORDS`` words each."""
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > GROUP_WORDS:
            yield first, k
            first, held = k, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes)


def _of_documents(texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
    """``(number of words, runs, text without repetitions)`` of each text in UTF-8."""
    words = [text.split() if text else [] for text in texts]  # bytes are cut at ASCII white space only
    sizes = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for text in words for w in text], np.int64)
    ends = np.cumsum(sizes)
    all_runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in _groups(sizes):
        low, high = int(ends[a] - sizes[a]), int(ends[b - 1])
        own = np.repeat(np.arange(a, b), sizes[a:b])
        runs = runs_of(own * len(known) + codes[low:high], int(sizes[a:b].max())) if high > low else ()
        for start, length, period in runs.tolist() if len(runs) else ():
            doc = int(own[start])
            all_runs[doc].append((start + low - int(ends[doc] - sizes[doc]), length, period))
    collapsed = [b" ".join(compress(w, kept_words(len(w), np.array(runs)).tolist()) if runs else w) for w, runs in zip(words, all_runs)]
    return sizes.tolist(), all_runs, collapsed


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``runs`` (an array of start, length and period, by start, then period) and
    ``collapsed``: the words that no run repeats, joined by blanks."""
    names = ("n_words", "runs", "collapsed")
    if clash := {*keep} & {*names}:
        raise ValueError(f"columns named like a result: {sorted(clash)}")

    def run(batches):
        for batch in batches:
            sizes, runs, collapsed = _of_documents(batch.column(batch.num_columns - 1).to_pylist())
            structs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(structs, RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*keep, *names])

    schema = with_fields(df, keep, "n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string")
    return map_texts(df.select(*quoted(keep), text.cast("binary").alias("__text")), run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length by period; the first of equals, null if there is none."""
    best = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, best, lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def with_period(words: Column, n: Column, start: Column, period: Column) -> Column:
    """The words, of which those from number ``start`` on repeat the ``period`` words that begin there."""
    rest = n - start
    unit = F.slice(words, (start + 1).cast("int"), period.cast("int"))
    again = F.flatten(F.array_repeat(unit, F.ceil(rest / period).cast("int")))
    return F.concat(F.slice(words, F.lit(1), start.cast("int")), F.slice(again, F.lit(1), rest.cast("int")))
