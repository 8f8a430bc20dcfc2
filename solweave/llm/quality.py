"""Text quality per document: counts, and shares of prose, list, table and junk lines by a hidden Markov model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solweave.functions.names import label
from solweave.staging import stage

LABELS = ("prose", "list", "table", "junk")

#: Buckets of the hashed counts of single words and of word pairs. They bound what is sent to the executors.
WORDS, PAIRS = 1 << 18, 1 << 20

# Where fitting starts, and what it is held to ------------------------------------------
#: Log-likelihood of each trait of a line under (prose, list, table, junk), family by family; each family is scaled to add up to 1.
START = {
    "beginning": {"bullet": (-4.0, -0.6, -4.0, -2.5), "quoted": (-2.0, -4.5, -5.0, -3.0), "indent": (-5.0, -1.0, -2.0, -2.0), "plain": (-0.3, -1.5, -0.3, -0.3)},
    # delimiters of a table row against words
    "cells": {"cells-many": (-7.0, -4.0, -0.3, -2.0), "cells-some": (-3.0, -1.5, -1.2, -1.8), "cells-none": (-0.1, -0.4, -2.5, -0.7)},
    # words that also occur in other texts
    "known": {"known-high": (-0.15, -0.6, -1.0, -1.4), "known-mid": (-2.3, -1.4, -1.0, -1.4), "known-low": (-5.5, -1.8, -1.1, -0.7)},
    # the direction of neighbouring words
    "order": {"order-high": (-0.25, -1.0, -2.0, -4.0), "order-mid": (-2.5, -1.2, -1.4, -1.4), "order-low": (-11.0, -1.8, -1.4, -0.5), "order-none": (-3.5, -1.0, -0.6, -0.9)},
    # characters other than letters, digits, blanks and the usual punctuation
    "symbols": {"symbols-low": (-0.1, -0.5, -0.9, -0.9), "symbols-mid": (-2.5, -1.1, -0.8, -1.2), "symbols-high": (-6.0, -3.0, -1.6, -0.7)},
    # different words among all, for lines of several words
    "variety": {"variety-high": (-0.2, -0.2, -0.3, -0.8), "variety-low": (-9.0, -1.6, -1.2, -0.6)},
    # numbers, codes and marked-up names among the words
    "codes": {"codes-low": (-0.2, -0.7, -1.6, -0.9), "codes-mid": (-1.7, -1.1, -0.9, -1.1), "codes-high": (-5.5, -1.0, -0.6, -0.7)},
    # single letters with blanks between them
    "letters": {"letters-apart": (-20.0, -3.5, -3.5, -1.5), "letters-joined": (0.0, -0.03, -0.03, -0.25)},
    # length in words
    "words": {"words-few": (-2.8, -0.7, -0.9, -0.9), "words-some": (-0.9, -0.8, -0.9, -1.1), "words-many": (-0.4, -2.2, -1.6, -1.0)},
    # settings, log lines and markup
    "form": {"form-record": (-6.5, -0.9, -1.2, -0.8), "form-free": (-0.02, -0.5, -0.5, -0.6)},
    # end of the line
    "end": {"end-full": (-0.5, -2.3, -3.0, -2.0), "end-half": (-3.2, -0.9, -2.0, -1.8), "end-open": (-1.1, -0.6, -0.2, -0.3)},
    # a phrase without the length and shape of a sentence after a bullet
    "item": {"item-phrase": (-4.5, -0.3, -3.5, -2.5), "item-sentence": (-0.3, -2.5, -4.0, -3.0), "item-no": (-0.1, -0.9, -0.1, -0.1)},
    # the same lines over and over in the text
    "again": {"again-yes": (-7.0, -2.0, -2.0, -1.0), "again-no": (0.0, -0.15, -0.15, -0.45)},
}
#: Log-probability of the first label, and of going from one (row) to the next (column).
FIRST = np.log([0.4, 0.2, 0.2, 0.2])
NEXT = np.log([[0.88, 0.04, 0.04, 0.04], [0.06, 0.86, 0.04, 0.04], [0.06, 0.04, 0.86, 0.04], [0.06, 0.04, 0.04, 0.86]])
# ---------------------------------------------------------------------------------------------------

#: Traits by number, the family of each, and the number of a trait that says nothing.
TRAITS = [t for f in START.values() for t in f]
FAMILY = np.array([i for i, f in enumerate(START.values()) for _ in f])
NOTHING = len(TRAITS)
_NUMBER = {t: i for i, t in enumerate(TRAITS)} | {"": NOTHING}


@dataclass(frozen=True)
class Tables:
    """Log-probabilities of a hidden Markov model over the labels: of traits (traits x labels), of the first label, of the next."""

    emission: np.ndarray
    first: np.ndarray
    next: np.ndarray

    def scores(self, traits: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log-likelihood of lines (traits: lines x families) under each label."""
        table = np.vstack([self.emission, np.zeros(len(LABELS))])
        return table[traits].sum(axis=1) * weight[:, None]


def _scaled(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs)
    for f in range(len(START)):
        p[FAMILY == f] /= p[FAMILY == f].sum(axis=0)
    return p


def start_tables() -> Tables:
    return Tables(np.log(_scaled(np.array([v for f in START.values() for v in f.values()]))), FIRST, NEXT)


_BULLET = re.compile(r"(?:[*•\-+–·o]|\(?\d{1,4}[.):]|\[[ xX]?\])\s+(?=\S)")
_RECORD = re.compile(r"(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d|[0-9a-f]{6,}\s|</?[a-z]+[ >]|[\w.\[\]]+\s*[=:]\s*\S+\s*[;,]?$|\{|\}|\"[\w ]+\":)")
_USUAL = re.compile(r"[^\W_]|[\s.,;:!?'\"()’%°/±µ-]")
_LONE = frozenset("¼½¶§¤€™œ�¬")

#: Characters that are taken together; more texts or longer ones make more chunks.
CHUNK = 500_000
_SPACE, _ODD, _ALONE, _UPPER, _STOP, _WORD, _DIGIT, _UNKNOWN = 1, 2, 4, 8, 16, 32, 64, 128


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


@dataclass
class Words:
    """The words of a text: hash, line, whether they hold digits or underscores, and whether they are one letter (or number)."""

    hash: np.ndarray
    line: np.ndarray
    code: np.ndarray
    single: np.ndarray

    @property
    def slot(self) -> np.ndarray:
        return (self.hash >> np.uint64(40)).astype(np.int64) % WORDS

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first word, bucket, bucket of the reverse) of neighbouring words of a line."""
        at = np.flatnonzero(self.line[1:] == self.line[:-1])
        a, b = self.hash[at], self.hash[at + 1]
        mixed = lambda a, b: ((_mix(a * np.uint64(3) + _mix(b))) >> np.uint64(40)).astype(np.int64) % PAIRS
        return at, mixed(a, b), mixed(b, a)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Reader:
    """Texts as arrays: characters by class, and words by hash, without a string per word."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)
        self.lower = np.zeros(0x110000, dtype=np.uint32)
        self.power = np.ones((2, 1), dtype=np.uint64)

    def characters(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code point, class, line) of each character, and the first and end place of each line."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.classes[points]
        if (kind == _UNKNOWN).any():
            for p in np.unique(points[kind == _UNKNOWN]).tolist():
                c = chr(p)
                word = c.isalnum() or c == "_"
                self.classes[p] = _SPACE * c.isspace() | _ODD * (not _USUAL.match(c)) | _ALONE * (c in _LONE) | _UPPER * c.isupper() | _STOP * (c in ".!?") | _WORD * word | _DIGIT * c.isdigit()
                self.lower[p] = ord(c.lower()[0])
            kind = self.classes[points]
        end = np.r_[np.flatnonzero(points == 10), len(points)]
        start = np.r_[0, end[:-1] + 1]
        return points, kind, np.repeat(np.arange(len(start)), end - start + 1)[: len(points)], start, end

    def _powers(self, n: int) -> np.ndarray:
        if self.power.shape[1] < n:
            step = np.array([self.BASE, pow(self.BASE, -1, 1 << 64)], dtype=np.uint64)[:, None]
            table = np.repeat(step, n + 1000, axis=1)
            table[:, 0] = 1
            self.power = np.cumprod(table, axis=1, dtype=np.uint64)
        return self.power

    def words(self, points: np.ndarray, kind: np.ndarray, of: np.ndarray) -> Words:
        """Words are runs of letters, digits and underscores, also with apostrophes inside; case doesn't matter, a run of
        digits is one digit, and markup holds no words."""
        word = (kind & _WORD) > 0
        quote = (points == 39) | (points == 0x2019)
        if quote.any():
            quote[1:-1] &= word[:-2] & word[2:]
            quote[[0, -1]] = False
            word |= quote
        opening = np.flatnonzero(points == ord("<"))
        if len(opening):
            word &= ~_markup(points, opening)
        digit = ((kind & _DIGIT) > 0) & word
        keep = word.copy()
        keep[1:] &= ~(digit[1:] & digit[:-1])
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        at = np.flatnonzero(keep)
        if not len(at):
            none = np.zeros(0, dtype=np.int64)
            return Words(none.astype(np.uint64), none, none.astype(bool), none.astype(bool))
        first = np.flatnonzero(begin[at])
        letters = np.where(digit[at], np.uint32(57), self.lower[points[at]]).astype(np.uint64)
        power = self._powers(len(at) + 1)
        # The hash of a word is the difference of running sums of letter * BASE**place, taken back to place 0.
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((letters + np.uint64(1)) * power[0, : len(at)], dtype=np.uint64)])
        last = np.r_[first[1:], len(at)]
        h = _mix((run[last] - run[first]) * power[1, first])
        odd = np.r_[0, np.cumsum(digit[at] | (points[at] == ord("_")))]
        return Words(h, of[at[first]], odd[last] > odd[first], last - first == 1)


def _markup(points: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Characters between < and > on a line, where a letter or a slash follows the <."""
    after = points[np.minimum(opening + 1, len(points) - 1)]
    opening = opening[(after == ord("/")) | ((after | 32) >= 97) & ((after | 32) <= 122)]
    stops = np.flatnonzero((points == ord(">")) | (points == ord("<")) | (points == 10))
    nxt = np.searchsorted(stops, opening, side="right")
    ok = nxt < len(stops)
    opening, close = opening[ok], stops[nxt[ok]]
    real = points[close] == ord(">")
    step = np.zeros(len(points) + 1, dtype=np.int32)
    step[opening[real]] += 1
    step[close[real]] -= 1
    return np.cumsum(step[:-1]) > 0


def _chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Places and texts that aren't empty, some hundred thousand characters at a time."""
    where: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            where.append(i)
            held.append(t)
            size += len(t)
            if size >= CHUNK:
                yield where, held
                where, held, size = [], [], 0
    if held:
        yield where, held


def word_counts(texts: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(texts per word, occurrences per pair of neighbours), hashed, over all different texts.

    Every task counts into arrays of fixed size and hands on what isn't 0, so the result has at most
    WORDS + PAIRS numbers however many texts there are.
    """
    distinct = texts.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).dropDuplicates(["text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        total = np.zeros(WORDS + PAIRS, dtype=np.int64)
        for b in batches:
            for _, held in _chunks(b["text"].to_pylist()):
                words = reader.words(*reader.characters("\n".join(held))[:3])
                doc = np.repeat(np.arange(len(held)), [t.count("\n") + 1 for t in held])[words.line]
                np.add.at(total, _distinct(doc * WORDS + words.slot) % WORDS, 1)
                np.add.at(total, WORDS + words.pairs()[1], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counts = distinct.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(WORDS + PAIRS, dtype=np.int64)
    total[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return total[:WORDS], total[WORDS:]


def _spread(df: DataFrame) -> DataFrame:
    """Texts as they lie in their files; where these give less than a task for each core, they are spread over more."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


class LineReader:
    """Traits of the lines of texts."""

    def __init__(self, texts: np.ndarray, pairs: np.ndarray) -> None:
        self.texts, self.pairs = texts, pairs
        self.reader = Reader()

    def _pick(self, *cases: tuple[np.ndarray | bool, str]) -> np.ndarray:
        """The number of the trait of the first case that holds."""
        return np.select([np.asarray(c, dtype=bool) for c, _ in cases[:-1]], [_NUMBER[n] for _, n in cases[:-1]], _NUMBER[cases[-1][1]])

    def traits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines that aren't blank: text, length in characters, traits (lines x families); texts aren't empty."""
        joined = "\n".join(texts)
        points, kind, of, start, end = self.reader.characters(joined)
        doc = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
        n_lines = len(start)
        inked = np.flatnonzero((kind & _SPACE) == 0)
        ink_line = of[inked]
        per_line = lambda at: np.bincount(of[at], minlength=n_lines)
        full = np.bincount(ink_line, minlength=n_lines) > 0
        first, last = np.full(n_lines, 0), np.full(n_lines, 0)
        first[ink_line[::-1]] = inked[::-1]
        last[ink_line] = inked
        size = last - first + 1

        # How lines begin: blanks, quote marks, bullets.
        pad = np.r_[points, [10, 10, 10]]
        begin = first.copy()
        quoted = full & (pad[first] == ord(">")) & np.isin(pad[first + 1], [ord(" "), ord(">")])
        for _ in range(8):
            go = quoted & np.isin(pad[begin], [ord(">"), ord(" ")]) & (begin < last)
            if not go.any():
                break
            begin[go] += 1
        lead = pad[begin]
        indent = full & ~quoted & ((first - start >= 2) | (pad[start] == 9))
        rest = begin.copy()
        maybe = full & (np.isin(lead, [ord(c) for c in "*•-+–·o(["]) | ((lead >= 48) & (lead <= 57)))
        bullet = np.zeros(n_lines, dtype=bool)
        for i in np.flatnonzero(maybe).tolist():
            m = _BULLET.match(joined, begin[i], end[i])
            if m:
                bullet[i], rest[i] = True, m.end()
        signs = per_line(np.flatnonzero((points == ord("=")) | (points == ord(":"))))
        head = pad[rest]
        maybe = full & ((signs > 0) | ((head >= 48) & (head <= 57)) | ((head >= 97) & (head <= 102)) | np.isin(head, [ord(c) for c in '<{}"']))
        record = np.zeros(n_lines, dtype=bool)
        for i in np.flatnonzero(maybe).tolist():
            record[i] = _RECORD.match(joined, rest[i], end[i]) is not None

        # Cells: delimiters of table rows.
        before, after = np.r_[[10], points[:-1]], pad[1 : len(points) + 1]
        blank = (kind & _SPACE) > 0
        blank_before, blank_after = np.r_[True, blank[:-1]], np.r_[blank[1:], True]
        stop = (points == ord(",")) | (points == ord(";"))
        mark = (points == 9) | (points == ord("|")) | (stop & ~blank_before & ~blank_after)
        mark |= (points == ord("&")) & (before == 32) & (after == 32)
        mark |= (points == ord("<")) & (after == ord("t")) & np.isin(pad[2 : len(points) + 2], [ord(c) for c in "dhr"])
        mark |= ~blank & (before == 32) & (np.r_[[10, 10], points[:-2]][: len(points)] == 32)
        mark = np.flatnonzero(mark)
        cells = per_line(mark[mark > begin[of[mark]]]) + per_line(mark[(mark == begin[of[mark]]) & (points[mark] == ord("|"))])

        odd = per_line(np.flatnonzero(kind & _ODD)) + 3 * per_line(np.flatnonzero(kind & _ALONE))
        odd = (odd - (begin - first) * quoted) / np.maximum(size, 1)
        tail = pad[last]
        sentence_end = ((kind & _STOP) > 0) & blank_after
        ends_inside = per_line(np.flatnonzero(sentence_end)) > 0
        upper_first = full & ((self.reader.classes[pad[first]] & _UPPER) > 0)
        upper_rest = full & ((self.reader.classes[pad[np.minimum(rest, last)]] & _UPPER) > 0)
        has_upper = np.bincount(doc[of[np.flatnonzero(kind & _UPPER)]], minlength=len(texts)) > 0

        # Words: known ones, their variety and order.
        words = self.reader.words(points, kind, of)
        line = words.line
        n = np.bincount(line, minlength=n_lines)
        plain = ~words.code
        seen = self.texts[words.slot] > 1  # besides the text itself
        letters = np.bincount(line, plain, n_lines)
        known = np.divide(np.bincount(line, seen & plain, n_lines), letters, out=np.zeros(n_lines), where=letters > 0)
        codes = np.divide(n - letters, n, out=np.ones(n_lines), where=n > 0)
        singles = np.bincount(line, words.single & plain, n_lines)
        kinds = np.bincount(_distinct(line << 32 | (words.hash >> np.uint64(32)).astype(np.int64)) >> 32, minlength=n_lines)
        order, compared = self._order(words, seen, doc, n_lines)

        phrases = self._phrases(doc, start, end, full, upper_first, ends_inside, n, has_upper, words)
        traits = [
            self._pick((quoted, "quoted"), (bullet, "bullet"), (indent, "indent"), (True, "plain")),
            self._pick(((cells >= 2) & (cells * 40 >= size), "cells-many"), (cells * 60 >= size, "cells-some"), (True, "cells-none")),
            self._pick((known >= 0.85, "known-high"), (known >= 0.55, "known-mid"), (True, "known-low")),
            self._pick((compared < 3, "order-none"), (order > 1.2, "order-high"), (order > 0.6, "order-mid"), (True, "order-low")),
            self._pick((odd < 0.05, "symbols-low"), (odd < 0.15, "symbols-mid"), (True, "symbols-high")),
            self._pick(((n >= 8) & (kinds < np.maximum(3, np.minimum(0.3 * n, 25))) | (n >= 3) & (n < 8) & (kinds == 1), "variety-low"), (n >= 8, "variety-high"), (True, "")),
            self._pick((codes < 0.25, "codes-low"), (codes < 0.45, "codes-mid"), (True, "codes-high")),
            self._pick(((n >= 6) & (singles >= 0.6 * n), "letters-apart"), (True, "letters-joined")),
            self._pick((n < 5, "words-few"), (n < 12, "words-some"), (True, "words-many")),
            self._pick((record, "form-record"), (True, "form-free")),
            self._pick((np.isin(tail, [ord(c) for c in ".!?…"]), "end-full"), (np.isin(tail, [ord(","), ord(";")]), "end-half"), (True, "end-open")),
            self._pick(
                ((bullet | indent | phrases) & upper_rest & np.isin(tail, [ord(c) for c in ".!?"]) & (n >= 7), "item-sentence"), (bullet | indent | phrases, "item-phrase"), (True, "item-no")
            ),
            self._pick((self._again(points, doc, start, end, full, len(texts)), "again-yes"), (True, "again-no")),
        ]
        use = np.flatnonzero(full)
        return doc[use], (end - start)[use], np.stack(traits, axis=1)[use].astype(np.uint8)

    def _again(self, points: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, full: np.ndarray, n_docs: int) -> np.ndarray:
        """Lines of texts of which a third or less of the lines are different."""
        power = self.reader._powers(len(points) + 1)
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[0, : len(points)], dtype=np.uint64)])
        use = np.flatnonzero(full)
        h = _mix((run[end[use]] - run[start[use]]) * power[1, start[use]])
        order = np.lexsort((h, doc[use]))
        h, d = h[order], doc[use][order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, dtype=bool)
        kinds, lines = np.bincount(d[new], minlength=n_docs), np.bincount(d, minlength=n_docs)
        return (kinds <= 0.34 * lines)[doc] & full

    def _order(self, words: Words, seen: np.ndarray, doc: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Per line the mean log-ratio of its word pairs to their reverses in other texts, and the number of pairs.

        In prose a pair of neighbours is far more frequent than its reverse; words without order have no direction.
        """
        at, pair, turned = words.pairs()
        line = words.line
        d = doc[line[at]]
        own, place, times = np.unique(d * PAIRS + pair, return_inverse=True, return_counts=True)
        back = d * PAIRS + turned
        spot = np.minimum(np.searchsorted(own, back), max(0, len(own) - 1))
        own_back = np.where(own[spot] == back, times[spot], 0) if len(own) else np.zeros(0, dtype=np.int64)
        ok = seen[at] & seen[at + 1] & (pair != turned)
        there, back = np.maximum(self.pairs[pair] - times[place], 0), np.maximum(self.pairs[turned] - own_back, 0)
        gain = np.clip(np.log((there + 0.5) / (back + 0.5)), -3, 3)
        on = line[at][ok]
        count = np.bincount(on, minlength=n_lines)
        return np.divide(np.bincount(on, gain[ok], n_lines), count, out=np.zeros(n_lines), where=count > 0), count

    def _phrases(self, doc, start, end, full, upper, ends, n, has_upper, words) -> np.ndarray:
        """Lines of a block (of three or more lines) without a sentence: no line begins with a capital or ends one, and where
        the text has no capitals at all, most lines begin with the same word."""
        same = np.r_[False, (doc[1:] == doc[:-1]) & full[1:] & full[:-1]]
        block = np.cumsum(~same) - 1
        of_block = lambda x: np.bincount(block, x & full)
        count = np.bincount(block, full)
        fit = (count >= 3) & (of_block(upper) == 0) & (of_block(ends) == 0) & (of_block(n > 14) == 0)
        out = fit[block] & full
        lower = out & ~has_upper[doc]
        if lower.any():
            head = np.zeros(len(full), dtype=np.uint64)
            head[words.line[::-1]] = words.hash[::-1]
            for b in np.unique(block[lower]).tolist():
                at = np.flatnonzero((block == b) & full)
                if np.unique(head[at], return_counts=True)[1].max() < 0.6 * len(at):
                    out[at] = False
        return out


def viterbi(score: np.ndarray, doc: np.ndarray, first: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """The most likely labels of lines (log-likelihoods: lines x labels), text by text; all texts go on at once, line by line."""
    if not len(score):
        return np.zeros(0, dtype=np.int64)
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[head, len(doc)])
    order = np.argsort(-size, kind="stable")
    head, size = head[order], size[order]
    back = np.zeros(score.shape, dtype=np.int8)
    best = first + score[head]
    ends = np.empty(len(head), dtype=np.int64)
    active = len(head)
    for i in range(1, int(size[0]) + 1):
        left = int(np.searchsorted(-size, -i, side="left"))  # texts of more than i lines
        ends[left:active] = best[left:active].argmax(axis=1)
        active = left
        if not active:
            break
        via = best[:active, :, None] + nxt
        at = head[:active] + i
        back[at] = via.argmax(axis=1)
        best = via.max(axis=1) + score[at]
    out = np.empty(len(score), dtype=np.int64)
    state = ends.copy()
    for i in range(int(size[0]) - 1, -1, -1):
        active = int(np.searchsorted(-size, -i, side="left"))  # texts that have line i
        at = head[:active] + i
        out[at] = state[:active]
        state[:active] = back[at, state[:active]]
    return out


def expectations(score: np.ndarray, weight: np.ndarray, doc: np.ndarray, traits: np.ndarray, tables: Tables) -> np.ndarray:
    """Expected counts of traits, first labels and steps (one after another, flat) over the texts, by the forward-backward algorithm.

    All texts go on at once, line by line; each line counts by its weight.
    """
    k = len(LABELS)
    emitted, firsts, steps = np.zeros((NOTHING + 1, k)), np.zeros(k), np.zeros((k, k))
    if len(score):
        like = np.exp(score - score.max(axis=1, keepdims=True))
        move = np.exp(tables.next)
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.r_[head, len(doc)])
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        longest = int(size[0])
        longer = [int(np.searchsorted(-size, -i, side="left")) for i in range(longest)]  # texts that have line i
        ahead = np.empty(score.shape)
        ahead[head] = _share(np.exp(tables.first) * like[head])
        for i in range(1, longest):
            at = head[: longer[i]] + i
            ahead[at] = _share((ahead[at - 1] @ move) * like[at])
        behind = np.ones(score.shape)
        for i in range(longest - 1, 0, -1):
            at = head[: longer[i]] + i
            back = like[at] * behind[at]
            behind[at - 1] = _share(back @ move.T)
            both = ahead[at - 1][:, :, None] * move * back[:, None, :]
            steps += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        posterior = _share(ahead * behind)
        firsts = posterior[head].sum(axis=0)
        for f in range(traits.shape[1]):
            for c in range(k):
                emitted[:, c] += np.bincount(traits[:, f], posterior[:, c] * weight, NOTHING + 1)
    return np.concatenate([emitted[:NOTHING].ravel(), firsts, steps.ravel()])


def _share(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)


def refit(counts: np.ndarray, hold: float) -> Tables:
    """Tables from expected counts, mixed with the starting ones by the share ``hold``; a label or family without counts keeps those."""
    k, start = len(LABELS), start_tables()
    emitted, firsts, steps = counts[: NOTHING * k].reshape(NOTHING, k), counts[NOTHING * k : NOTHING * k + k], counts[NOTHING * k + k :].reshape(k, k)

    def mixed(new: np.ndarray, total: np.ndarray, old: np.ndarray) -> np.ndarray:
        fresh = np.divide(new, total, out=np.exp(old), where=total > 0)
        return np.log(hold * np.exp(old) + (1 - hold) * fresh)

    total = np.stack([emitted[FAMILY == f].sum(axis=0) for f in range(len(START))])[FAMILY]
    emission = mixed(emitted, total, start.emission)
    return Tables(emission, mixed(firsts, np.full(k, firsts.sum()), start.first), mixed(steps, np.repeat(steps.sum(axis=1, keepdims=True), k, axis=1), start.next))


def line_traits(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: ``<doc_id>, lengths, traits``, a length and a trait of each family for each line, packed; written to the shared folder."""
    counts = word_counts(docs, text)
    # Fixed in size: WORDS + PAIRS numbers, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(c.astype(np.int32) if c.size and c.max() < 2**31 else c for c in counts))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = _spread(docs.select(F.col(doc_id), F.col(text).alias("__text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader(*(c.astype(np.int64) for c in shared.value))
        for b in batches:
            lengths, traits = [b""] * b.num_rows, [b""] * b.num_rows
            for where, held in _chunks(b["__text"].to_pylist()):
                doc, length, trait = reader.traits(held)
                length = length.astype(np.int32)
                cut = np.searchsorted(doc, np.arange(len(held) + 1)).tolist()
                for i, a, z in zip(where, cut[:-1], cut[1:], strict=True):
                    lengths[i], traits[i] = length[a:z].tobytes(), trait[a:z].tobytes()
            yield pa.RecordBatch.from_arrays([b[doc_id], pa.array(lengths, pa.binary()), pa.array(traits, pa.binary())], names=[doc_id, "lengths", "traits"])

    return stage(rows.mapInArrow(read, f"`{doc_id}` {kind}, lengths binary, traits binary"), "traits")


def _lines(b: pa.RecordBatch, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, length, weight, traits, score) of the lines of a batch of ``line_traits``; a line weighs as much as the lines it would be wrapped into."""
    length = np.frombuffer(b"".join(b["lengths"].to_pylist()), dtype=np.int32)
    traits = np.frombuffer(b"".join(b["traits"].to_pylist()), dtype=np.uint8).reshape(-1, len(START))
    doc = np.repeat(np.arange(b.num_rows), np.array([len(x) // 4 for x in b["lengths"].to_pylist()], dtype=np.int64))
    weight = np.maximum(length / 80, 1.0)
    return doc, length, weight, traits, tables.scores(traits, weight)


def fit_tables(traits: DataFrame, rounds: int = 3, hold: float = 0.5) -> Tables:
    """Fit the model to unlabelled lines by expectation and maximisation, over all documents, from the starting tables.

    ``hold`` is the share of the starting tables in those of every round, at every size of the data: they say what the labels mean.
    """
    tables = start_tables()
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], tables: Tables = tables) -> Iterator[pa.RecordBatch]:
            total = np.zeros(NOTHING * len(LABELS) + len(LABELS) + len(LABELS) ** 2)
            for b in batches:
                doc, _, weight, t, score = _lines(b, tables)
                total += expectations(score, weight, doc, t, tables)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

        got = traits.mapInArrow(expect, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()  # some hundred numbers
        counts = np.zeros(NOTHING * len(LABELS) + len(LABELS) + len(LABELS) ** 2)
        for r in got:
            counts[r.at] = r.n
        tables = refit(counts, hold)
    return tables


def line_shares(docs: DataFrame, doc_id: str, text: str, tables: Tables | None = None) -> DataFrame:
    """Per document the shares of its characters in prose, list, table and junk lines: ``<doc_id>, lines, prose, list, table, junk``.

    Lines are labelled together by a hidden Markov model over line statistics, whose tables are fitted to these documents without labels
    (``fit_tables``) unless they are given. Two of the statistics, whether words are known and whether
    they stand in their usual order, come from counts over all documents (equal texts once, a document's own
    counts taken off). Blank lines don't count. A null, empty or blank text has no lines and shares of 0.
    Whole texts are read, of any length. One row per input row; null ids are kept; an empty table gives none.
    """
    traits = line_traits(docs, doc_id, text)
    model = tables or fit_tables(traits)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, length, _, _, score = _lines(b, model)
            share = np.zeros((b.num_rows, len(LABELS)))
            np.add.at(share, (doc, viterbi(score, doc, model.first, model.next)), length)
            total = share.sum(axis=1, keepdims=True)
            share = np.divide(share, total, out=share, where=total > 0)
            lines = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b[doc_id], pa.array(lines), *(pa.array(share[:, k]) for k in range(len(LABELS)))], names=[doc_id, "lines", *LABELS])

    return traits.mapInArrow(run, f"`{doc_id}` {kind}, lines bigint, prose double, list double, table double, junk double")


_TOKEN = r"[\p{L}\p{N}]+"


def text_statistics(docs: DataFrame, doc_id: str, text: str, lang: str, common: DataFrame, most: int = 100_000) -> DataFrame:
    """Counts per document: ``<doc_id>, chars, words, word_length, symbol_ratio, lines, full_lines, common``.

    Words are runs of letters and digits of any script; ``symbol_ratio`` is the share of characters that are neither these nor blanks or
    line breaks; ``full_lines`` the share of lines (not blank) that end in . ! or ?; ``common`` the share of words
    among the frequent words of the document's language (case and blanks of its label don't matter), or of all languages where the label is null or
    has no words in ``common`` (``lang, word``, a fixed list: more than ``most`` words are refused). Ratios without anything to
    count are null. A null text counts as empty. All in the JVM.
    """
    rows = common.select(label("lang").alias("l"), F.lower("word").alias("w")).filter(F.col("w").isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"common: at most {most} words")
    by_lang: dict[str, list[str]] = {}
    for r in rows:
        by_lang.setdefault(r.l or "", []).append(r.w)
    t = F.coalesce(F.col(text), F.lit(""))
    x = docs.select(F.col(doc_id), t.alias("t"), label(lang).alias("__lang")).withColumn("w", F.regexp_extract_all("t", F.lit(_TOKEN), F.lit(0)))
    x = x.withColumn("l", F.filter(F.split("t", "\n"), lambda s: F.trim(s) != ""))
    ratio: Callable[[Column, Column], Column] = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    size = F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w))

    def among(ws: list[str]) -> Column:
        table = F.create_map(*[y for w in sorted(ws) for y in (F.lit(w), F.lit(True))]) if ws else None
        return F.size(F.filter("w", lambda w: F.coalesce(F.map_contains_key(table, F.lower(w)), F.lit(False)))) if ws else F.lit(0)

    frequent = F.lit(None).cast("int")
    for name, ws in sorted(by_lang.items()):
        frequent = F.when(F.col("__lang") == name, among(ws)).otherwise(frequent)
    frequent = F.coalesce(frequent, among(sorted({w for ws in by_lang.values() for w in ws})))
    return x.select(
        doc_id, F.length("t").cast("bigint").alias("chars"), F.size("w").cast("bigint").alias("words"), F.round(ratio(size, F.size("w")), 6).alias("word_length"),
        F.round(ratio(F.length(F.regexp_replace("t", "[\\p{L}\\p{N} \\t\\n\\r]", "")), F.length("t")), 6).alias("symbol_ratio"),
        F.size("l").cast("bigint").alias("lines"), F.round(ratio(F.size(F.filter("l", lambda s: F.rtrim(s).rlike("[.!?]$"))), F.size("l")), 6).alias("full_lines"),
        F.round(ratio(frequent, F.size("w")), 6).alias("common"),
    )
