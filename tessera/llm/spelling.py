"""Spelling variants: each word's most frequent word within one edit.

The vocabulary is counted with DataFrame functions.  Two words at one edit agree in
their first half or in their last half (cut at half the shorter one's length), so
the vocabulary is dealt by length and half: every near pair meets in exactly one
place.  There a bit-sliced position index holds, for each (position, letter), the
set of words with that letter at that position, one bit a word.  A word is looked
up letter by letter; recurrences on whole sets keep the words that agree so far
without an error, and those that do with one, whose positions are shifted by one
after an inserted or deleted letter.  All words of a set advance at once.

A half that very many words share is divided: its words are dealt into parts, and
each of them is looked up in every part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, table

#: Entries of one place of the index on average, and the most words of one half in it.
PLACE, PART = 1024, 2048

#: Numbers (64 bits each) that one step of the recurrences handles at once.
STEP = 1 << 17

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOUND = "word string, n_near long, best_n long, best string"


def occurrences(docs: DataFrame, letters: int = 5, damage: int = 97) -> DataFrame:
    """(word): one row per run of at least ``letters`` letters, lower-cased A-Z; a run
    whose checksum with its doc_id is a multiple of ``damage`` has lost one letter, and
    is null if too few are left."""
    found = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{max(1, letters)},}}"), F.lit(0))
    runs = documents(docs).select("doc_id", F.explode(found).alias("run"))
    # translate makes objects of every letter, so it is kept to the runs that need it
    small = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    low = runs.select("doc_id", small.alias("low"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "low"))
    k = (h % F.length("low")).cast("int")
    cut = F.concat(F.substr("low", F.lit(1), k), F.substr("low", k + 2, F.length("low")))
    return low.select(F.when(h % damage != 0, F.col("low")).when(F.length("low") > letters, cut).alias("word"))


def vocabulary(docs: DataFrame, least: int = 3, letters: int = 5, damage: int = 97) -> DataFrame:
    """(word, n): words of at least ``letters`` code points and ``least`` occurrences."""
    # nulls are counted, not filtered: a filter on words would compute each of them anew
    return occurrences(docs, letters, damage).groupBy("word").agg(F.count("word").alias("n")).filter(F.col("n") >= max(least, 1))


# -- the index of one place ----------------------------------------------------


def _points(words: np.ndarray, width: int) -> np.ndarray:
    """Code points of the words, a row each, filled up with zeros."""
    return np.ascontiguousarray(words.astype(f"U{width}")).view(np.uint32).reshape(len(words), width).astype(np.int64)


class BitSlices:
    """Sets of words by (position, letter), for words of ``c`` and ``c + 1`` letters.

    Words are numbered in the order given; bit i of a set is word i.
    """

    def __init__(self, points: np.ndarray, c: int):
        n = len(points)
        self.c, self.wide = c, -(-n // 64)
        row, at = np.nonzero(points)
        codes, which = np.unique(at * 65536 + points[row, at], return_inverse=True)
        self.codes = codes
        self.sets = np.zeros((len(codes) + 1, self.wide), np.uint64)  # the last is empty
        bit = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
        np.bitwise_or.at(self.sets, (which, row // 64), bit[row])
        self.short, self.long = np.zeros(self.wide, np.uint64), np.zeros(self.wide, np.uint64)
        long = points[:, c] != 0
        for into, mine in ((self.short, ~long), (self.long, long)):
            i = np.flatnonzero(mine)
            np.bitwise_or.at(into, i // 64, bit[i])

    def at(self, position: int, letter: np.ndarray) -> np.ndarray:
        """The sets of words with these letters at ``position``, one row a letter."""
        code = position * 65536 + letter
        k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return self.sets[np.where(self.codes[k] == code, k, len(self.codes))]

    def near(self, points: np.ndarray, same_start: bool) -> np.ndarray:
        """For words of one length (``c`` or ``c + 1``), the set of words at one edit;
        of two words with ``c + 1`` letters neither is in the other's set.

        same_start: only words with the same first half, else only others."""
        c, h = self.c, self.c // 2
        m = int(np.count_nonzero(points[0]))
        none = np.full((len(points), self.wide), np.uint64(0xFFFFFFFFFFFFFFFF))
        one = np.zeros_like(none)  # a replaced letter: positions as they were
        moved = np.zeros_like(none)  # an inserted (m = c) or deleted (m = c + 1) letter: shifted by one
        start = none
        for i in range(m):
            letter = points[:, i]
            here = self.at(i, letter)
            if m == c:
                moved = (moved | none) & self.at(i + 1, letter)
                one = (one & here) | (none & ~here)
            else:
                moved = (moved & self.at(i - 1, letter)) | none if i else none
            none = none & here
            if i + 1 == h:
                start = none
        out = (one & self.short) | ((moved | none) & self.long) if m == c else moved & self.short
        return out & start if same_start else out & ~start


def _looked_up(word: np.ndarray, n: np.ndarray, member: np.ndarray, c: int, same_start: bool):
    """(rows, near words, row of the best) of the words, in code-point order, that have near ones."""
    points = _points(word, c + 1)
    inside = np.flatnonzero(member)
    order = inside[np.argsort(-n[inside], kind="stable")]  # by n, then in code-point order: the first bit is the best
    if not len(order):
        return
    index = BitSlices(points[order], c)
    length = np.count_nonzero(points, axis=1)
    for m in (c, c + 1):
        asked = np.flatnonzero(length == m)
        step = max(1, STEP // index.wide)
        for lo in range(0, len(asked), step):
            rows = asked[lo : lo + step]
            found = index.near(points[rows], same_start)
            some = found.any(axis=1)
            rows, found = rows[some], found[some]
            if len(rows):
                first = (found != 0).argmax(axis=1)
                x = found[np.arange(len(rows)), first]
                bit = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                yield rows, np.bitwise_count(found).sum(axis=1).astype(np.int64), order[first * 64 + bit]


def _place(t: pa.Table) -> pa.Table:
    """Near words within one place, class by class (length, and which half is shared)."""
    c, same = np.array(t.column("c")), np.array(t.column("same_start"))
    kind = c.astype(np.int64) * 2 + same
    text = t.column("word").to_numpy(zero_copy_only=False)
    n, member = np.array(t.column("n")), np.array(t.column("member"))
    out: list[tuple] = []
    for k in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == k)
        # a word divided among parts that meet here again is looked up once
        word, first, again = np.unique(text[rows], return_index=True, return_inverse=True)
        if len(word) < 2:
            continue
        mine = np.zeros(len(word), bool)
        np.logical_or.at(mine, again, member[rows])
        size = n[rows][first]
        for i, count, best in _looked_up(word, size, mine, k // 2, bool(k % 2)) or ():
            out += zip(word[i].tolist(), count.tolist(), size[best].tolist(), word[best].tolist(), strict=True)
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def _entries(words: DataFrame) -> DataFrame:
    """A word's up to four halves: as the shorter or the longer of a pair, first or last half."""

    def half(c: Column, same_start: bool) -> Column:
        h = F.floor(c / 2).cast("int")
        text = F.substr("word", F.lit(1), h) if same_start else F.substr("word", F.length("word") - (c - h) + 1, c - h)
        return F.struct(c.cast("int").alias("c"), F.lit(same_start).alias("same_start"), text.alias("half"))

    own = F.length("word")
    halves = F.array(half(own, True), half(own, False), half(own - 1, True), half(own - 1, False))
    return words.select("word", "n", F.explode(halves).alias("h")).select("word", "n", "h.*").filter("c >= 1")


def near_words(words: DataFrame, rows: int) -> DataFrame:
    """(word, n_near, best_n, best) of words that have others at one edit, exactly.

    words: word, n, no word twice; rows: their number."""
    entries = _entries(words)
    key = ["c", "same_start", "half"]
    crowded = entries.groupBy(*key).agg(F.count("*").alias("_size")).filter(F.col("_size") > PART).select(*key, F.ceil(F.col("_size") / PART).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = entries.join(crowded, key, "left").select(*entries.columns, parts.alias("_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    member = F.col("_part") == F.pmod(F.xxhash64("word"), F.col("_parts"))
    place = F.pmod(F.xxhash64(*key, "_part"), F.lit(max(1, -(-4 * rows // PLACE))))
    found = dealt.select("word", "n", "c", "same_start", member.alias("member"), place.alias("place")).groupBy("place").applyInArrow(_place, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _ends(spark: SparkSession, forms: DataFrame, longest: float) -> DataFrame:
    """(word, root): where the chain of forms that starts at the word ends.

    forms: word and, as root, its form; no chain has more than ``longest`` steps.
    Only the words of chains that go on for 2, 4, 8, .. steps are written, with the
    word so many steps on; such steps, the longest first, then make up any chain."""

    def on(steps: DataFrame) -> DataFrame:
        return steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))

    met = F.col("root") == F.col("_word")
    ahead = [forms]  # [k]: 2**k steps on
    while 2 ** len(ahead) <= longest:
        twice = ahead[-1].join(on(ahead[-1]), met).select("word", F.col("_root").alias("root"))
        ahead.append(table(spark, twice, "ahead"))
        if ahead[-1].isEmpty():
            ahead.pop()
            break
    for steps in reversed(ahead):
        forms = forms.join(on(steps), met, "left").select("word", F.coalesce("_root", "root").alias("root"))
    return forms


def variant_groups(spark: SparkSession, docs: DataFrame, least: int = 3, letters: int = 5, factor: int = 2, damage: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word's normal spelling.

    docs: doc_id, text.  form: of the words at one inserted, deleted or replaced code
    point the one with the largest n (ties: the smaller in code-point order), if that
    is at least ``factor`` (2 or more) times the word's own, else null; root: the end of
    the chain of forms; n_near: all words at one edit.  Null texts have no words; a null
    doc_id counts as an empty one; repeated rows count each; further columns do not
    matter; empty tables and tables without frequent words give no rows.  Words of any
    length take part.
    """
    words = table(spark, vocabulary(docs, least, letters, damage), "spellings")
    rows, most = words.agg(F.count("*"), F.max("n")).first()
    near = near_words(words, rows)
    is_form = F.col("best_n") >= factor * F.col("n")
    form, form_n = (F.when(is_form, F.col(c)) for c in ("best", "best_n"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), form_n.alias("form_n"))
    out = table(spark, out, "forms")
    # a form is ``factor`` times as frequent, so chains are short
    longest = math.log((most or least) / least, factor) if least > 0 else 64
    roots = _ends(spark, out.filter("form is not null").select("word", F.col("form").alias("root")), longest + 1e-9)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
