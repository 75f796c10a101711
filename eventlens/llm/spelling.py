"""Spelling variants: words one edit apart, found through a variable-length gram index.

Words are counted over all texts. Two words are near if one code point inserted, deleted or replaced turns one into
the other. Words stand between ``^`` and ``$``, and a gram starts at each place but the last:

1. **Gram dictionary.** Level by level from ``shortest`` letters on, grams are counted over all words, and only
   those in more than a threshold of places are kept and extended further. The threshold is ``rare`` or the
   total over ``kept``, so a level keeps less than ``kept`` grams, however many words there are.
2. **Decomposition.** From each place the gram grows until the dictionary does not hold it, or it is half as long
   as the padded word, or the word ends. Grams inside other grams are kept: so a gram depends on its own
   characters alone, and an edit changes exactly those grams that it lies in.
3. **Bound.** ``affected`` is the largest number of grams of a word that one edit can lie in. A near word has all
   the others, at the same place from the start or from the end. So the two meet in one of the ``affected`` + 1
   rarest lists of each, in any order of grams that both follow, and only these are merged. Words have at least
   one gram more than an edit can lie in (``bound``), so no word is left out.
4. **Lists** are keyed by gram, place and length of the longer word: a word is in the lists of its own length, and
   asks in those of words one letter longer. A list of a gram outside of the dictionary holds no more than the
   threshold; longer ones, of kept grams, are counted and cut into blocks, each pair of blocks a task of its own.
5. **Verification** compares whole words, 8 letters at a time.

Defined results: a null text has no words; a null id counts as an empty one; repeated rows count again; equal counts
go to the word that is smallest in code-point order; an empty table has no words; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written

#: Letters of a word: fixed by the task. Every one of them is a single byte in Latin-1.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Variants:
    """``ratio``: how many times as frequent a form is; ``spoil``: every ``spoil``-th occurrence by crc32 loses a letter (0: none)."""

    min_length: int = 7
    min_count: int = 2
    ratio: int = 10
    spoil: int = 31
    shortest: int = 2
    longest: int = 8
    rare: int = 64
    kept: int = 1 << 16
    block: int = 4096

    def __post_init__(self) -> None:
        if self.min_length < 2 or self.shortest < 2:
            raise ValueError("words and grams of a single letter have no bound")


def word_counts(docs: DataFrame, conf: Variants = Variants()) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))
    found = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.filter(runs, lambda r: F.length(r) >= conf.min_length)).alias("_run"),
    )
    run, word = F.col("_run"), F.col("_run")
    if conf.spoil:
        h = F.crc32(F.concat("_id", F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
        word = F.when(h % conf.spoil == 0, less).otherwise(run)
    counted = found.select(word.alias("word")).filter(F.length("word") >= conf.min_length)
    return counted.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= conf.min_count)


def dictionary(words: DataFrame, conf: Variants = Variants()) -> tuple[dict[str, int], int]:
    """Kept grams with the number of their places, and the threshold."""
    padded = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("_w"))
    total = padded.agg(F.sum(F.length("_w"))).first()[0] or 0
    threshold = max(conf.rare, total // conf.kept)
    kept: dict[str, int] = {}
    level = None
    for q in range(conf.shortest, conf.longest + 1):
        # Words shorter than the gram have no place for it.
        cut = F.expr(f"transform(sequence(1, length(_w) - {q - 1}), k -> substring(_w, k, {q}))")
        grams = padded.filter(F.length("_w") >= q).select(F.explode(cut).alias("gram"))
        if level is not None:
            # At most ``kept`` rows: each stands for more than total / kept places.
            shorter = words.sparkSession.createDataFrame([(g,) for g in level], "_shorter string")
            grams = grams.join(F.broadcast(shorter), F.substring("gram", 1, q - 1) == F.col("_shorter"), "left_semi")
        counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > threshold)
        level = {r.gram: r.n for r in counted.collect()}
        kept.update(level)
        if not level:
            break
    return kept, threshold


def grams(word: str, kept: dict[str, int], shortest: int, longest: int) -> list[tuple[int, str]]:
    """(place, gram) for each place of the padded word."""
    s = f"^{word}$"
    out = []
    for start in range(len(s) - shortest + 1):
        end = start + shortest
        while end < len(s) and end - start < longest and s[start:end] in kept:
            end += 1
        out.append((start, s[start:end]))
    return out


def affected(found: list[tuple[int, str]]) -> int:
    """The largest number of grams that hold one and the same character: a replaced or deleted character changes
    those that hold it, an inserted one those that hold both its neighbours."""
    change: dict[int, int] = {}
    for start, gram in found:
        change[start] = change.get(start, 0) + 1
        change[start + len(gram)] = change.get(start + len(gram), 0) - 1
    most = now = 0
    for at in sorted(change):
        now += change[at]
        most = max(most, now)
    return most


def bound(found: list[tuple[int, str]]) -> int:
    """How many grams a near word has at least in common."""
    return len(found) - affected(found)


def merged_lists(word: str, family: int, kept: dict[str, int], conf: Variants) -> list[tuple[int, str]]:
    """The lists that have to be merged for the pairs whose longer word has ``family`` letters."""
    found = grams(word, kept, conf.shortest, max(conf.shortest, min(conf.longest, (family + 2) // 2)))
    found.sort(key=lambda g: (kept.get(g[1], 0), g[1], g[0]))
    return found[: affected(found) + 1]


def _listed(kept: dict[str, int], conf: Variants):
    names = ["word", "gram", "place", "family", "own", "frequent"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column("word").to_pylist():
                n = len(word)
                rows += [(word, g, at, n, True, g in kept) for at, g in merged_lists(word, n, kept, conf)]
                # Behind the letter that the longer word has more, places are one further on.
                for at, g in merged_lists(word, n + 1, kept, conf):
                    rows += [(word, g, at, n + 1, False, g in kept), (word, g, at + 1, n + 1, False, g in kept)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return work


def _cells(rows: DataFrame, conf: Variants, name: str) -> DataFrame:
    """Rows with (cell, part): lists longer than a block are dealt over cells, one for each two of their parts."""
    sizes = rows.filter("frequent").groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > conf.block)
    long = written(sizes.select("key", F.ceil(F.col("_n") / conf.block).cast("int").alias("_parts")), f"{name}-long")
    dealt = rows.join(long, "key", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    dealt = dealt.withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    cells = dealt.select("key", "word", "own", "part", "_parts", other.alias("_other"))
    return cells.select("key", "word", "own", "part", (F.least("part", "_other") * F.col("_parts") + F.greatest("part", "_other")).alias("cell"))


def near_pairs(words: DataFrame, conf: Variants = Variants(), name: str = "spelling") -> DataFrame:
    """(a, b), each pair of near words once."""
    kept, _ = dictionary(words, conf)
    rows = words.select("word").mapInArrow(_listed(kept, conf), "word string, gram string, place int, family int, own boolean, frequent boolean")
    rows = written(rows.select("word", F.xxhash64("gram", "place", "family").alias("key"), "own", "frequent"), f"{name}-lists")
    cells = _cells(rows, conf, name)
    order = ["key", "cell"]
    met = cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verified, "a string, b string")
    return met.distinct()


def _lanes(words: list[bytes], size: int) -> np.ndarray:
    """Words of ``size`` letters or fewer as rows of unsigned 8-byte integers, first letter lowest."""
    wide = -(-size // 8) * 8
    return np.array(words, f"S{wide}").view(np.uint8).reshape(len(words), wide).view("<u8")


def _touched(x: np.ndarray) -> np.ndarray:
    """1 in each byte that is not 0."""
    x = x | (x >> np.uint64(4))
    x = x | (x >> np.uint64(2))
    x = x | (x >> np.uint64(1))
    return x & np.uint64(0x0101010101010101)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equally long words that differ in exactly one letter."""
    return np.bitwise_count(_touched(a ^ b)).sum(axis=-1, dtype=np.int64) == 1


def inserted(longer: np.ndarray, rest: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Rows whose longer word is the shorter one and one letter more. ``rest`` is the longer word without its first
    letter: from the first place where the two differ, it must go on like the shorter one. A place past the
    shorter word's end always differs, and there ``rest`` has ended too."""
    differs, goes_on = longer ^ shorter, rest ^ shorter
    before = np.ones(differs.shape[:-1], bool)  # nothing has differed so far
    good = np.ones(differs.shape[:-1], bool)
    for lane in range(differs.shape[-1]):
        flag = _touched(differs[..., lane])
        low = flag & (~flag + np.uint64(1))
        mask = np.where(before, ~(low - np.uint64(1)), ~np.uint64(0))  # no difference: low is 0, the mask too
        good &= (goes_on[..., lane] & mask) == 0
        before &= flag == 0
    return good


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _whole_lists(batches):
        text = rows.column("word").to_pylist()
        word = [w.encode("latin-1") for w in text]
        size = np.fromiter(map(len, word), np.int64, len(word))
        own = rows.column("own").to_numpy(zero_copy_only=False)
        part, cell = rows.column("part").to_numpy(), rows.column("cell").to_numpy()
        key = rows.column("key").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))
        end = np.append(start[1:], len(key))
        many = np.flatnonzero(end - start > 1)
        # All lists of one family at a time. A hash that two lists share only adds comparisons.
        family = np.maximum.reduceat(size + ~own, start)
        for n in np.unique(family[many]):
            lists = many[family[many] == n]
            at = np.concatenate([np.arange(s, e) for s, e in zip(start[lists], end[lists], strict=True)])
            inside = np.repeat(np.arange(len(lists)), (end - start)[lists])
            lane = _lanes([word[k] for k in at], int(n))
            rest = _lanes([word[k][1:] for k in at], int(n))
            yield from _pairs(at, inside, lane, rest, own[at], size[at], part[at], text, int(n))


def _pairs(at, inside, lane, rest, own, size, part, text, n) -> Iterator[pa.RecordBatch]:
    """Every own word of a list with the words after it, and with those that ask."""
    order = np.lexsort((~own, inside))
    at, inside, lane, rest, own, size, part = (x[order] for x in (at, inside, lane, rest, own, size, part))
    last = np.searchsorted(inside, inside, side="right")
    mine = np.arange(len(at))
    count = np.where(own, last - mine - 1, 0)
    # Parts of a cell that deals with two of them are compared with each other only.
    two = np.maximum.reduceat(part, np.searchsorted(inside, np.arange(inside[-1] + 1)))
    two = two != np.minimum.reduceat(part, np.searchsorted(inside, np.arange(inside[-1] + 1)))
    total = np.concatenate(([0], np.cumsum(count)))
    for low, high in pairwise([*range(0, int(total[-1]), 1 << 18), int(total[-1])]):
        k = np.arange(low, high)
        x = np.searchsorted(total, k, side="right") - 1
        y = x + 1 + (k - total[x])
        asked = (part[x] != part[y]) | ~two[inside[x]]
        x, y = x[asked], y[asked]
        same, more = own[y] & (size[x] == n) & (size[y] == n), ~own[y] & (size[x] == n) & (size[y] == n - 1)
        near = np.zeros(len(x), bool)
        near[same] = replaced(lane[x[same]], lane[y[same]])
        near[more] = inserted(lane[x[more]], rest[x[more]], lane[y[more]])
        a, b = ([text[i] for i in at[z[near]]] for z in (x, y))
        yield pa.RecordBatch.from_arrays([pa.array(list(map(min, a, b)), pa.string()), pa.array(list(map(max, a, b)), pa.string())], ["a", "b"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of a sorted partition, cut where a list's cell ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        changed = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        last = int(changed[-1]) if len(changed) else 0
        if held:
            before = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("key", "cell")]
            if not len(changed) and before == [key[0], cell[0]]:
                held.append(batch)
                continue
        table = pa.Table.from_batches([*held, batch.slice(0, last)])
        if table.num_rows:
            yield table
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def variants(docs: DataFrame, conf: Variants = Variants(), name: str = "spelling") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    Along forms counts grow by ``ratio`` each time, so the way to the root is short: it is gone in doubled steps.
    """
    words = written(word_counts(docs, conf), f"{name}-words")
    pairs = written(near_pairs(words, conf, name), f"{name}-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    told = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("_n")), "b")
    best = told.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), "b")).alias("_best"))
    best = best.select("word", "n_near", (-F.col("_best.less")).alias("_form_n"), F.col("_best.b").alias("_form"))
    above: Column = F.col("_form_n") >= conf.ratio * F.col("n")
    whole = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(above, F.col("_form")).alias("form"), F.when(above, F.col("_form_n")).alias("form_n")
    )
    whole = written(whole, f"{name}-forms")
    moves = written(whole.filter("form is not null").select("word", F.col("form").alias("root")), f"{name}-moves")
    while True:
        onward = moves.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        further = written(moves.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), f"{name}-moves")
        moves = further.drop("_moved")
        if further.filter("_moved").isEmpty():
            break
    return whole.join(moves, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
