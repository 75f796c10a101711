"""License scans: short notices found with a bounded number of edits.

A notice is a row of words with a number of errors (characters inserted, deleted or replaced) that it may have. A text
is read as its words, in lower case, with single spaces between them. For each notice:

1. **Seeds.** The notice is split into errors + 1 pieces; by the pigeonhole principle every place with no more errors
   holds one of the pieces unchanged. All pieces of all notices are looked up at once (Aho-Corasick).
2. **Candidates.** A piece tells where the notice would begin, give or take the errors; only that window is looked at.
3. **Verification.** The ``regex`` library matches the notice with bounded errors from one word edge to another. Of all
   ends and begins that fit, the one with the fewest errors counts (then the first, then the shortest). Words that
   tell one license from another (``keys``: a version, a name) must be there unchanged, in their order.

A place without an error is a base place: the notice's words stand one after another. Spans give label, errors, the
first and last word (from 0), and the range of code points in the original text.

Defined results: a null text counts as empty; a text without words has no spans and score 0; whole texts of any length are
read, a window at a time; equal texts have equal spans; columns named like the results are replaced, others stay; an
empty table stays empty. It is a map, without a shuffle, whatever one source or group of copies holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventlens.llm.common import fields

#: Words, after A-Z are in lower case. Fixed by the task.
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Notice:
    """``base`` marks the phrases whose exact places are counted."""

    text: str
    label: str
    errors: int = 0
    keys: tuple[str, ...] = ()
    base: bool = False


#: Phrases, labels. Fixed by the task are the three base ones.
NOTICES = (
    Notice("under the mit license", "mit", 2, ("mit",), base=True),
    Notice("apache license version 2", "apache-2", 2, ("2",), base=True),
    Notice("cc by nc", "cc-by-nc", base=True),
    Notice("gnu general public license version 2", "gpl-2", 3, ("2",)),
    Notice("gnu general public license version 3", "gpl-3", 3, ("3",)),
    Notice("gnu lesser general public license", "lgpl", 3, ("lesser",)),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("permission is hereby granted free of charge", "mit", 4),
)

SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("errors", T.IntegerType()), T.StructField("base", T.BooleanType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("likeness", T.DoubleType()),
])
_SPAN = pa.struct([
    ("label", pa.string()), ("errors", pa.int32()), ("base", pa.bool_()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("likeness", pa.float64()),
])


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """(place, piece): the text in ``errors`` + 1 parts of nearly equal length."""
    edges = [len(text) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


@dataclass(frozen=True)
class Found:
    """A place in the text of words: ``[start, end)``."""

    start: int
    end: int
    errors: int


class Scanner:
    """All notices in one process."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            if notice.errors >= len(notice.text):
                raise ValueError(f"more errors than characters in {notice.text!r}")
            for at, piece in pieces(notice.text, notice.errors):
                seeds.setdefault(piece, []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        self.matches = [
            [regex.compile(f"(?:{regex.escape(n.text, literal_spaces=True)}){{e<={e}}}") for e in range(n.errors + 1)] for n in notices
        ]
        # Windows repeat: the same line of a license stands in many texts.
        self.verified = lru_cache(maxsize=1 << 16)(self._verified)

    def _verified(self, k: int, window: str, lead: int) -> Found | None:
        """Best place of notice ``k`` in a window. ``lead``: places up to which a match may begin."""
        notice = self.notices[k]
        begins = [b for b in range(min(lead, len(window))) if (b == 0 or window[b - 1] == " ") and window[b] != " "]
        ends = [e for e in range(1, len(window) + 1) if (e == len(window) or window[e] == " ") and window[e - 1] != " "]
        near = [
            (b, e) for b in begins for e in ends
            if abs(e - b - len(notice.text)) <= notice.errors and self._has_keys(window[b:e], notice.keys) and self.matches[k][-1].fullmatch(window, b, e)
        ]
        for errors, pattern in enumerate(self.matches[k] if near else ()):
            for b, e in near:
                if pattern.fullmatch(window, b, e):
                    return Found(b, e, errors)
        return None

    @staticmethod
    def _has_keys(text: str, keys: tuple[str, ...]) -> bool:
        words = iter(text.split(" "))
        return all(key in words for key in keys)

    def places(self, joined: str) -> Iterator[tuple[int, Found]]:
        """(notice, place) in a text of words joined by spaces; each place once, notice by notice in order."""
        wanted: dict[int, set[int]] = {}
        for last, (length, places) in self.seeds.iter(joined):
            for k, at in places:
                wanted.setdefault(k, set()).add(last + 1 - length - at)
        for k in sorted(wanted):
            notice = self.notices[k]
            known: dict[tuple[int, int], int] = {}
            for near in sorted(wanted[k]):
                # From a word's edge to a word's edge around all places that fit.
                low = max(0, near - notice.errors)
                high = min(len(joined), near + len(notice.text) + 2 * notice.errors + 1)
                if low and joined[low - 1] != " ":
                    low = joined.find(" ", low, high) + 1 or high
                if low >= high or low > near + notice.errors:
                    continue
                if high < len(joined) and joined[high] != " ":
                    high = max(low, joined.rfind(" ", low, high))
                found = self.verified(k, joined[low:high], near + notice.errors - low + 1)
                if found:
                    span = (low + found.start, low + found.end)
                    known[span] = min(found.errors, known.get(span, found.errors))
            yield from ((k, Found(*span, e)) for span, e in self._apart(known))

    @staticmethod
    def _apart(known: dict[tuple[int, int], int]) -> list[tuple[tuple[int, int], int]]:
        """Without inexact places that overlap a better one (then an earlier one). Exact places all stay."""
        kept: list[tuple[tuple[int, int], int]] = []
        last_end, inexact = 0, []
        exact = sorted(span for span, e in known.items() if not e)
        for span, e in sorted(known.items()):
            if not e:
                kept.append((span, e))
            else:
                inexact.append((span, e))
        # Only runs of places that overlap each other are looked at together.
        run: list[tuple[tuple[int, int], int]] = []
        for span, e in inexact:
            if run and span[0] >= last_end:
                kept += Scanner._greedy(run)
                run = []
            run.append((span, e))
            last_end = max(last_end, span[1]) if len(run) > 1 else span[1]
        kept += Scanner._greedy(run)
        out, at = [], 0
        for span, e in sorted(kept):
            while at < len(exact) and exact[at][1] <= span[0]:
                at += 1
            if not e or at == len(exact) or exact[at][0] >= span[1]:
                out.append((span, e))
        return out

    @staticmethod
    def _greedy(run: list[tuple[tuple[int, int], int]]) -> list[tuple[tuple[int, int], int]]:
        out: list[tuple[tuple[int, int], int]] = []
        for span, e in sorted(run, key=lambda x: (x[1], x[0])):
            if all(span[1] <= s[0] or s[1] <= span[0] for s, _ in out):
                out.append((span, e))
        return out

    def spans(self, text: str | None) -> tuple[int, list[dict]]:
        """Number of words, and all places in a text."""
        lower = (text or "").translate(_LOWER)
        words = WORD.findall(lower)
        joined = " ".join(words)
        found = list(self.places(joined))
        if not found:
            return len(words), []
        # Only texts with a place need to know where their words are.
        original = [(m.start(), m.end()) for m in WORD.finditer(lower)]
        begins = [0]
        for w in words:
            begins.append(begins[-1] + len(w) + 1)
        number = {at: k for k, at in enumerate(begins)}
        out = []
        for k, place in found:
            notice = self.notices[k]
            first, last = number[place.start], number[place.end + 1] - 1
            out.append({
                "label": notice.label, "errors": place.errors, "base": notice.base and not place.errors, "first_word": first, "last_word": last,
                "start": original[first][0], "end": original[last][1], "likeness": 1 - place.errors / len(notice.text),
            })
        return len(words), sorted(out, key=lambda s: (s["first_word"], s["last_word"], s["label"]))


@lru_cache(maxsize=4)
def scanner(notices: tuple[Notice, ...]) -> Scanner:
    """Built once by each worker."""
    return Scanner(notices)


ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all) with ``spans`` and what follows from them.

    ``n_base`` counts base places, ``first_word`` and ``last_word`` are their smallest and largest begin (null without any),
    ``base_labels`` and ``labels`` are sorted and joined by commas, ``score`` is the likeness of the best place (0 without any).
    """
    docs = docs.drop(*ADDED)
    kept = keep if keep is not None else docs.columns
    schema = fields(docs.select(*kept))
    for name in ADDED[:4]:
        schema = schema.add(name, "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", T.ArrayType(SPAN))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(notices)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, spans = own.spans(text.as_py())
                base = [s["first_word"] for s in spans if s["base"]]
                rows.append((
                    n, len(base), min(base, default=None), max(base, default=None),
                    ",".join(sorted({s["label"] for s in spans if s["base"]})), ",".join(sorted({s["label"] for s in spans})),
                    max((s["likeness"] for s in spans), default=0.0), spans,
                ))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            values = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *values], [*kept, *ADDED])

    return docs.mapInArrow(work, schema)
