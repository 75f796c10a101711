"""Byte-level BPE encoding and decoding over Arrow batches, with the ``tokenizers`` library.

A vocabulary is a tokenizer file of that library, or a file of ranks (base64 token, rank). For ranks the
tokens' bytes are mapped to printable characters, every split of a token into two tokens becomes a merge
in order of the token's rank, and a piece that is itself a token is taken whole: the rules by which rank
files are read. Merges never cross the pieces that the pattern cuts. So a batch of texts is cut, as one array of
bytes, where the usual pattern always cuts (``_cuts``); its distinct chunks are found by Arrow, those not yet remembered go
to the library's BPE model, and Arrow gathers the ids of all chunks. A worker remembers a bounded number of chunks and
keeps those that come again. A text that holds one of the tokens that a tokenizer file adds (``<|endoftext|>``) goes to
the library whole, which knows them, unless ``plain`` asks for ordinary text; with another pattern all texts do.

Decoding joins the tokens' bytes, by the table of bytes and characters read backwards. A character whose
bytes are split over tokens has no place of its own in any of them: offsets give each token the range of
characters that its bytes touch, and ``decode_text`` puts split characters together again.

Defined results: null and empty texts have no ids; equal texts have equal ids, repeated rows stay; whole texts of any
length are encoded, memory follows the batch; an empty table stays empty; columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventlens.llm.common import fields

#: Chunks that a worker remembers; beyond, those go that are used least.
REMEMBERED = 300_000
#: Bytes of text that are encoded at once; a longer text is a portion of its own.
PORTION = 1 << 20
#: The usual pattern of byte-level vocabularies, for tokenizer files, which name it only by kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside of printable Latin text and usual white space.
_RARE = re.compile("[^\t-\r\x20-\x7e\xa0-\u024f]")


#: A chunk that is one piece as it is.
_WORD = re.compile(rb" ?[A-Za-z]+").fullmatch
_BYTE = np.arange(256)
_IS_LETTER = np.isin(_BYTE, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
#: Printable ASCII besides letters, space and the apostrophe, with which contractions begin.
_IS_MARK = (_BYTE > 0x20) & (_BYTE < 0x7F) & ~_IS_LETTER & (_BYTE != ord("'"))
#: Bytes that may begin a white space character, and those below, do not tell that a chunk begins.
_MAY_BE_SPACE = (_BYTE < 0x21) | np.isin(_BYTE, [0xC2, 0xE1, 0xE2, 0xE3])


def _cuts(data: np.ndarray) -> np.ndarray:
    """For each byte but the first, whether the usual pattern cuts before it, whatever else the text holds:

    * before a space that no white space follows (a longer run of white space ends before its last one);
    * between a letter and any other ASCII character (letters make pieces of their own, and a contraction begins with its mark);
    * between a mark or digit and a letter, but after an apostrophe;
    * between a line's end and a letter, if the line ends with a mark or letter (a single one is a piece).

    Only ASCII decides, what may be something else does not cut.
    """
    letter = _IS_LETTER[data]
    before, after = data[:-1], data[1:]
    cut = letter[:-1] & ~letter[1:] & (after < 0x80)
    cut |= _IS_MARK[before] & letter[1:]
    space = np.flatnonzero(after[:-1] == 32)
    cut[space[~_MAY_BE_SPACE[data[space + 2]]]] = True
    line = np.flatnonzero((before == 10) & letter[1:])
    line = line[line > 0]
    cut[line[(data[line - 1] > 0x20) & (data[line - 1] < 0x7F)]] = True
    return cut


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str):
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    letters = byte_characters()
    text = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        splits = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        merges += [(text[a], text[b]) for a, b in sorted(splits, key=lambda s: (ranks[s[0]], ranks[s[1]]))]
    made = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    made.decoder = decoders.ByteLevel()
    return made


class _Letters(dict):
    """The characters that stand for the bytes of a code point, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(_BYTES[b] for b in chr(code).encode())
        return out


_BYTES = byte_characters()
_LETTERS = _Letters()


class Codec:
    """One vocabulary in one process."""

    def __init__(self, path: str, pattern: str | None = None, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        if path.endswith(".json"):
            self.tokenizer = Tokenizer.from_file(path)
        else:
            self.tokenizer = tokenizer_of_ranks(read_ranks(path), pattern)
        self.tokenizer.encode_special_tokens = plain
        added = {} if plain else {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = [content.encode() for content in added.values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes = [b""] * (max([*vocab.values(), *added]) + 1)
        for token, i in [*vocab.items(), *((content, i) for i, content in added.items())]:
            # Added tokens are spelled as plain text and are not made of byte characters.
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) and i not in added else token.encode()
        self.size = len(self.bytes)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.token_bytes = pa.array(self.bytes, pa.large_binary())
        self.cut = regex.compile(pattern or PATTERN).findall
        self.usual = (pattern or PATTERN) == PATTERN
        #: Place of each remembered chunk; ids of all, where those of each begin, and how often it was used.
        self.chunks: dict[bytes, int] = {}
        self.flat, self.starts, self.used = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the chunks used most, half of the bound at most and none that was used once."""
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(keep[np.argsort(self.used[keep])[len(keep) - REMEMBERED // 2 :]])
        names = list(self.chunks)
        size = np.diff(self.starts)
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(self.starts * self.dtype.itemsize), pa.py_buffer(self.flat)]).take(pa.array(keep))
        self.flat = np.frombuffer(b"".join(ids.to_pylist()), self.dtype)
        self.starts = np.concatenate(([0], np.cumsum(size[keep])))
        self.used = self.used[keep] // 2
        self.chunks = {names[k]: place for place, k in enumerate(keep.tolist())}

    def _encode(self, text: str) -> list[int]:
        """Cut into the pieces that merges stay within. Plain scripts are cut here, which is faster; where tables
        of characters may differ, the library cuts them itself."""
        if _RARE.search(text):
            pieces = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        else:
            pieces = [piece.translate(_LETTERS) for piece in self.cut(text)]
        return [t.id for piece in pieces for t in self.tokenizer.model.tokenize(piece)]

    def _numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Place of each chunk among those remembered; new ones are encoded."""
        if len(self.chunks) > REMEMBERED:
            self._forget()
        new = [c for c in distinct if c not in self.chunks]
        if new:
            flat: list[int] = []
            ends = []
            tokenize, space = self.tokenizer.model.tokenize, _BYTES[32]
            for c in new:
                text = c.decode("utf-8", "surrogatepass")
                flat += [t.id for t in tokenize(text.replace(" ", space))] if _WORD(c) else self._encode(text)
                ends.append(len(flat))
            self.chunks.update(zip(new, range(len(self.used), len(self.used) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, np.array(flat, self.dtype)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.array(ends, np.int64)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        return np.fromiter(map(self.chunks.__getitem__, distinct), np.int64, len(distinct))

    def portions(self, texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
        """(first text, its bytes as binary without nulls, ids, bounds): ids of text k are ``ids[bounds[k]:bounds[k + 1]]``."""
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PORTION, side="right")) - 1)
            part = texts.slice(at, stop - at)
            yield (at, part.cast(pa.large_binary()), *self._portion(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]))
            at = stop

    def _portion(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes()
        special = [k for k in range(len(bounds) - 1) if any(a in whole[bounds[k] : bounds[k + 1]] for a in self.added)] if any(a in whole for a in self.added) else []
        begins = np.zeros(len(data) + 1, bool)
        if self.usual and len(data) > 2:
            begins[1:-1] = _cuts(data)
        begins[bounds] = True
        edges = np.flatnonzero(begins)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        known = chunks.dictionary_encode()
        number = self._numbers(known.dictionary.to_pylist())
        indices = known.indices.to_numpy()
        self.used[number] += np.bincount(indices, minlength=len(number))
        width = self.dtype.itemsize
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.used), [None, pa.py_buffer(self.starts * width), pa.py_buffer(self.flat)])
        taken = table.take(pa.array(number).take(known.indices))
        upto = np.frombuffer(taken.buffers()[1], np.int64)[: len(edges)] // width if len(edges) > 1 else np.zeros(1, np.int64)
        ids = np.frombuffer(taken.buffers()[2] or b"", self.dtype)[: upto[-1]]
        ends = upto[np.searchsorted(edges, bounds)]
        if special:
            by_text = np.split(ids, ends[1:-1])
            for k in special:
                text = whole[bounds[k] : bounds[k + 1]].decode("utf-8", "surrogatepass")
                by_text[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
            ids, ends = np.concatenate(by_text), np.concatenate(([0], np.cumsum([len(x) for x in by_text])))
        return ids, ends

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian integers of ``dtype``; a null text counts as empty."""
        out = []
        for _, _, ids, bounds in self.portions(pa.array(texts, pa.large_string())):
            out += [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.dtype)

    def decode(self, raw: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, self.ids(raw).tolist()))

    def decode_text(self, raw: bytes) -> str:
        """The text; bytes that end in the middle of a character become the replacement character."""
        return self.decode(raw).decode("utf-8", "replace")

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens one after another, and where those of each begin (one place more at the end)."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        taken = self.token_bytes.take(pa.array(ids))
        return np.frombuffer(taken.buffers()[2] or b"", np.uint8), np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]

    def offsets(self, raw: bytes) -> np.ndarray:
        """For each token a row: the range of characters (code points) that its bytes touch."""
        data, edges = self.spelled(self.ids(raw))
        return touched(data, edges)


def touched(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(first, end) of the characters that the bytes between neighbouring edges belong to, counted from the start of ``data``."""
    inside = np.append((data & 0xC0) == 0x80, False)
    begun = np.concatenate(([0], np.cumsum(~inside[:-1])))
    return np.stack([begun[edges[:-1]] - inside[edges[:-1]], begun[edges[1:]]], axis=1)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str | None = None, plain: bool = False) -> Codec:
    """The vocabulary of this process: read once by each worker, from a path that every node has."""
    return Codec(path, pattern, plain)


def encode(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and with ``offsets`` (array of start, end) if asked; a map without a shuffle.

    Null and empty texts have empty arrays; columns of those names are replaced; rows are never dropped.
    """
    docs = docs.drop("ids", "offsets")
    whole = T.IntegerType()
    schema = fields(docs).add("ids", T.ArrayType(whole))
    if offsets:
        schema = schema.add("offsets", T.ArrayType(T.StructType().add("start", whole).add("end", whole)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = own.encode(batch.column(text).to_pylist())
            batch = batch.append_column("ids", _lists([own.ids(r).astype(np.int32) for r in raw]))
            if offsets:
                ranges = [own.offsets(r) for r in raw]
                ends = _lists([r[:, 0].astype(np.int32) for r in ranges]).offsets
                flat = np.concatenate([*ranges, np.zeros((0, 2), np.int64)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
                batch = batch.append_column("offsets", pa.ListArray.from_arrays(ends, pairs))
            yield batch

    return docs.mapInArrow(work, schema)


def _lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))


def decode(frame: DataFrame, path: str, pattern: str | None = None, name: str = "decoded") -> DataFrame:
    """``frame`` with the bytes that its ``ids`` stand for. Null ids have null bytes; an unknown id fails the job."""
    frame = frame.drop(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [None if x is None else own.decode(np.array(x, own.dtype).tobytes()) for x in batch.column("ids").to_pylist()]
            yield batch.append_column(name, pa.array(raw, pa.binary()))

    return frame.mapInArrow(work, fields(frame).add(name, "binary"))


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, keep: list[str] | None = None, plain: bool = False) -> DataFrame:
    """Encode and decode in one pass: the columns of ``keep`` (all), then

    * ``n_tokens`` and ``ids_sha256``, of the decimal ids joined by commas;
    * ``decoded_sha256``, of the bytes that the ids stand for, and ``lossless``, whether these are the text's;
    * ``n_split``, tokens that begin or end inside a character, and ``offsets_crc32``, of the first and end character of
      each token as little-endian unsigned 32-bit integers.

    Ids stay in the task, so nothing wide is moved.
    """
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "lossless": "boolean", "n_split": "long", "offsets_crc32": "long"}
    docs = docs.drop(*added)
    kept = keep if keep is not None else docs.columns
    schema = fields(docs.select(*kept))
    for n, t in added.items():
        schema = schema.add(n, t)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, plain)
        decimal = pa.array([f"{i},".encode() for i in range(own.size)], pa.large_binary())
        for batch in batches:
            for first, texts, ids, bounds in own.portions(batch.column("text")):
                values = _trip(own, decimal, texts, ids, bounds)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], *values], [*kept, *added])

    return docs.mapInArrow(work, schema)


def _trip(own: Codec, decimal: pa.Array, texts: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    numbers = decimal.take(pa.array(ids))
    number_at = np.frombuffer(numbers.buffers()[1], np.int64)[bounds] if len(ids) else np.zeros(len(bounds), np.int64)
    written = memoryview(numbers.buffers()[2] or b"")
    data, edges = own.spelled(ids)
    byte_at = edges[bounds]
    spelled = memoryview(data)
    source = texts.buffers()[2]
    source = memoryview(source).cast("B") if source else memoryview(b"")
    source_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    ranges = touched(data, edges).astype("<u4")
    inside = np.append((data & 0xC0) == 0x80, False)
    split = np.concatenate(([0], np.cumsum(inside[edges[:-1]] | inside[edges[1:]])))
    digests, decoded, same, places = [], [], [], []
    for k in range(len(texts)):
        a, b = bounds[k], bounds[k + 1]
        digests.append(hashlib.sha256(written[number_at[k] : max(number_at[k], number_at[k + 1] - 1)]).hexdigest())
        back = spelled[byte_at[k] : byte_at[k + 1]]
        decoded.append(hashlib.sha256(back).hexdigest())
        same.append(back == source[source_at[k] : source_at[k + 1]])
        # Characters are counted from the text's own start.
        own_ranges = ranges[a:b] - ranges[a, 0] if b > a else ranges[:0]
        places.append(zlib.crc32(own_ranges.tobytes()))
    return [
        pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_()),
        pa.array(split[bounds[1:]] - split[bounds[:-1]], pa.int64()), pa.array(places, pa.int64()),
    ]
