"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece (one match of the split pattern) there is exactly
one token that the encoding of that prefix can end with. ``PrefixTable`` stores
it: the last token of prefix i is the one vocabulary entry t that ends at i and
may follow the last token of the prefix before t. Two tokens may follow each
other when their joined bytes encode to just those two. Walking back through
the table gives the encoding; appending bytes extends the table and leaves all
of it valid; after an edit only the entries behind it are computed, until they
agree with the old ones again for the length of the longest token.

Vocabulary entries that end at each byte come from one Aho-Corasick pass, so a
piece takes time linear in its bytes however long it is. Rows are encoded in
Arrow batches in place; nothing is shuffled. The vocabulary (a fixed file, its
path is a parameter) is read on the driver and broadcast: its size does not
depend on the data.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces up to this many characters are remembered with their tokens, at most CACHE_PIECES at a time.
CACHED_CHARS = 48
CACHE_PIECES = 1 << 18
#: White space as the Unicode property (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BOUNDARY = re.compile(f"[^{SPACE}][{SPACE}]")
#: Longer texts are split piece by piece in parts of PART_PIECES, which bounds the memory of very long ones.
PART_CHARS = 1 << 20
PART_PIECES = 1 << 17
#: Token pairs whose compatibility is remembered.
CACHE_PAIRS = 1 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class Vocabulary:
    """Ranks, the automaton over all tokens, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})

    def merged(self, data: bytes, until: int = 1) -> list[bytes]:
        """The bytes of one token merged step by step, down to ``until`` parts if they get there."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranked = [(self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = min((x for x in ranked if x[0] is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The token and, from the outside in, the parts at its right (side 1) or left (side 0) edge it was merged from,
        each with the rank of the merge that consumes it. Empty for an entry that merging never yields."""
        known = self._spines[side].get(token)
        if known is None:
            part, consumed, known = self.bytes_of[token], float("inf"), []
            while True:
                known.append((part, consumed))
                if len(part) == 1:
                    break
                halves = self.merged(part, until=2)
                if len(halves) != 2:
                    known = []
                    break
                part, consumed = halves[side], self.ranks[part]
            self._spines[side][token] = known
        return known

    def may_follow(self, first: int, second: int) -> bool:
        """Whether an encoding can hold these tokens side by side (first -1: ``second`` begins the piece).

        They stay apart unless some part at the right edge of the first and some
        part at the left edge of the second merge while both still stand. Among
        merges of one rank the leftmost goes first.
        """
        if first < 0:
            return bool(self._spine(second, 0))
        key = first << 32 | second
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            left, right = self._spine(first, 1), self._spine(second, 0)
            known = bool(left and right)
            ranks = self.ranks.get
            for a, a_gone in left if known else ():
                for b, b_gone in right:
                    rank = ranks(a + b)
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        known = False
                        break
                if not known:
                    break
            self._pairs[key] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        """Tokens of one piece: its prefix table, walked back."""
        last, pairs, may_follow = [-1] * (len(data) + 1), self._pairs, self.may_follow
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            if last[end + 1] < 0:
                begin = end + 1 - length
                before = last[begin]
                if before < 0:
                    ok = not begin and may_follow(-1, token)
                else:
                    ok = pairs.get(before << 32 | token)
                    if ok is None:
                        ok = may_follow(before, token)
                if ok:
                    last[end + 1] = token
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]


class PrefixTable:
    """The unique last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _ends(self, start: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(prefix length, tokens that end there) for the prefixes longer than ``start``."""
        begin = max(0, start - self.vocabulary.longest)
        at, here = -1, []
        for end, found in self.vocabulary.automaton.iter(self.data[begin:].decode("latin-1")):
            if end != at:
                if here and begin + at + 1 > start:
                    yield begin + at + 1, here
                at, here = end, []
            here.append(found)
        if here and begin + at + 1 > start:
            yield begin + at + 1, here

    def _last_token(self, i: int, tokens: list[tuple[int, int]]) -> int:
        for length, token in tokens:
            if length <= i and self.vocabulary.may_follow(self.last[i - length - 1] if length < i else -1, token):
                return token
        raise ValueError("bytes that the vocabulary cannot spell")

    def append(self, data: bytes) -> None:
        """Extend the piece; the entries of the old prefixes stay as they are."""
        start = len(self.data)
        self.data += data
        for i, tokens in self._ends(start):
            self.last.append(self._last_token(i, tokens))

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace bytes ``start`` to ``end``; returns how many entries were computed anew."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last, same, done = old[:start], 0, 0
        for i, tokens in self._ends(start):
            self.last.append(self._last_token(i, tokens))
            done += 1
            was = i - shift
            clear = i - len(self.vocabulary.bytes_of[self.last[-1]]) >= start + len(data)
            same = same + 1 if clear and was > end and old[was - 1] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[was:]
                break
        return done

    def tokens(self) -> list[int]:
        out, i = [], len(self.last)
        while i:
            out.append(self.last[i - 1])
            i -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class _Remembered(dict):
    """A bounded memo: text -> packed tokens, computed by ``make`` where missing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        packed = self.make(text)
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[text] = packed
        return packed


class Encoder:
    """Encoder and decoder of texts. Tokens are packed as little-endian unsigned 32-bit integers.

    Texts are cut before every run of white space that follows another
    character: no piece runs across such a place, so each part is split by the
    pattern and encoded alone. Parts and pieces seen lately are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces, self.parts = _Remembered(self._piece), _Remembered(self._part)
        size = max(self.vocabulary.bytes_of, default=0) + 1
        self.lengths = np.array([len(self.vocabulary.bytes_of.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.vocabulary.bytes_of.get(i, b"") for i in range(size)), dtype=np.uint8)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.vocabulary.ranks.get(data)
        return array("I", (whole,) if whole is not None else self.vocabulary.encode_piece(data)).tobytes()

    def _part(self, part: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(part)))

    def encode(self, text: str | None) -> bytes:
        """Token ids of a whole text (null and empty: none)."""
        if not text:
            return b""
        if len(text) <= PART_CHARS:
            return b"".join(map(self.parts.__getitem__, PARTS.findall(text)))
        found, out = (m.group() for m in PARTS.finditer(text)), []
        while some := list(islice(found, PART_PIECES)):
            out.append(b"".join(map(self.parts.__getitem__, some)))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids, out = np.frombuffer(packed, dtype="<u4"), []
        for at in range(0, len(ids), PART_PIECES):
            part = ids[at : at + PART_PIECES]
            lengths = self.lengths[part]
            behind = np.cumsum(lengths)
            out.append(self.blob[np.repeat(self.starts[part] - behind + lengths, lengths) + np.arange(behind[-1])].tobytes())
        return b"".join(out)

    def reencode(self, text: str, packed: bytes, start: int, end: int, new: str) -> tuple[str, bytes, int]:
        """The edited text and its tokens; characters ``start`` to ``end`` become ``new``. Also: characters encoded anew.

        A piece never runs from a character that is no white space into white
        space, so such places before and behind the edit are piece boundaries
        whatever the edit holds, and the tokens beyond them stay.
        """
        edited = text[:start] + new + text[end:]
        left = start - 1
        while left > 0 and not BOUNDARY.match(text, left - 1):
            left -= 1
        left = max(left, 0)
        right = end + 1
        while right < len(text) and not BOUNDARY.match(text, right - 1):
            right += 1
        right = min(right, len(text))
        ends = np.cumsum(self.lengths[np.frombuffer(packed, dtype="<u4")])
        head, tail = len(text[:left].encode()), len(text[:right].encode())
        before = int(np.searchsorted(ends, head, side="right")) if head else 0
        behind = int(np.searchsorted(ends, tail, side="left")) + 1 if right < len(text) else len(ends)
        middle = edited[left : right + len(new) - (end - start)]
        return edited, packed[: 4 * before] + self.encode(middle) + packed[4 * behind :], len(middle)


@lru_cache(maxsize=4)
def _encoder(data: bytes, pattern: str) -> Encoder:
    return Encoder(parse_ranks(data), pattern)


def _broadcast(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(batch: pa.RecordBatch, name: str) -> Iterable[str | None]:
    return (x.as_py() for x in batch.column(name))


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    ids: bool = True, digests: bool = True,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, with ``ids`` the tokens, with ``digests`` ids_sha256 and decoded_sha256.

    Every match of ``pattern`` in the whole text is encoded by itself, without
    special tokens. decoded_sha256 is taken over the bytes decoded from the
    ids. Null and empty texts have no tokens. Rows are encoded one by one: ties
    and repeated rows give repeated results, an empty table none; other columns
    are not read.
    """
    ranks = _broadcast(docs, rank_file)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens bigint"
    schema += ", ids array<int>" if ids else ""
    schema += ", ids_sha256 string, decoded_sha256 string" if digests else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # the output of few rows at a time is held
                rows = batch.slice(at, 256)
                packed = [encoder.encode(t) for t in _texts(rows, "__text")]
                counts = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                out = {"doc_id": rows.column("doc_id"), "n_tokens": pa.array(counts)}
                if ids:
                    flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat)
                    )
                if digests:
                    out["ids_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string())
                    out["decoded_sha256"] = pa.array(
                        [hashlib.sha256(encoder.decode(p)).hexdigest() for p in packed], pa.string()
                    )
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"))
    return source.mapInArrow(run, schema)


def decode_tokens(
    encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Per row: doc_id, decoded (the bytes of the ids; null ids: no bytes)."""
    ranks = _broadcast(encoded, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(ranks.value, pattern).decode
        for batch in batches:
            decoded = [decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(decoded, pa.binary())], ["doc_id", "decoded"]
            )

    id_type = encoded.schema[id_col].dataType.simpleString()
    source = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return source.mapInArrow(run, f"doc_id {id_type}, decoded binary")


def edit_documents(
    encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    ids_col: str = "ids", start_col: str = "start", end_col: str = "end", new_col: str = "new",
) -> DataFrame:
    """Apply one edit per row (characters start to end become new) to encoded texts, encoding only around it.

    Returns doc_id, text, ids, n_encoded (characters encoded anew). An append is
    start = end = length. Null start, end or new: the row stays as it is; null
    text counts as empty, and positions beyond the text mean its end.
    """
    ranks = _broadcast(encoded, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            out: list[list] = [[], [], []]
            for r in batch.to_pylist():
                text, packed, n = r["t"] or "", np.array(r["ids"] or [], dtype="<u4").tobytes(), 0
                if None not in (r["s"], r["e"], r["n"]):
                    s = min(max(r["s"], 0), len(text))
                    text, packed, n = encoder.reencode(text, packed, s, min(max(r["e"], s), len(text)), r["n"])
                for column, x in zip(out, (text, np.frombuffer(packed, "<u4").astype(np.int32), n), strict=True):
                    column.append(x)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.list_(pa.int32()), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "text", "ids", "n_encoded"])

    id_type = encoded.schema[id_col].dataType.simpleString()
    names = ((id_col, "doc_id"), (text_col, "t"), (ids_col, "ids"), (start_col, "s"), (end_col, "e"), (new_col, "n"))
    source = encoded.select(*[encoded[c].alias(n) for c, n in names])
    return source.mapInArrow(run, f"doc_id {id_type}, text string, ids array<int>, n_encoded bigint")
