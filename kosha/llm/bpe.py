"""Byte-pair encoding and decoding with forced-boundary splitting.

A merge can only join two symbols if their concatenation is a vocabulary token,
so two neighbouring bytes that stand side by side inside no token always end up
in different tokens.  Words are cut there; the fragments are encoded on their own
and their ids concatenated.  The words of many texts are found, told apart and put
together again as arrays; the fragments of new ones are encoded together, and a
bounded memo serves the others.

Vocabularies are files in the public `tokenizers` JSON format with word ends
(`end_of_word_suffix`), byte-level symbols and NFC, white-space and lower-case
normalisers.  The path of the file is a parameter.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices
from .shingles import mix, powers

MEMO = 500_000  # most words of a worker's memo; a full one keeps those of the last texts
RECENT = 30_000  # words that wait to be sorted into the memo
LONG = 32  # bytes; longer words are encoded one by one
CHUNK = 500_000  # characters of texts that are encoded together
NO_RANK = np.int32(2**31 - 1)
LETTERS, NUMBERS, OTHERS = r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"  # what a word may be, behind contractions


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Code points (hexadecimal, ranges with both ends) that are no letters or numbers in the Unicode tables
# of the library, version 16, and may be in those of the pattern compiler here.
NOT_YET = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""


# Small letters of capitals that this Python's Unicode tables, version 15.1, don't have and the library's have.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NEW_CAPITALS = regex.compile("[" + "".join(map(chr, SMALL)) + "]")


def _lower(s: str) -> str:
    if s.isascii():
        return s.lower()
    if NEW_CAPITALS.search(s):
        s = s.translate(SMALL)
    # Character by character where it matters: the library has no word-final sigma.
    return s.lower() if "\u03a3" not in s else "".join(c.lower() for c in s)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    kinds = np.full(0x110000, 3, dtype=np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    for r in NOT_YET.split():
        bounds = [int(x, 16) for x in r.split("-")]
        kinds[bounds[0] : bounds[-1] + 1] = 3
    return kinds


def _no_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables of words as one, by hash; the same word stands in one of them only."""
    joined = [np.concatenate(x) for x in zip(a, b, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(x[order] for x in joined)


def _gather(flat: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of flat of count values at each place, end to end."""
    ends = np.cumsum(count)
    return flat[np.repeat(place - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encoder and decoder for one vocabulary, equal to the library's; special tokens in a text are their ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only deterministic BPE vocabularies with word ends and no decoder are read")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.symbols = _byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        steps = spec["normalizer"]
        self.steps = [self._step(p) for p in (steps["normalizers"] if steps["type"] == "Sequence" else [steps])]
        pre = spec["pre_tokenizer"]
        pre = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        pattern = next(p["pattern"]["Regex"] for p in pre if p["type"] == "Split").split("|")
        self.contractions = [p[1:] for p in pattern[:-3]]
        if pattern[-3:] != [LETTERS, NUMBERS, OTHERS] or not all(regex.fullmatch("'[a-z]+", p) for p in pattern[:-3]) or len({p[:1] for p in self.contractions}) < len(set(self.contractions)) - 1:
            raise ValueError("only contractions, letters, single numbers and other characters are read as words")
        self.kinds = _kinds()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.inside = self._pairs_inside()
        # Words by hash, the main part and the recent one: hashes in order, places in and numbers of ids in self.flat.
        self.known = [_no_words(), _no_words()]
        self.flat = np.zeros(0, np.int32)
        self.type = np.dtype("<u2" if max(self.names) < 1 << 16 else "<i4")
        self._tables(merges)

    def _step(self, p: dict):
        if p["type"] == "NFC":
            return lambda s: s if s.isascii() or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)
        if p["type"] == "Lowercase":
            return _lower
        if p["type"] == "Replace":
            found = regex.compile(p["pattern"]["Regex"] if "Regex" in p["pattern"] else regex.escape(p["pattern"]["String"]))
            # White space only separates words here, so runs of it may stay.
            return (lambda s: s) if found.pattern == r"\s+" else (lambda s: found.sub(lambda _: p["content"], s))
        raise ValueError(f"normaliser {p['type']} is not read")

    def _pairs_inside(self) -> set[str]:
        """All pairs of neighbouring byte symbols inside some token."""
        bare = (t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab)
        return {a + b for t in bare for a, b in zip(t, t[1:], strict=False)}

    def cut(self, word: str) -> list[str]:
        """A word of byte symbols in fragments, cut between every pair that no token holds; the last bears the word end."""
        at = [i + 1 for i, (a, b) in enumerate(zip(word, word[1:], strict=False)) if a + b not in self.inside]
        bounds = [0, *at, len(word)]
        return [word[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def merge(self, fragment: str, last: bool) -> list[int]:
        """Ids of one fragment: the pair of least rank is joined, leftmost first, until no pair has a rank."""
        parts: list = list(fragment)
        if last:
            parts[-1] += self.suffix
        n, ranks = len(parts), self.ranks
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := ranks.get(p := (parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, p))
        return [self.vocab[p] for p in parts if p is not None]

    def word_ids(self, piece: str) -> list[int]:
        fragments = self.cut("".join(map(self.symbols.__getitem__, piece.encode())))
        return [i for k, f in enumerate(fragments) for i in self.merge(f, k == len(fragments) - 1)]

    def _tables(self, merges) -> None:
        """Arrays for encoding many words at once: ids of bytes, byte pairs inside tokens, ranks and results of merges."""
        plain = [self.symbols[b] for b in range(256)]
        self.byte_id = np.array([self.vocab[x] for x in plain], dtype=np.int32)
        self.last_id = np.array([self.vocab[x + self.suffix] for x in plain], dtype=np.int32)
        self.byte_pairs = np.array([[a + b in self.inside for b in plain] for a in plain])
        keys = np.array([(self.vocab[a] << 32) + self.vocab[b] for a, b in merges], dtype=np.int64)
        self.result = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int32)
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], NO_RANK).astype(np.int32)

    def _merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """merge() for many fragments at once: a row of ids each, -1 behind the last; every step joins the best pair of each row."""
        rows, todo = rows.copy(), np.arange(len(rows))
        now, width = rows, rows.shape[1]
        ranks = self._rank(now[:, :-1], now[:, 1:])
        columns = np.arange(width - 1)
        while len(todo):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(j)), j]
            live = best != NO_RANK
            rows[todo[~live]] = now[~live]
            todo, now, ranks, j, best = todo[live], now[live], ranks[live], j[live], best[live]
            i = np.arange(len(j))
            now[i, j] = self.result[best]
            behind = columns + (columns > j[:, None])
            now = np.concatenate((np.take_along_axis(now, behind, 1), np.full((len(i), 1), -1, np.int32)), 1)
            ranks = np.concatenate((np.take_along_axis(ranks, behind[:, :-1], 1), np.full((len(i), 1), NO_RANK, np.int32)), 1)
            ranks[i, j] = self._rank(now[i, j], now[i, np.minimum(j + 1, width - 1)])
            left = j > 0
            ranks[i[left], j[left] - 1] = self._rank(now[i[left], j[left] - 1], now[i[left], j[left]])
        return rows

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has: all are cut, the fragments encoded together, and concatenated."""
        coded = [w.encode() for w in words]
        size = np.array([len(c) for c in coded])
        if (size > LONG).any():  # one by one, and the others together
            ids: list = [None] * len(words)
            short = np.flatnonzero(size <= LONG)
            if len(short):
                flat, counts = self._learn([words[i] for i in short])
                for i, x in zip(short, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    ids[i] = x
            for i in np.flatnonzero(size > LONG):
                ids[i] = np.array(self.word_ids(words[i]), dtype=np.int32)
            return np.concatenate(ids), np.array([len(x) for x in ids])
        data = np.frombuffer(b"".join(coded), dtype=np.uint8)
        first = np.zeros(len(data), dtype=bool)
        first[np.cumsum(size) - size] = True
        starts = np.flatnonzero(first | np.concatenate(([True], ~self.byte_pairs[data[:-1], data[1:]])))
        ends = np.append(starts[1:], len(data))
        ids = self.byte_id[data]
        final = np.cumsum(size) - 1
        ids[final] = self.last_id[data[final]]
        out = np.full((len(starts), LONG), -1, dtype=np.int32)
        length, low = ends - starts, 0
        for width in (8, 16, LONG):
            pick = np.flatnonzero((length > low) & (length <= width))
            low = width
            if len(pick):
                place = starts[pick, None] + np.arange(width)
                rows = np.where(place < ends[pick, None], ids[np.minimum(place, len(data) - 1)], -1)
                out[pick, :width] = self._merge_rows(rows)
        there = out >= 0
        of_word = np.cumsum(first)[starts] - 1
        return out[there], np.bincount(of_word, there.sum(1), len(words)).astype(np.int64)

    def _spots(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of a text start and end, and their hashes."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kind = self.kinds[points]
        before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
        start = (kind != 0) & ((kind != before) | (kind == 2))
        marks = np.flatnonzero(start & (points == 39))  # contractions
        for tail in self.contractions:
            fits = marks[marks + len(tail) < len(points)]
            for j, c in enumerate(tail, 1):
                fits = fits[points[fits + j] == ord(c)]
            for j in range(1, len(tail) + 1):
                start[fits + j] = False
            behind = fits + len(tail) + 1
            behind = behind[behind < len(points)]
            start[behind] = kind[behind] != 0
        starts = np.flatnonzero(start)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64)
        spaces = np.cumsum(kind == 0)
        ends = np.append(starts[1:], len(points))
        ends = ends - (spaces[ends - 1] - spaces[starts])  # white space stands only between words
        up, down = powers(len(points))
        terms = (points.astype(np.uint64) + np.uint64(1)) * up[: len(points)]
        terms[kind == 0] = 0
        return starts, ends, mix(np.add.reduceat(terms, starts) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    def _ids_of_words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a text, where its words start, and how many ids each has."""
        starts, ends, hashes = self._spots(text)
        if not len(starts):
            return np.zeros(0, np.int32), starts, starts
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        for known, places, counts in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                hit = known[at] == distinct
                place[hit], count[hit] = places[at[hit]], counts[at[hit]]
        new = np.flatnonzero(count == 0)  # every word has ids
        if len(new):
            flat, count[new] = self._learn([text[a:b] for a, b in zip(starts[first[new]], ends[first[new]], strict=True)])
            place[new] = len(self.flat) + np.cumsum(count[new]) - count[new]
            self.flat = np.concatenate((self.flat, flat))
        out = _gather(self.flat, place[which], count[which])
        if len(new):
            self._remember(distinct, place, count, new)
        return out, starts, count[which]

    def _remember(self, distinct, place, count, new) -> None:
        old, recent = self.known
        recent = _merged(recent, (distinct[new], place[new], count[new]))
        if len(old[0]) + len(recent[0]) > MEMO:
            self.flat = _gather(self.flat, place, count)
            old, recent = (distinct, np.cumsum(count) - count, count), _no_words()
        elif len(recent[0]) > RECENT:
            old, recent = _merged(old, recent), _no_words()
        self.known = [old, recent]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, as arrays of self.type; the words of all are looked up and learnt together."""
        parts: list = []  # stretches of texts, and special tokens between them as integers
        bounds = [0]
        for text in texts:
            at = 0
            for m in self.specials.finditer(text) if self.specials else ():
                parts += [text[at : m.start()], self.special[m[0]]]
                at = m.end()
            parts.append(text[at:])
            bounds.append(len(parts))
        for i, part in enumerate(parts):
            if isinstance(part, str):
                for step in self.steps:
                    part = step(part)
                parts[i] = part
        strings = [p if isinstance(p, str) else "" for p in parts]
        ids, starts, counts = self._ids_of_words("\n".join(strings))
        ids = ids.astype(self.type)
        stops = np.cumsum([len(p) + 1 for p in strings])  # of each part in the joined text
        cuts = np.append(0, np.cumsum(counts))[np.append(0, np.searchsorted(starts, stops))]
        out = []
        for low, high in zip(bounds, bounds[1:], strict=False):
            if high - low == 1:
                out.append(ids[cuts[low] : cuts[high]])
            else:
                out.append(np.concatenate([ids[cuts[i] : cuts[i + 1]] if isinstance(parts[i], str) else np.array([parts[i]], self.type) for i in range(low, high)]))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_column(self, column):
        """encode_many over an Arrow column, a list for some texts at a time; nulls count as empty."""
        held, n = [], 0
        for t in column:
            held.append(t.as_py() or "")
            n += len(held[-1])
            if n >= CHUNK:
                yield self.encode_many(held)
                held, n = [], 0
        yield self.encode_many(held)

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces, as a vocabulary without a decoder gives them."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    """The codec of a vocabulary file that every executor has at path; one per worker."""
    with open(path, encoding="utf-8") as f:
        return Codec(json.load(f))


def _ids_array(codec: Codec, column) -> pa.ListArray:
    coded = [x for some in codec.encode_column(column) for x in some]
    offsets = np.cumsum([0, *map(len, coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*coded, np.zeros(0, codec.type)]).astype(np.int32)))


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the token ids of text_col as array<int> in ids_col, in place of a column of that name.

    Whole texts; a null text counts as empty, and an empty one has no ids.
    Rows are independent: none goes, repeated ones stay.
    """
    rest = docs.drop(ids_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        codec = load(path)
        for batch in slices(batches):
            ids = _ids_array(codec, batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)

    return rest.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """tokens with the text of ids_col in text_col, in place of a column of that name; null ids count as none."""
    rest = tokens.drop(text_col)
    schema = T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType(), False)])

    def run(batches):
        codec = load(path)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index(ids_col)).fill_null([])
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [codec.decode(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)


def ids_text(ids_col: str):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids_col).cast("array<string>"), " ")
