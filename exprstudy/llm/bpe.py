"""Byte-pair encoding in vectorised merge rounds, for files of public tokenizers.

All words of a slice stand in one flat array of symbols.  A round takes the lowest pair
rank of each word, merges all its leftmost non-overlapping occurrences at once and packs
the array; words without a known pair leave it.  Where a merge could bring a pair of lower
or equal rank into being, only the leftmost occurrence is merged in that round, so the
order of merges, and with it the result, is that of the libraries.

Only distinct units (a word with the space before it, a run of white space) of a slice
are encoded.  Units with characters beyond Latin go through the tokenizers library itself
where its pattern needs their Unicode class.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from exprstudy.llm import textops as tx

NO_RANK = np.int64(1 << 62)

#: Text bytes whose distinct units are encoded together.
UNIT_BYTES = 4 << 20

#: Bytes of distinct units that are merged together: the arrays of a round take some 100 bytes for each.
MERGE_BYTES = 1 << 18


class PairTable:
    """Ranks and results of known pairs, in a table probed by a hash of the pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, n_symbols: int):
        self.n_symbols = n_symbols
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        bits = max(int(np.ceil(np.log2(max(len(keys), 1)))) + 3, 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(1 << bits, NO_RANK, np.int64)
        self.merged = np.zeros(1 << bits, np.int64)
        # entry by entry into the first free cell: all that want a cell try, one gets it, the others go on
        todo, cell = np.arange(len(keys)), self._cell(keys)
        while len(todo):
            free = self.keys[cell] == np.iinfo(np.uint64).max
            self.keys[cell[free]] = keys[todo[free]]
            got = self.keys[cell] == keys[todo]
            self.rank[cell[got]], self.merged[cell[got]] = rank[todo[got]], merged[todo[got]]
            todo, cell = todo[~got], (cell[~got] + 1) & self.mask
        least = np.full(n_symbols, NO_RANK)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.alone = least[self.merged] <= self.rank

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The cell of each pair, or that of no pair (-1)."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        cell = self._cell(keys)
        held = self.keys[cell]
        out = np.where(held == keys, cell, -1)
        open_ = np.flatnonzero((held != keys) & (held != np.iinfo(np.uint64).max))
        while len(open_):
            cell[open_] = (cell[open_] + 1) & self.mask
            held = self.keys[cell[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = cell[open_[hit]]
            open_ = open_[~hit & (held != np.iinfo(np.uint64).max)]
        return out


def merge(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of all words to the end; returns the symbols and the new lengths."""
    n_words = len(lengths)
    if not n_words or not len(symbols):
        return symbols, lengths
    sym = symbols.astype(np.int64)
    word = np.repeat(np.arange(n_words), lengths)
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    cell = np.full(len(sym), -1, np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    cell[inner] = table.find(sym[inner], sym[inner + 1])
    while len(sym):
        rank = np.where(cell >= 0, table.rank[cell], NO_RANK)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        if (best == NO_RANK).any():
            live = np.repeat(best < NO_RANK, sizes)
            finished.append((sym[~live], word[~live]))
            sym, word, cell, rank = sym[live], word[live], cell[live], rank[live]
            sizes, best = sizes[best < NO_RANK], best[best < NO_RANK]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # of neighbouring occurrences every second one, counted from the left
        new_run = np.append(True, np.diff(at) > 1)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        lone = table.alone[cell[at]] & np.append(False, word[at[1:]] == word[at[:-1]])
        at = at[~lone]
        sym[at] = table.merged[cell[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new_at = at - np.arange(len(at))
        sym, word, cell = sym[keep], word[keep], cell[keep]
        for where in (new_at, new_at[new_at > 0] - 1):
            last = where == len(sym) - 1
            cell[where[last]] = -1
            where = where[~last]
            same = word[where] == word[where + 1]
            cell[where[~same]] = -1
            where = where[same]
            cell[where] = table.find(sym[where], sym[where + 1])
    sym = np.concatenate([s for s, _ in finished])
    word = np.concatenate([w for _, w in finished])
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n_words)


# --- distinct units --------------------------------------------------------


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut texts into units: a word with a space right before it, else the word; the rest of each run of white space.

    The last character of a run of two or more stands alone if it is no space.  At the end
    of a text the whole run is one unit.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = tx.SPACE[data]
    filled = np.diff(offsets) > 0
    firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[firsts] = True
    last[lasts] = True
    before = np.append(True, space[:-1])
    word_start = ~space & (before | first)
    after_word = np.append(~space[1:], False) & ~last
    joined = space & after_word & (data == 32)
    start = first | joined | (space & after_word)
    start |= space & np.append(False, ~space[:-1])
    led = np.append(False, joined[:-1]) & ~first
    start |= word_start & ~led
    return np.flatnonzero(start)


@dataclass
class Units:
    """Distinct units of some texts, and which unit stands where."""

    data: np.ndarray
    offsets: np.ndarray
    which: np.ndarray
    per_text: np.ndarray


def distinct_units(texts: pa.Array, cut: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Units:
    hashes, starts, lengths, per_text = [], [], [], []
    data, _ = tx.buffer(texts)
    before = 0
    for part in tx.slices(iter([pa.record_batch([texts], names=["t"])]), "t"):
        mine, offsets = tx.buffer(part.column(0))
        at = cut(mine, offsets)
        hashes.append(tx.hash_spans(mine, at))
        starts.append(at + before)
        lengths.append(np.diff(np.append(at, len(mine))))
        per_text.append(np.diff(np.searchsorted(at, offsets)))
        before += len(mine)
    if not hashes:
        return Units(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    _, which, first = tx.numbered(np.concatenate(hashes))
    starts, lengths = np.concatenate(starts)[first], np.concatenate(lengths)[first]
    return Units(data[tx.ragged(starts, lengths)], tx.offsets_of(lengths), which, np.concatenate(per_text))


def in_parts(encode, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of all units, a bounded number of bytes at a time; units do not depend on each other."""
    ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for low, high in tx.parts(offsets, MERGE_BYTES):
        some, n = encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        ids.append(some.astype(np.int32))
        lengths.append(n)
    return np.concatenate(ids), np.concatenate(lengths)


def expand(units: Units, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts from those of the distinct units, and the offsets of the texts."""
    at = tx.offsets_of(lengths)
    flat = ids[tx.ragged(at[:-1][units.which], lengths[units.which])]
    text = tx.offsets_of(units.per_text)
    return flat, tx.offsets_of(lengths[units.which])[text]


# --- tokenizers library files ----------------------------------------------

LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3
#: Code points below this have a class here; a unit with a higher one goes to the library.
LATIN = 0x250


def _latin_classes() -> np.ndarray:
    import unicodedata

    out = np.full(LATIN, OTHER)
    for i in range(LATIN):
        kind = unicodedata.category(chr(i))
        out[i] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    out[tx.SPACE.nonzero()[0]] = WHITE
    return out


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    odd = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)]


class LibraryFile:
    """A byte-level BPE file of the tokenizers library; ``word_end`` files are lower case and drop white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.word_end = bool(self.suffix)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in merges])
        right = np.array([vocabulary[b] for _, b in merges])
        merged = np.array([vocabulary[a + b] for a, b in merges])
        self.table = PairTable(left, right, np.arange(len(merges)), merged, max(vocabulary.values()) + 1)
        characters = _byte_characters()
        self.first = np.array([vocabulary[c] for c in characters])
        self.final = np.array([vocabulary[c + self.suffix] for c in characters])
        self.classes = _latin_classes()
        lowered = [chr(i).lower() for i in range(LATIN)]
        self.lower = np.array([ord(c) if len(c) == 1 else 0 for c in lowered])
        self.odd = np.zeros(LATIN, bool)
        self.odd[[0x85, 0xA0]] = True
        if self.word_end:
            self.odd[(self.lower == 0) | (self.lower >= LATIN)] = True
            self.odd[0] = False

    def encode_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of distinct words, and which word stands where; a text for the library is a word of its own."""
        far = self._library_texts(texts)
        units = distinct_units(pc.if_else(pa.array(far), "", texts) if far.any() else texts, unit_starts)
        ids, lengths = in_parts(self._units, units.data, units.offsets)
        if not far.any():
            return ids, lengths, units.which, units.per_text
        lists = [e.ids for e in self.library.encode_batch(texts.filter(pa.array(far)).to_pylist(), add_special_tokens=False)]
        at = tx.offsets_of(units.per_text + far)
        which = np.zeros(at[-1], np.int64)
        which[tx.ragged(at[:-1], units.per_text)] = units.which
        which[at[1:][far] - 1] = len(lengths) + np.arange(len(lists))
        ids = np.append(ids, [i for x in lists for i in x]).astype(np.int32)
        return ids, np.append(lengths, [len(x) for x in lists]), which, units.per_text + far

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of the texts."""
        ids, lengths, which, per_text = self.encode_units(texts)
        return expand(Units(np.zeros(0, np.uint8), np.zeros(1, np.int64), which, per_text), ids, lengths)

    def _library_texts(self, texts: pa.Array) -> np.ndarray:
        """Texts with white space outside ASCII, which may join a unit's own: they are encoded whole by the library."""
        found = pc.match_substring_regex(pc.fill_null(texts, ""), "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
        return found.to_numpy(zero_copy_only=False).astype(bool)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(lead, offsets)
        lengths = np.diff(at)
        unit = np.repeat(np.arange(len(lengths)), lengths)
        high = points >= LATIN
        high[~high] = self.odd[points[~high]]
        strange = np.bincount(unit[high], minlength=len(lengths)) > 0
        plain = ~strange[unit]
        words, word_unit = self._pieces(points[plain], unit[plain])
        ids, sizes = merge(*words, self.table)
        counts = np.bincount(word_unit, weights=sizes, minlength=len(lengths)).astype(np.int64)
        if not strange.any():
            return ids.astype(np.int32), counts
        where = np.flatnonzero(strange)
        spelled = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8") for i in where]
        lists = [e.ids for e in self.library.encode_batch(spelled, add_special_tokens=False)]
        counts[where] = [len(x) for x in lists]
        place = tx.offsets_of(counts)
        out = np.zeros(place[-1], np.int32)
        out[tx.ragged(place[where], counts[where])] = [i for x in lists for i in x]
        rest = np.flatnonzero(~strange)
        out[tx.ragged(place[rest], counts[rest])] = ids
        return out, counts

    def _pieces(self, points: np.ndarray, unit: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """First symbols of the pieces that the file's pattern cuts units into, their lengths, and the unit of each piece."""
        if not len(points):
            return (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64)
        if self.word_end:
            points = self.lower[points]
        kind = self.classes[points]
        first = np.append(True, unit[1:] != unit[:-1])
        # a unit's leading space belongs to what follows it
        joined = np.zeros(len(points), bool)
        joined[:-1] = first[:-1] & (kind[:-1] == WHITE) & ~first[1:] & (kind[1:] != WHITE)
        shown = kind.copy()
        shown[:-1][joined[:-1]] = kind[1:][joined[:-1]]
        cut = first | np.append(True, shown[1:] != shown[:-1])
        if self.word_end:
            cut |= kind == NUMBER
            cut[1:] |= joined[:-1]
        self._contractions(points, kind, first, joined, cut)
        size = np.where(points < 0x80, 1, 2)
        place = tx.offsets_of(size)
        flat = np.zeros(place[-1], np.int64)
        two = size == 2
        flat[place[:-1]] = np.where(two, 0xC0 | points >> 6, points)
        flat[place[:-1][two] + 1] = 0x80 | points[two] & 0x3F
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(place[:-1][starts], place[-1]))
        owner = unit[starts]
        symbols = self.first[flat]
        if self.word_end:
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.final[flat[ends]]
            real = kind[starts] != WHITE
            symbols = symbols[np.repeat(real, lengths)]
            lengths, owner = lengths[real], owner[real]
        return (symbols, lengths), owner

    def _contractions(self, points, kind, first, joined, cut) -> None:
        """Cut ``'s 't 're 've 'm 'll 'd`` where an apostrophe begins a piece and a letter follows it."""
        led = np.append(False, joined[:-1])
        if self.word_end:
            led[:] = False
        mark = np.flatnonzero((points == ord("'")) & cut & ~led)
        mark = mark[mark + 1 < len(points)]
        mark = mark[~first[mark + 1] & (kind[mark + 1] == LETTER)]
        one = points[mark + 1]
        follows = np.minimum(mark + 2, len(points) - 1)
        two = np.where((mark + 2 < len(points)) & ~first[follows] & (kind[follows] == LETTER), points[follows], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[mark[single | double] + 1] = False
        after = np.concatenate([mark[single] + 2, mark[double] + 3])
        cut[after[after < len(points)]] = True


# --- sentencepiece files ----------------------------------------------------


class PieceFile:
    """A BPE file of the sentencepiece library with byte fallback and without normalisation rules."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        number = {pieces[i]: i for i in normal}
        if lib.encode("a ▁b") != lib.encode("a  b") or lib.encode("") or lib.encode("é", out_type=str)[-1] != "́":
            raise ValueError(f"{path} normalises its input, which is not supported")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        self.bytes = np.zeros(256, np.int64)
        spelled = [b""] * size
        for i in range(size):
            if lib.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.bytes[value] = i
                spelled[i] = bytes([value])
            elif not lib.is_control(i):
                spelled[i] = pieces[i].replace("▁", " ").encode()
        self.unknown = size
        self.of_point = np.arange(0x110000) + size
        for piece, i in number.items():
            if len(piece) == 1:
                self.of_point[ord(piece)] = i
        self.of_point[0x20] = number["▁"]
        scores = np.array([lib.get_score(i) for i in range(size)])
        _, rank = np.unique(-scores, return_inverse=True)
        found = [(number[p[:k]], number[p[k:]], rank[i], i) for p, i in number.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, ranks, merged = (np.array(x) for x in zip(*found))
        self.table = PairTable(left, right, ranks, merged, size)
        joined = {c for p in number if len(p) > 1 for c in p}
        #: Bytes that are in no longer piece: units end before and after them.
        self.separate = np.zeros(256, bool)
        self.separate[[b for b in range(0x20) if chr(b) not in joined]] = True
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = tx.offsets_of(np.array([len(s) for s in spelled]))

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space, alone = data == 32, self.separate[data]
        start = alone | (space & np.append(True, ~space[:-1])) | np.append(False, alone[:-1])
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(start)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end, one after the other, and the offsets of the texts."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        units = distinct_units(texts, self._cut)
        ids, lengths = in_parts(self._units, units.data, units.offsets)
        ids, at = expand(units, ids, lengths)
        n = np.diff(at) + 2
        out_at = tx.offsets_of(n)
        out = np.zeros(out_at[-1], np.uint32)
        out[out_at[:-1]], out[out_at[1:] - 1] = self.begin, self.end
        out[tx.ragged(out_at[:-1] + 1, n - 2)] = ids
        return out, out_at

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        lengths = np.diff(np.searchsorted(lead, offsets))
        ids, sizes = merge(self.of_point[points], lengths, self.table)
        strange = ids >= self.unknown
        if not strange.any():
            return ids, sizes
        # a character without a piece becomes the pieces of its bytes
        spelled = [[int(self.bytes[b]) for b in chr(p - self.unknown).encode()] for p in ids[strange]]
        width = np.ones(len(ids), np.int64)
        width[strange] = [len(s) for s in spelled]
        place = tx.offsets_of(width)
        out = np.zeros(place[-1], np.int64)
        out[place[:-1][~strange]] = ids[~strange]
        out[tx.ragged(place[:-1][strange], width[strange])] = [b for s in spelled for b in s]
        unit = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(unit, weights=width, minlength=len(sizes)).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts of valid encodings, and their offsets; the leading space that encoding adds is gone."""
        lengths = np.diff(self.spelled_at)[ids]
        flat = self.spelled[tx.ragged(self.spelled_at[:-1][ids], lengths)]
        at = tx.offsets_of(lengths)[offsets]
        led = np.zeros(len(at) - 1, bool)
        filled = np.diff(at) > 0
        led[filled] = flat[at[:-1][filled]] == 32
        keep = np.ones(len(flat), bool)
        keep[at[:-1][led]] = False
        return flat[keep], tx.offsets_of(np.diff(at) - led)


@lru_cache(maxsize=8)
def library_file(path: str) -> LibraryFile:
    return LibraryFile(path)


@lru_cache(maxsize=4)
def piece_file(path: str) -> PieceFile:
    return PieceFile(path)
