"""Byte-pair encoding and decoding as streaming transducers.

Encoding reads a word left to right through a bounded buffer.  From the merge
list follows how far to the right a token boundary can depend on the text (the
*sufficient lookahead*): a token whose end lies that far before the end of the
buffer can no longer change, is written out and leaves the buffer.  Nothing
longer than the window is ever held, whatever the word's length.  Words seen
before are answered from a bounded table.

Decoding is an incremental machine as well: it keeps the bytes of an unfinished
character between tokens.

Nulls count as empty texts; an empty text has no tokens and decodes to ''.
Rows are independent, so repeated ids and extra columns need no care: all
columns pass through, and the two result columns are named by the caller.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import string
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import HELD, in_worker, text_slices

WORD_END = "</w>"
#: Bytes of a word that is merged whole; longer ones go through the stream.
SHORT = 48
#: Characters whose new words are merged together; bounds a task's memory.
AT_ONCE = 1 << 20
#: Separators that ``str.split`` knows besides Unicode white space.
_CONTROL_GAPS = re.compile("[\x1c-\x1f]")
#: Signs that stay together after a word; special tokens begin with "<".
_SIGNS = string.punctuation.replace("<", "")
_WHITE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + n) for n, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A word-end BPE model read from the JSON text of a tokenizer file."""

    def __init__(self, spec: str, cache_words: int = 400_000):
        self.spec, self.cache_words = spec, cache_words
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE file with word ends is needed")
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + WORD_END] for c in letters]
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        self.lookahead = self._read_merges(model["merges"], vocab)
        self.window = max(4 * self.lookahead, 1024)
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = np.r_[pairs[order], 2**63 - 1], np.r_[np.array(list(self.merges.values()), np.int32)[order], np.int32(0)]
        self.made_ids = np.array(self.made, np.int32)
        self.inner_ids, self.final_ids = np.array(self.inner, np.int32), np.array(self.final, np.int32)
        # ranks of two bytes side by side, inside a word and at its end
        self.inner_ranks = self._rank(self.inner_ids[:, None], self.inner_ids[None, :])
        self.final_ranks = self._rank(self.inner_ids[:, None], self.final_ids[None, :])
        self.known: dict[str, bytes] = {}

    def __reduce__(self):
        return shared_model, (self.spec, self.cache_words)

    def _read_merges(self, merges: list, vocab: dict[str, int]) -> int:
        """Fill the merge table; returns the sufficient lookahead in bytes.

        Merge k = (a, b) may be kept from happening by an earlier merge that
        takes the right end of b, i.e. one whose left side is b, b's right
        part, that part's right part and so on; such a merge needs its own right
        side and what that depends on.  As only earlier merges matter, one pass
        in order of the list finds each need.
        """
        length = {i: 1 for i in (*self.inner, *self.final)}
        right: dict[int, int] = {}
        reach: dict[int, int] = {}  # by left side: furthest byte its merges so far depend on
        for rank, pair in enumerate(merges):
            left, tail = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[tail], vocab[left + tail]
            if a not in length or b not in length:
                raise ValueError("a merge uses a token that no earlier merge makes")
            need, part = 0, b
            while part is not None:
                need = max(need, reach.get(part, 0))
                part = right.get(part)
            if made not in length:
                length[made], right[made] = length[a] + length[b], b
            reach[a] = max(reach.get(a, 0), length[b] + need)
            self.merges.setdefault((a, b), rank)
            self.made.append(made)
        return max(reach.values(), default=0)

    def merged(self, units: list[int]) -> list[int]:
        """Apply the merge list to ``units``: lowest rank first, leftmost among equals."""
        merges = self.merges
        if len(units) <= 48:
            # ranks of neighbours beside the units; only two change per merge
            units, made, none = list(units), self.made, len(self.made)
            ranks = [merges.get(p, none) for p in zip(units, units[1:])]
            while ranks and (best := min(ranks)) < none:
                at = ranks.index(best)
                units[at : at + 2] = [made[best]]
                del ranks[at]
                if at:
                    ranks[at - 1] = merges.get((units[at - 1], units[at]), none)
                if at < len(ranks):
                    ranks[at] = merges.get((units[at], units[at + 1]), none)
            return units
        units, after, before = list(units), list(range(1, len(units) + 1)), list(range(-1, len(units) - 1))
        end = len(units)
        heap = [(merges[p], i, p) for i, p in enumerate(zip(units, units[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if units[i] is not None else end
            if j >= end or (units[i], units[j]) != pair:
                continue
            units[i], units[j] = self.made[rank], None
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < end:
                    p = (units[k], units[after[k]])
                    if p in merges:
                        heapq.heappush(heap, (merges[p], k, p))
        return [u for u in units if u is not None]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        pair = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], np.int32(len(self.made)))

    def merged_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (as 32-bit integers) of whole words of at most SHORT bytes, merged side by side."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, SHORT)):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(mine):
                continue
            n, size = len(mine), sizes[mine]
            data = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in mine), np.uint8).reshape(n, high)
            units = self.inner_ids[data]
            last = data[np.arange(n), size - 1]
            units[np.arange(n), size - 1] = self.final_ids[last]
            units[np.arange(high) >= size[:, None]] = -1
            rank = self.inner_ranks[data[:, :-1], data[:, 1:]]
            longer = np.flatnonzero(size > 1)
            rank[longer, size[longer] - 2] = self.final_ranks[data[longer, size[longer] - 2], last[longer]]
            rank[units[:, 1:] < 0] = len(self.made)
            left = np.arange(n)
            place = np.arange(high)
            done = np.empty((n, high), np.int32)
            while len(left):
                at = rank.argmin(1)
                best = rank[np.arange(len(at)), at]
                going = best < len(self.made)
                done[left[~going]] = units[~going]
                left, units, rank, at, best = left[going], units[going], rank[going], at[going], best[going]
                rows = np.arange(len(at))
                # units right of the pair move one place to the left, and so do their ranks
                moved = np.minimum(place + (place > at[:, None]), high - 1)
                units = np.take_along_axis(units, moved, 1)
                units[:, -1] = -1
                units[rows, at] = self.made_ids[best]
                moved = np.minimum(place[:-1] + (place[:-1] >= at[:, None]), high - 2)
                rank = np.take_along_axis(rank, moved, 1)
                rank[:, -1] = len(self.made)
                for side in (-1, 0):
                    first = at + side
                    ok = np.flatnonzero((first >= 0) & (first < high - 1))
                    a, b = units[ok, first[ok]], units[ok, first[ok] + 1]
                    rank[ok, first[ok]] = np.where(b < 0, len(self.made), self._rank(a, np.maximum(b, 0)))
            kept = done >= 0
            flat, ends = done[kept].tobytes(), (4 * kept.sum(1).cumsum()).tolist()
            for i, begin, end in zip(mine.tolist(), [0, *ends], ends):
                out[i] = flat[begin:end]
        return out

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one word, given in parts of any size, through a bounded buffer."""
        buffer, length = bytearray(), {}
        for part in parts:
            for start in range(0, len(part), self.window):
                buffer += part[start : start + self.window]
                # the last byte is held back: it would differ if the word ended with it
                while len(buffer) > self.window:
                    known = len(buffer) - 1
                    done = 0
                    for token in self.merged([self.inner[b] for b in buffer[:known]]):
                        size = length.get(token)
                        if size is None:
                            size = length[token] = len(self.tokens[token].removesuffix(WORD_END))
                        if done + size + self.lookahead > known:
                            break
                        done += size
                        yield token
                    del buffer[:done]
        if buffer:
            yield from self.merged([*(self.inner[b] for b in buffer[:-1]), self.final[buffer[-1]]])

    def _pieces(self, chunk: str) -> list[str | int]:
        """Words of a run without white space, and ids of special tokens in it."""
        out: list[str | int] = []
        for part in self.cut.split(chunk) if self.cut and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = unicodedata.normalize("NFC", part)
            # letter by letter: lower-casing a whole text would treat a final sigma apart
            low = part.lower() if part.isascii() or "Σ" not in part else "".join(map(str.lower, part))
            if low.isalpha():
                out.append(low)
            else:
                out += self.pieces.findall(low)
        return out

    def _learn(self, chunks: Iterable[str], plain: bool = False) -> None:
        """Put runs without white space, and the words in them, into the table of known ones.

        A word alone is a run with that one word, so one table serves both.
        ``plain`` says that all are lower-case and composed (NFC) already.
        """
        known = self.known
        parts: dict[str, list[str | int]] = {}
        ended: list[tuple[str, str, str]] = []
        fresh: set[str] = set()
        for c in chunks:
            if plain or c == c.lower() and (c.isascii() or unicodedata.is_normalized("NFC", c)):
                # a word, or a word and the signs after it: most runs are
                if c.isalpha():
                    fresh.add(c)
                    continue
                word = c.rstrip(_SIGNS)
                if word.isalpha():
                    signs = c[len(word) :]
                    fresh.add(word)
                    fresh.add(signs)
                    ended.append((c, word, signs))
                    continue
            parts[c] = self._pieces(c)
            fresh.update(p for p in parts[c] if isinstance(p, str))
        words = list(fresh.difference(known))
        data = [p.encode() for p in words]
        known.update((p, ids) for p, d, ids in zip(words, data, self.merged_words(data)) if len(d) <= SHORT)
        for p, d in zip(words, data):
            if len(d) > SHORT:
                known[p] = array("i", self.stream((d,))).tobytes()
        known.update((c, known[word] + known[signs]) for c, word, signs in ended)
        for c, found in parts.items():
            if found != [c]:
                known[c] = b"".join([known[p] if isinstance(p, str) else array("i", [p]).tobytes() for p in found])

    def _runs(self, part: str) -> tuple[list[str], bool]:
        """Runs without white space; lower-cased where that changes no result, so that fewer differ, and whether they are."""
        plain = False
        if "<" not in part and "Σ" not in part:
            low = part.lower()
            if part.isascii() or unicodedata.is_normalized("NFC", part) and unicodedata.is_normalized("NFC", low):
                part, plain = low, True
        return list(filter(None, _WHITE.split(part))) if _CONTROL_GAPS.search(part) else part.split(), plain

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; what is new among their words is merged together."""
        out: list[list[bytes]] = [[] for _ in texts]
        work = [(i, part) for i, t in enumerate(texts) for part in text_slices(t)]
        start = 0
        while start < len(work):
            stop, size = start, 0
            while stop < len(work) and (stop == start or size + len(work[stop][1]) <= AT_ONCE):
                size += len(work[stop][1])
                stop += 1
            group = []
            # runs that are not known, by whether they are plain
            fresh: dict[bool, set[str]] = {True: set(), False: set()}
            for i, p in work[start:stop]:
                chunks, plain = self._runs(p)
                got = list(map(self.known.get, chunks))
                missing = [at for at, ids in enumerate(got) if ids is None]
                fresh[plain].update(map(chunks.__getitem__, missing))
                group.append((i, chunks, got, missing))
            fresh[False] -= fresh[True]
            if len(self.known) + sum(map(len, fresh.values())) > self.cache_words:
                self.known = {c: ids for _, chunks, got, _ in group for c, ids in zip(chunks, got) if ids is not None}
            for plain, chunks in fresh.items():
                self._learn(chunks, plain)
            for i, chunks, got, missing in group:
                for at in missing:
                    got[at] = self.known[chunks[at]]
                out[i].append(b"".join(got))
            if max((len(c) for chunks in fresh.values() for c in chunks), default=0) > SHORT:
                self.known = {c: ids for c, ids in self.known.items() if len(c) <= SHORT}
            start = stop
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_texts([text])[0]

    def byte_table(self) -> np.ndarray:
        """What each id stands for in bytes: a word end is a blank, special tokens are themselves."""
        byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        table = np.full(max(self.tokens) + 1, b"", dtype=object)
        special = set(self.special.values())
        for i, token in self.tokens.items():
            word = token.removesuffix(WORD_END)
            ended = b" " if word != token else b""
            table[i] = token.encode() if i in special else b"".join(map(byte.__getitem__, word)) + ended
        return table

    def token_table(self) -> np.ndarray:
        """Token texts by id."""
        table = np.full(max(self.tokens) + 1, "", dtype=object)
        table[list(self.tokens)] = list(self.tokens.values())
        return table


def shared_model(spec: str, cache_words: int) -> WordBpe:
    """The one model of a worker process, with the words that earlier tasks met.

    One is kept, so a worker's memory does not grow with the models it has seen.
    """
    held = HELD.get("bpe")
    if held is None or (held.spec, held.cache_words) != (spec, cache_words):
        held = HELD["bpe"] = WordBpe(spec, cache_words)
    return held


class TextDecoder:
    """Turns tokens into text bit by bit.

    ``plain=False`` gives what a tokenizer file without a decoder gives: token
    texts with a blank between them.  ``plain=True`` gives readable text: bytes
    become characters once complete, word ends become blanks.
    """

    def __init__(self, model: WordBpe, plain: bool = False):
        self.plain, self.first = plain, True
        self.table = model.byte_table() if plain else model.token_table()
        self.chars = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray | list[int]) -> str:
        if not len(ids):
            return ""
        tokens = self.table[np.asarray(ids)].tolist()
        if self.plain:
            # the blank after a word and a special token's "<" also end an unfinished character
            return self.chars.decode(b"".join(tokens))
        lead, self.first = "" if self.first else " ", False
        return lead + " ".join(tokens)

    def finish(self) -> str:
        self.first = True
        return self.chars.decode(b"", True)


def load_model(path: str) -> WordBpe:
    """The model of a tokenizer file that the driver can read."""
    with open(path, encoding="utf-8") as f:
        return WordBpe(f.read())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def encode(df: DataFrame, model: WordBpe, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, plain: bool = False) -> DataFrame:
    """Add the token ids of ``text_col`` as ``ids_col`` (array<int>).

    With ``decoded_col`` the ids are decoded again in the same pass over the
    rows, as ``decode`` does.
    """
    targets = {ids_col: T.ArrayType(T.IntegerType())} | ({decoded_col: T.StringType()} if decoded_col else {})
    return _mapped(df, text_col, targets, _Encode(model, _Decode(model, plain) if decoded_col else None))


def decode(df: DataFrame, model: WordBpe, ids_col: str = "token_ids", text_col: str = "decoded", plain: bool = False) -> DataFrame:
    """Add the text of ``ids_col`` as ``text_col``."""
    return _mapped(df, ids_col, {text_col: T.StringType()}, _Decode(model, plain))


class _Encode:
    def __init__(self, model, decoder):
        self.model, self.decoder = model, decoder

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        ids = _lists(self.model.encode_texts([t or "" for t in column.to_pylist()]))
        return [ids, *self.decoder(ids)] if self.decoder else [ids]


class _Decode:
    def __init__(self, model, plain):
        self.model, self.plain, self.machine = model, plain, None

    def __call__(self, column: pa.Array) -> list[pa.Array]:
        self.machine = self.machine or TextDecoder(self.model, self.plain)
        flat = column.cast(pa.list_(pa.int32()))
        texts = [self.machine.feed(x.values.to_numpy() if x.is_valid else []) + self.machine.finish() for x in flat]
        return [pa.array(texts, pa.string())]


def _mapped(df: DataFrame, source: str, targets: dict[str, T.DataType], work) -> DataFrame:
    for name in targets:
        if name in df.columns:
            raise ValueError(f"column {name} exists already")
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(batch.column(at))], names=[*batch.schema.names, *targets])

    return df.mapInArrow(in_worker(run, "bpe"), T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in targets.items())]))


def with_digests(df: DataFrame, ids_col: str, text_col: str) -> DataFrame:
    """``n_tokens`` and the SHA-256 of ids and text."""
    return df.withColumns(
        {
            "n_tokens": F.size(ids_col).cast("bigint"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256),
            "decoded_sha256": F.sha2(F.col(text_col), 256),
        }
    )
