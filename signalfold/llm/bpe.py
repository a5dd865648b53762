"""Token ids of a public tokenizer file, each distinct piece of text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from signalfold.llm.words import Slices, hash_slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Unicode white space; code points that only some libraries count as such.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSURE = "\x1c-\x1f\u180e\u200b\u2060\ufeff"
_ODD = f"[\\x00\t\x0b-\r{_SPACE[4:]}{_UNSURE}]|  | \n|\n[ \n]"
_NO_PIECES = re.compile(f"[{_UNSURE}]")
_ANY_SPACE = re.compile(f"[{_SPACE}{_UNSURE}]")
# A piece ends where the tokenizer's own splitter always ends one: before the last white space of a run.
_PIECE = re.compile("S?N+(?:S+(?=S|$))?|S+(?=S|$)|S".replace("S", f"[{_SPACE}]").replace("N", f"[^{_SPACE}]").replace("$", r"\Z"))
# Letters that every version of Unicode knows, then punctuation: the splitter ends a part between them and nowhere else.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_WORD = f"^(?P<before>[\n\\x00]?)(?P<letters>[{_LETTERS}]+)(?P<marks>[!-/:-@\\[-`{{-~]*)$"

# Bytes of text that are encoded together: enough that most words of a block come several times, little beside a worker.
TOGETHER_BYTES = 4 << 20
# What is remembered: pieces of at most so many bytes, runs of punctuation.
_LONGEST, _MOST_MARKS = 256, 10_000


def text_blocks(batch: pa.RecordBatch, text_col: str = "text", most: int = TOGETHER_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut into slices of at most `most` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(ends):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def _hashes(pieces: pa.Array) -> np.ndarray:
    _, offsets, data = pieces.buffers()
    offsets = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return hash_slices(Slices(np.concatenate([data, np.zeros(8, np.uint8)]), offsets[:-1], offsets[1:]))


class Encoder:
    """Encodes whole texts with the `tokenizers` library and remembers the ids of pieces.

    A byte-level tokenizer first splits a text with a fixed pattern and merges inside the parts
    only, so pieces that begin and end at such splits have the same ids alone as in the text.
    A word of letters, with punctuation after it or not, is split here and its parts go to the model.
    Texts that contain the string of a special token are encoded in one call.  The memory holds
    at most `limit` short pieces; then the half that came last (the rarer words) is forgotten.
    """

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        settings = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        settings = {k: v for k, v in settings.items() if k != "type" and v is not None}
        settings["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in settings["merges"]]
        # The model's own memory is of no use to pieces that are encoded once.
        self._model = models.BPE(**settings, cache_capacity=0)
        self._tokenizer.model = self._model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = re.findall(f"[ {_LETTERS}]", "".join(map(chr, range(0x250))))
        self._form = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in letters}
        self._blank = self._form[ord(" ")]
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # What sends a text to the splitting that holds for any text.
        self._odd = "|".join([_ODD, *map(re.escape, self._special)])
        self._four = [i.to_bytes(4, "little") for i in range(max(settings["vocab"].values()) + 1)]
        self._line_feed = self._ids(["\n"])[0][0]
        self._line = self._four[self._line_feed]
        self._marks: dict[str, bytes] = {}
        # The memory: pieces and their ids as they came, and places in these by the sorted hashes of the pieces.
        self._limit = limit
        self._known, self._known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self._hash, self._place = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty text have none.

        The distinct pieces of all texts are looked up once, so large lists cost less per text.
        """
        plain, odd = {}, {}
        is_odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), self._odd).to_pylist()
        for i, text in enumerate(texts):
            if text and is_odd[i]:
                odd[i] = self._pieces(text)
            elif text:
                plain[i] = self._joined(text)
        out = [b""] * len(texts)
        if not plain and not odd:
            return out
        parts = []
        if plain:
            whole = pa.array([" ".join(plain.values())], pa.large_string())
            parts.append(pc.split_pattern(whole, " ").values)
        if odd:
            parts.append(pa.array([p for pieces in odd.values() for p in pieces], pa.large_string()))
        pieces = pa.concat_arrays(parts).dictionary_encode()
        ids = self._find(pieces.dictionary).take(pieces.indices)
        sizes = [t.count(" ") + 1 for t in plain.values()] + [len(p) for p in odd.values()]
        _, offsets, raw = ids.buffers()
        ends = np.frombuffer(offsets, np.int64)[np.cumsum([0, *sizes])].tolist()
        view = memoryview(raw)
        for i, first, end in zip([*plain, *odd], ends[:-1], ends[1:], strict=True):
            out[i] = bytes(view[first:end])
        return out

    def _find(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct pieces, from memory or learned now."""
        hashes = _hashes(distinct)
        at = self._places(distinct, hashes)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self._known_ids.take(pa.array(at))
        pieces, first = distinct.take(pa.array(new)), len(self._known)
        learned = pa.array(self._learn(pieces), pa.large_binary())
        all_ids = pa.concat_arrays([self._known_ids, learned])
        at[new] = np.arange(first, len(all_ids))
        found = all_ids.take(pa.array(at))
        short = np.flatnonzero(pc.binary_length(pieces).to_numpy() <= _LONGEST)
        if len(short) < len(new):
            new, pieces, learned = new[short], pieces.take(pa.array(short)), learned.take(pa.array(short))
            all_ids = pa.concat_arrays([self._known_ids, learned])
        self._known, self._known_ids = pa.concat_arrays([self._known, pieces]), all_ids
        # Of pieces with one hash the first is found again, the others are learned each time.
        hashes, order = np.unique(hashes[new], return_index=True)
        spot = np.searchsorted(self._hash, hashes)
        free = ~self._held(hashes, spot)
        self._hash = np.insert(self._hash, spot[free], hashes[free])
        self._place = np.insert(self._place, spot[free], first + order[free])
        if len(self._known) > self._limit:
            half = self._limit // 2
            first = pa.array(np.arange(half))
            self._known, self._known_ids, stays = self._known.take(first), self._known_ids.take(first), self._place < half
            self._hash, self._place = self._hash[stays], self._place[stays]
        return found

    def _held(self, hashes: np.ndarray, spot: np.ndarray) -> np.ndarray:
        held = spot < len(self._hash)
        held[held] = self._hash[spot[held]] == hashes[held]
        return held

    def _places(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each piece in memory, or -1; pieces of equal hash are compared whole."""
        at, order = np.full(len(hashes), -1), np.argsort(hashes)
        spot = np.searchsorted(self._hash, hashes[order])
        held = self._held(hashes[order], spot)
        at[order[held]] = self._place[spot[held]]
        hit = np.flatnonzero(at >= 0)
        same = pc.equal(self._known.take(pa.array(at[hit])), pieces.take(pa.array(hit)))
        at[hit[~same.to_numpy(zero_copy_only=False)]] = -1
        return at

    def _learn(self, new: pa.Array) -> list[bytes]:
        """Ids of pieces that are not in memory."""
        simple, other, out, marked = [], [], [], self._marks
        tokenize, four, form, blank = self._model.tokenize, self._four, self._form, self._blank
        words = pc.extract_regex(new, _WORD).flatten()
        # Words that are known without the punctuation after them.
        bare = pc.if_else(pc.and_(pc.equal(words[0], ""), pc.not_equal(words[2], "")), words[1], None).dictionary_encode()
        at = self._places(bare.dictionary, _hashes(bare.dictionary))
        at = self._known_ids.take(pa.array(at, mask=at < 0)).take(bare.indices)
        columns = [c.to_numpy(zero_copy_only=False).tolist() for c in (new, *words, at)]
        for p, before, letters, marks, ids in zip(*columns, strict=True):
            if letters:
                if ids is None:
                    shown = letters if letters.isascii() else letters.translate(form)
                    ids = b"".join([four[t.id] for t in tokenize(shown if before else blank + shown)])
                if marks:
                    end = marked.get(marks)
                    if end is None:
                        end = array("I", self._ids([marks])[0]).tobytes()
                        if len(marked) < _MOST_MARKS:
                            marked[marks] = end
                    ids += end
                out.append(self._line + ids if before == "\n" else ids)
                continue
            out.append(None)
            (other if _ANY_SPACE.search(p) or p == "\0" or not p else simple).append(p)
        known = {}
        for first in range(0, len(simple), 2000):
            some = simple[first : first + 2000]
            # A line feed alone is one token of its own and ends a word, so it marks the words' ends.
            text = "".join([p[1:] + "\n" if p[0] == "\0" else f" {p}\n" for p in some])
            ids = np.array(self._ids([text])[0], "<u4")
            ends = np.flatnonzero(ids == self._line_feed)
            assert len(ends) == len(some)
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, (ends * 4).tolist(), strict=True):
                known[p] = raw[start:end]
                start = end + 4
        whole = [p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in other]
        known.update(zip(other, [array("I", ids).tobytes() for ids in self._ids(whole)], strict=True))
        return [known[p] if ids is None else ids for p, ids in zip(columns[0], out, strict=True)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, text: str) -> str:
        """Pieces as they are remembered, joined by blanks: words without the blank before them; a first one marked by NUL."""
        spaced = text.replace("\n", " \n")
        return spaced[1:] if spaced[0] == " " else "\0" + spaced

    def _pieces(self, text: str) -> list[str]:
        """Pieces of any text, which may hold white space; the NUL before them says that no blank was left out."""
        if any(s in text for s in self._special) or _NO_PIECES.search(text):
            return ["\0" + text]
        return ["\0" + p for p in _PIECE.findall(text)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)
