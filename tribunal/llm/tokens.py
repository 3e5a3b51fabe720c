"""Token ids of whole texts, with each distinct unit of text encoded once per worker.

Byte-level and word-level tokenizers cut a text into pieces before they merge,
so the ids of a text are the ids of such units one after the other.  Units are
cut and told apart with array operations on the bytes of many texts; they repeat
far more often than texts do, and the library is asked only about those that
the worker does not remember.  Texts or tokenizers for which the cuts are not
known to hold are encoded as a whole.

Units are known by 64-bit codes; a worker that has met a thousand million
distinct ones has met a wrong one with a chance of about 0.0002.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tribunal.llm.common import range_codes, slices, text_bytes

#: Units that a worker remembers; about 40 bytes each.
REMEMBERED = 3_000_000
#: Units put to the library in one text.
ASKED = 4_096
_SLICE = 4 << 20
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _rule(spec: dict) -> str:
    """How the tokenizer treats spaces: led (a unit starts with its space), dropped, or whole (unknown)."""
    pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
        return "led"
    kinds = [x.get("type") for x in (normal or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in parts] == ["Split", "ByteLevel"]:
        pattern = parts[0].get("pattern", {}).get("Regex", "")
        if parts[0].get("invert") and parts[0].get("behavior") == "Removed" and pattern.endswith(r"[^\s\p{L}\p{N}]+"):
            return "dropped"
    return "whole"


def _marked(*stretches: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in stretches:
        out[low:high + 1] = True
    return out


_BLANK = _marked((0x09, 0x0D), (0x20, 0x20))
_LETTER = _marked((0x41, 0x5A), (0x61, 0x7A))
_WORDLY = _LETTER | _marked((0x30, 0x39))
_SIGN = _marked((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_JOINING = _SIGN & ~_marked((0x27, 0x27))
#: First bytes of white space beyond ASCII.
_FAR = _marked((0xC2, 0xC2), (0xE1, 0xE3))


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_AS_LETTER = _byte_letters()


def _blanks(part: np.ndarray) -> np.ndarray:
    """Bytes of white space, beyond ASCII too."""
    out = _BLANK[part]
    far = np.flatnonzero(_FAR[part])
    if len(far):
        padded = np.append(part, (0, 0)).astype(np.uint8)
        a, b, c = part[far], padded[far + 1], padded[far + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
                 | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
                 | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)))
        for size, at in ((2, far[two]), (3, far[three])):
            for k in range(size):
                out[at + k] = True
    return out


def unit_bounds(part: np.ndarray, row_opens: np.ndarray, led: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each unit, and for each byte whether it is white space.

    Cuts are where the tokenizers' patterns always end a piece: before a run of
    white space, before a space that something follows (led), behind a single
    white-space byte that is no space, between a letter or digit and a sign
    after it, and between a sign other than the apostrophe and a letter after it
    (all of ASCII).  White space belongs to units only if ``led``.
    """
    n = len(part)
    blank = _blanks(part)
    head = row_opens[:-1]
    before = np.zeros(n, dtype=np.uint8)
    before[1:] = part[:-1]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = blank[:-1]
    sign = _SIGN[part]
    cut = head | (_WORDLY[before] & sign) | (_JOINING[before] & _LETTER[part])
    if not led:
        opens = ~blank & (cut | blank_before)
        ends_here = np.ones(n, dtype=bool)
        ends_here[:-1] = blank[1:] | opens[1:]
        closes = ~blank & (ends_here | row_opens[1:])
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1, blank
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~blank[1:]
    follows &= ~row_opens[1:]
    first = blank & (~blank_before | head)
    cut |= first | ((part == 0x20) & follows)
    alone = np.zeros(n, dtype=bool)
    alone[1:] = (first & (part != 0x20) & (part < 0x80))[:-1]
    cut |= alone & ~blank
    opens = np.flatnonzero(cut)
    return opens, np.append(opens[1:], n if len(opens) else []).astype(np.int64), blank


class Encoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.library.model
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.rule = _rule(spec)
        self.vocabulary = self.library.get_vocab_size()
        # A piece that stands alone between two units, and that no unit holds.
        self.between, self.mark = ("\n", "\n") if self.rule == "led" else (" ~ ", "~")
        answer = self._ask(self.mark)
        self.between_id = int(answer[0]) if len(answer) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.codes = np.zeros(0, dtype=np.uint64)
        self.at, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.used = np.zeros(0, dtype=bool)
        self.store = np.zeros(0, dtype=self._kind())

    def _kind(self) -> type:
        return np.uint16 if self.vocabulary <= 1 << 16 else np.uint32

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _word(self, unit: bytes) -> list[int] | None:
        """Ids of a unit that is one word of Latin letters, a single piece for the library's model; None for others."""
        text = unit.decode()
        body = text[1:] if text[0] == " " else text
        if not body.isalpha():
            return None
        if self.rule == "dropped":
            text = text.lower()
            if not text.isalpha():
                return None
            unit = text.encode()
        return [x.id for x in self.model.tokenize(unit.decode("latin-1").translate(_AS_LETTER))]

    def _learn(self, units: list[bytes], plain: np.ndarray, latin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some units, one after the other, and the number of each.

        Words go to the model as they are, other plain units many at a time.
        """
        found = [self._word(u) if own else None for u, own in zip(units, (plain & latin).tolist())]
        mark = self.mark.encode()
        together = [i for i in np.flatnonzero(plain).tolist() if found[i] is None and mark not in units[i]]
        for k in range(0, len(together) if self.between_id is not None else 0, ASKED):
            some = together[k:k + ASKED]
            text = self.between.encode().join([units[i] for i in some]).decode()
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) != len(some) - 1:
                continue
            ids = ids.tolist()
            for i, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                found[i] = ids[a:b]
        out = [self._ask(u.decode()).tolist() if x is None else x for u, x in zip(units, found)]
        sizes = np.fromiter(map(len, out), dtype=np.int32, count=len(out))
        return np.fromiter(chain.from_iterable(out), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _make_room(self) -> None:
        """Forget the units not met since the last time, so that the others fit."""
        keep = self.used if self.used.mean() < 0.75 else np.zeros(len(self.used), dtype=bool)
        size, at = self.size[keep], self.at[keep]
        self.store = self.store[_spread(at, size)]
        self.codes, self.size, self.at = self.codes[keep], size, np.cumsum(size) - size
        self.used = np.zeros(len(size), dtype=bool)

    def _look_up(self, codes: np.ndarray, first: np.ndarray, last: np.ndarray, part: np.ndarray,
                 blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the store and number of ids for each of these distinct units, learning the new ones."""
        place = np.searchsorted(self.codes, codes)
        place[place == len(self.codes)] = 0
        new = np.flatnonzero(self.codes[place] != codes) if len(self.codes) else np.arange(len(codes))
        if len(new):
            a, b = first[new], last[new]
            blanks = np.append(0, np.cumsum(blank))
            led = (part[a] == 0x20) & (self.rule == "led")
            plain = (blanks[b] - blanks[a] == led) & (b - a > led)
            beyond = np.append(0, np.cumsum(part >= 0xC9))
            raw = part.tobytes()
            ids, sizes = self._learn([raw[x:y] for x, y in zip(a.tolist(), b.tolist())], plain, beyond[b] == beyond[a])
            if len(self.codes) + len(new) > REMEMBERED and len(self.codes):
                known = place[self.codes[place] == codes]
                self.used[known] = True
                wanted = self.codes[known]
                self._make_room()
                if len(np.setdiff1d(wanted, self.codes)):
                    # Hardly anything was unused: start over with what this slice needs.
                    self._forget()
                    return self._look_up(codes, first, last, part, blank)
            at = len(self.store) + np.cumsum(sizes) - sizes
            self.store = np.append(self.store, ids.astype(self.store.dtype))
            codes_ = np.append(self.codes, codes[new])
            order = np.argsort(codes_, kind="stable")
            self.codes = codes_[order]
            self.at, self.size = np.append(self.at, at)[order], np.append(self.size, sizes)[order]
            self.used = np.append(self.used, np.ones(len(new), dtype=bool))[order]
            place = np.searchsorted(self.codes, codes)
        self.used[place] = True
        return self.at[place], self.size[place]

    def _slice(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some neighbouring texts and the number of each."""
        base, stop = int(starts[0]), int(ends[-1])
        part = raw[base:stop]
        row_opens = np.zeros(len(part) + 1, dtype=bool)
        row_opens[starts - base] = True
        opens, closes, blank = unit_bounds(part, row_opens, self.rule == "led")
        if not len(opens):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(starts), dtype=np.int64)
        codes, first, which = np.unique(range_codes(part, opens, closes), return_index=True, return_inverse=True)
        at, size = self._look_up(codes, opens[first], closes[first], part, blank)
        sizes = size[which].astype(np.int64)
        reached = np.append(0, np.cumsum(sizes))
        bounds = reached[np.searchsorted(opens, np.append(starts, stop) - base)]
        return self.store[_spread(at[which], sizes)].astype(np.uint32), np.diff(bounds)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text of a string column, one after the other, and the number of each; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        raw, starts, ends = text_bytes(column)
        whole = np.full(len(column), self.rule == "whole")
        for token in self.special:
            held = pc.match_substring(column, token, ignore_case=True).fill_null(False)
            whole |= held.to_numpy(zero_copy_only=False)
        ids, counts = [], np.zeros(len(column), dtype=np.int64)
        for i, j in slices(starts, ends, _SLICE):
            edges = np.flatnonzero(np.diff(whole[i:j])) + i + 1
            for a, b in zip([i, *edges.tolist()], [*edges.tolist(), j]):
                if not whole[a]:
                    found, counts[a:b] = self._slice(raw, starts[a:b], ends[a:b])
                    ids.append(found)
                    continue
                for r in range(a, b):
                    found = self._ask(raw[starts[r]:ends[r]].tobytes().decode())
                    counts[r] = len(found)
                    ids.append(found)
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32), counts

    def ids_with_end(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with one more id behind those of each text."""
        ids, counts = self.ids(column)
        out = np.empty(len(ids) + len(counts), dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        out[np.cumsum(counts + 1) - 1] = end
        return out, counts + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        ids, counts = self.ids(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of ``size`` neighbouring items from each ``at`` on."""
    total = int(size.sum())
    return np.repeat(at - (np.cumsum(size, dtype=np.int64) - size), size) + np.arange(total)
