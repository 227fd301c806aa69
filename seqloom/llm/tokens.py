"""Exact whole-text encoding with the tokenizers library, word piece by word piece.

Both supported pre-tokenizers never build a token over a border from a non-space to a space
character. A text is therefore cut at those borders, each distinct piece is encoded by the library
once, and the ids are joined. Tokenizers of other kinds encode whole texts.

Texts whose spaces are lone blanks and line breaks go through numpy, half a megabyte at a time: all pieces are
hashed from prefix sums, looked up in a table of the pieces met before, compared byte by byte with what
the table holds, and their ids gathered. Other texts are cut by expressions, with a dictionary of pieces.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Unicode White_Space, which the tokenizers' expressions mean by ``\s`` (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HAS_SPACE = re.compile(f"[{SPACE}]")
#: Spaces besides blank and line break, and the character that marks keys.
_OTHER = [*"\t\x0b\x0c\r\x85\xa0\u1680", *map(chr, range(0x2000, 0x200B)), *"\u2028\u2029\u202f\u205f\u3000\0"]
_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: Characters at which Python splits and the expressions don't.
_ODD = re.compile("[\x1c-\x1f]").search


def _wide(text: str) -> bool:
    """Not every space is a lone blank or line break inside the text."""
    return text[0] in " \n" or text[-1] in " \n" or any(c in text for c in _OTHER) or any(c in text for c in _PAIRS)


def default_path(name: str) -> str:
    """The place of a vocabulary file of the installed public collection."""
    import public_tokenizers

    return public_tokenizers.path(name)

#: Byte-level BPE writes a byte as a printable character: itself, or one from 256 on.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SAME} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SAME)}


class _Pool:
    """A growing array."""

    def __init__(self, kind: str):
        self.data, self.n = np.empty(1 << 16, kind), 0

    def add(self, x: np.ndarray) -> int:
        """The place of the first of x."""
        at = self.n
        if at + len(x) > len(self.data):
            self.data = np.concatenate((self.data[:at], np.empty(max(at, len(x)), self.data.dtype)))
        self.data[at : at + len(x)] = x
        self.n += len(x)
        return at


class PieceTable:
    """Pieces by hash: their bytes and their ids."""

    def __init__(self):
        self.bits = 16
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.text_at, self.ids_at = _Pool("u8"), _Pool("u4"), _Pool("u4")
        self.text, self.ids = _Pool("u1"), _Pool("u4")
        self.text_at.add(np.zeros(1, np.uint32)), self.ids_at.add(np.zeros(1, np.uint32))

    def __len__(self) -> int:
        return self.hashes.n

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for hashes not met."""
        mask, hashes = len(self.slot) - 1, self.hashes.data
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slot[place]
        left = np.flatnonzero(out >= 0)
        left = left[hashes[out[left]] != h[left]]
        while len(left):
            place[left] = (place[left] + 1) & mask
            out[left] = self.slot[place[left]]
            left = left[out[left] >= 0]
            left = left[hashes[out[left]] != h[left]]
        return out

    def add(self, h: np.ndarray, text: bytes, text_ends: np.ndarray, ids: np.ndarray, id_ends: np.ndarray) -> None:
        """New pieces: hashes, none twice and none known, with their bytes and ids one after the other."""
        first = self.hashes.add(h)
        self.text_at.add(text_ends + self.text.add(np.frombuffer(text, np.uint8)))
        self.ids_at.add(id_ends + self.ids.add(ids))
        if self.hashes.n * 2 > len(self.slot):
            while self.hashes.n * 2 > 1 << self.bits:
                self.bits += 2
            self.slot = np.full(1 << self.bits, -1, np.int32)
            first, h = 0, self.hashes.data[: self.hashes.n]
        mask = len(self.slot) - 1
        left = np.arange(len(h))
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.slot[place] < 0
            self.slot[place[free]] = first + left[free]
            wait = self.slot[place] != first + left
            left, place = left[wait], (place[wait] + 1) & mask


_UP = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full((1 << 19) + (1 << 17), 0x9E3779B97F4A7C15, np.uint64))))
_DOWN = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(_UP) - 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_BYTE_HASH = _scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[1], ...: size[i] numbers from start[i] on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    At most ``limit`` pieces are remembered in the table (some 50 bytes each), a quarter as many in the
    dictionary; the memory then starts anew, which changes no result.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.limit, self.known, self.table = Tokenizer.from_file(path), limit, {}, PieceTable()
        self.mode = self._mode(json.loads(self.tok.to_str()))
        if self.mode == "lead":  # a piece is a run of spaces and the word after it
            self.cut, self.glue = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall, "\n"
            self.plain = re.compile(f" ?[^{SPACE}]+").fullmatch
            self.after_blank = re.compile(f" [^{SPACE}\0]+").fullmatch
        elif self.mode == "drop":  # spaces make no ids, A-Z is lower-cased
            self.cut, self.glue = re.compile(f"[^{SPACE}]+").findall, " | "
            self.plain = re.compile(f"[^{SPACE}|]+").fullmatch
        if self.mode:
            ids = self.tok.encode(self.glue, add_special_tokens=False).ids
            self.mark = ids[0] if len(ids) == 1 else None
            self.tok.model._resize_cache(0)
            letters = "A-Za-zÀ-ÖØ-öø-ÿ" if self.mode == "lead" else "a-zß-öø-ÿ"
            marks = "[\n\0]?" if self.mode == "lead" else ""
            self.simple = re.compile(f"\x01({marks})([{letters}]+)([.,]?)(?=\x01)").findall
            self.accents = [(c, c.encode().decode("latin-1").translate(_BYTES)) for c in map(chr, range(0xC0, 0x100)) if re.match(f"[{letters}]", c)]
            self.bytes = [(chr(b), x) for b, x in _BYTES.items() if x != chr(b) and b > 127]
            self.line_break = array("I", self.tok.encode("\n", add_special_tokens=False).ids).tobytes()
            self.letter = np.zeros(256, bool)  # ASCII letters that a simple word may have, and second bytes of others
            self.letter[[*range(97, 123), *(range(65, 91) if self.mode == "lead" else ())]] = True
            self.second = np.zeros(256, bool)
            self.second[[c.encode()[1] for c, _ in self.accents]] = True
            self.stops = {x: array("I", self.tok.encode(x, add_special_tokens=False).ids).tobytes() for x in ".,"}

    def pieces(self, text: str) -> list[str]:
        """The text's pieces as keys of ``known``.

        Mode lead: ``x`` means a blank and x, ``\\nx`` a line break and x, ``\\0x`` just x. The first
        key of a text whose blanks and breaks all stand alone has a line break too many.
        """
        if self.mode == "drop":
            text = text.encode("utf-8", "replace").lower().decode()  # ASCII only
            return self.cut(text) if _ODD(text) else text.split()
        if not text or _wide(text):
            return ["\n", *[p[1:] if self.after_blank(p) else "\0" + p for p in self.cut(text)]]
        return ("\n" + text.replace("\n", " \n")).split(" ")

    @staticmethod
    def _mode(spec: dict) -> str:
        if spec.get("model", {}).get("dropout") or any(_HAS_SPACE.search(t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            return ""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "lead"  # a line break alone is one id
        parts, norms = pre.get("pretokenizers", []), {n["type"] for n in (norm or {}).get("normalizers", [])}
        split = parts[0] if parts else {}
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"] and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "") and norms <= {"NFC", "Replace", "Lowercase"}:
            return "drop"
        return ""

    def _learn(self, pieces: list[str]) -> None:
        """Words of letters, with a full stop or comma or none, go straight to the library's BPE model; other pieces through the whole tokenizer."""
        known, model, lead = self.known, self.tok.model.tokenize, self.mode == "lead"
        text = "\1".join(["", *pieces, ""])
        found = self.simple(text) if text.count("\1") == len(pieces) + 1 else []
        if len(found) < len(pieces):
            self._learn_odd([*set(pieces).difference([before + word + stop for before, word, stop in found])] if found else pieces)
        bare = [*{(before, word) for before, word, _ in found if before + word not in known}]
        if bare:
            text = "\1".join([w for _, w in bare])
            for c, x in () if text.isascii() else self.accents:
                text = text.replace(c, x)
            ids: list[int] = []
            ends = [0]
            for (before, _), w in zip(bare, text.split("\1"), strict=True):
                ids += [t.id for t in model("\u0120" + w if lead and not before else w)]
                ends.append(4 * len(ids))
            raw, at = array("I", ids).tobytes(), 0
            for (before, word), hi in zip(bare, ends[1:], strict=True):
                known[before + word] = self.line_break + raw[at:hi] if before == "\n" else raw[at:hi]
                at = hi
        for before, word, stop in found:
            if stop:
                known[before + word + stop] = known[before + word] + self.stops[stop]

    def _learn_odd(self, pieces: list[str]) -> None:
        """Encodes pieces, many in one string where a mark can part them again."""
        if self.mode == "lead":
            names = {(p if p[:1] == "\n" else p[1:] if p[:1] == "\0" else " " + p): p for p in pieces}
        else:
            names = {p: p for p in pieces}
        plain = [p for p in names if self.mark is not None and self.plain(p)]
        rest = set(names).difference(plain) if len(plain) < len(names) else ()
        for at in range(0, len(plain), 6400):
            part = [plain[i : i + 64] for i in range(at, min(at + 6400, len(plain)), 64)]
            for group, e in zip(part, self.tok.encode_batch_fast([self.glue.join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) != len(group) - 1:  # a piece holds the mark itself
                    rest = {*rest, *group}
                    continue
                raw, lo = ids.tobytes(), 0
                for piece, hi in zip(group, [*(ends * 4).tolist(), len(raw)], strict=True):
                    self.known[names[piece]] = raw[lo:hi]
                    lo = hi + 4
        rest = list(rest)
        for at in range(0, len(rest), 1000):
            for piece, e in zip(rest[at : at + 1000], self.tok.encode_batch_fast(rest[at : at + 1000], add_special_tokens=False), strict=True):
                self.known[names[piece]] = np.array(e.ids, dtype="<u4").tobytes()

    def _fast(self, texts: list[str]) -> list[bytes]:
        """Texts of half a megabyte in all, whose spaces are blanks and line breaks; in mode lead not empty, and each space alone and inside."""
        lead, table = self.mode == "lead", self.table
        if len(table) > self.limit:
            table = self.table = PieceTable()
        data = [t.encode() for t in texts]
        if not lead:
            data = [t.lower() for t in data]
        raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        text_end = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) - 1
        end = np.flatnonzero((raw == 32) | (raw == 10))
        start = np.concatenate((np.zeros(1, np.int64), end[:-1] + 1))
        last = np.searchsorted(end, text_end)  # each text's last piece
        first = np.concatenate((np.zeros(1, np.int64), last[:-1] + 1))
        blank = np.ones(len(end), np.int64)  # 1: a blank belongs to the piece
        broken = np.zeros(len(end), bool)
        if lead:
            broken[1:] = raw[end[:-1]] == 10
            broken[first] = False
            blank[broken] = 0
            blank[first] = 0
        # Words of letters may carry a full stop or comma, which has an id of its own
        letter = self.letter[raw]
        accent = np.flatnonzero(raw[:-1] == 0xC3)
        accent = accent[self.second[raw[accent + 1]]]
        letter[accent] = letter[accent + 1] = True
        odd = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(~letter, out=odd[1:])
        tail = raw[np.maximum(end - 1, 0)]
        stop = np.where(tail == 46, 1, np.where(tail == 44, 2, 0))
        core = end - (stop > 0)
        simple = (core > start) & (odd[core] == odd[start])
        stop[~simple] = 0
        stop[start == end] = 0
        core = np.where(simple, core, end)
        size = core - start
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[raw] * _UP[: len(raw)], out=total[1:])
        h = _scramble((total[core] - total[start]) * _DOWN[start] + (size * 2 + blank).astype(np.uint64))
        full = size > 0
        number = table.find(h)
        new = np.flatnonzero((number < 0) & full)
        if len(new):
            one = new[np.unique(h[new], return_index=True)[1]]
            self._learn_new(raw, start[one], core[one], simple[one], blank[one], h[one])
            number[new] = table.find(h[new])
        number[~full] = -1
        # What the table holds must be these very bytes
        known = np.flatnonzero(full)
        at = table.text_at.data[number[known]].astype(np.int64)
        held = table.text_at.data[number[known] + 1] - at
        same = held == size[known]
        if same.all():
            differs = table.text.data[_spans(at, size[known])] != raw[_spans(start[known], size[known])]
            if differs.any():
                same[np.searchsorted(np.cumsum(size[known]), np.flatnonzero(differs), side="right")] = False
        if not same.all():  # two pieces of one hash
            return self._slow(texts)
        id_at = np.zeros(len(end), np.int64)
        id_n = np.zeros(len(end), np.int64)
        id_at[known] = table.ids_at.data[number[known]]
        id_n[known] = table.ids_at.data[number[known] + 1] - id_at[known]
        whole = id_n + broken + (stop > 0)
        to = np.cumsum(whole)
        out = np.empty(to[-1] if len(to) else 0, "<u4")
        if lead:
            out[(to - whole)[broken]] = np.frombuffer(self.line_break, np.uint32)[0]
        for k, mark in ((1, "."), (2, ",")):
            out[to[stop == k] - 1] = np.frombuffer(self.stops[mark], np.uint32)[0]
        out[_spans(to - whole + broken, id_n)] = table.ids.data[_spans(id_at, id_n)]
        buffer, ends = out.tobytes(), (to[last] * 4).tolist()
        return [buffer[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def _learn_new(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, simple: np.ndarray, blank: np.ndarray, h: np.ndarray) -> None:
        """Puts pieces into the table: words of letters by the library's BPE model, others by the whole tokenizer."""
        data, lead = raw.tobytes(), self.mode == "lead"
        order = np.argsort(~simple, kind="stable")
        start, end, blank, h = start[order], end[order], blank[order], h[order]
        n = int(simple.sum())
        pieces = [data[lo:hi] for lo, hi in zip(start.tolist(), end.tolist())]
        text = b"\1".join(pieces[:n]).decode("latin-1")
        for c, x in () if text.isascii() else self.bytes:
            text = text.replace(c, x)
        model = self.tok.model.tokenize
        ids: list[int] = []
        ends = []
        for w, b in zip(text.split("\1") if n else (), blank[:n].tolist()):
            ids += [t.id for t in model("\u0120" + w if lead and b else w)]
            ends.append(len(ids))
        rest = [p.decode() for p in pieces[n:]]
        if lead:
            rest = [p if b else "\0" + p for p, b in zip(rest, blank[n:].tolist())]
        if len(self.known) > self.limit // 4:
            self.known.clear()
        unknown = [p for p in rest if p not in self.known]
        if unknown:
            self._learn_odd(unknown)
        for p in rest:
            ids += memoryview(self.known.pop(p)).cast("I").tolist()  # the table keeps it
            ends.append(len(ids))
        self.table.add(h, b"".join(pieces), np.cumsum(end - start), np.array(ids, np.uint32), np.array(ends, np.int64))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.mode:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = [b""] * len(texts)
        groups: dict[bool, list[int]] = {True: [], False: []}
        sizes = {True: 0, False: 0}
        for i, text in enumerate(texts):  # groups of half a megabyte at most, but for longer texts
            size = len(text) + 1 if text.isascii() else 4 * len(text) + 1
            plain = not any(c in text for c in _OTHER) if self.mode == "drop" else bool(text) and not _wide(text)
            fast = plain and size < 1 << 19 and "\1" not in text
            if groups[fast] and size + sizes[fast] > 1 << 19:
                self._put(out, texts, groups[fast], fast)
                groups[fast], sizes[fast] = [], 0
            groups[fast].append(i)
            sizes[fast] += size
        for fast, group in groups.items():
            self._put(out, texts, group, fast)
        return out

    def _put(self, out: list[bytes], texts: list[str], group: list[int], fast: bool) -> None:
        if group:
            part = [texts[i] for i in group]
            for i, raw in zip(group, self._fast(part) if fast else self._slow(part), strict=True):
                out[i] = raw

    def _slow(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit // 4:
            self.known.clear()
        cut = [self.pieces(t) for t in texts]
        known = self.known
        new = [p for p in set().union(*cut) if p not in known]
        if new:
            self._learn(new)
        get = self.known.__getitem__
        skip = 4 if self.mode == "lead" else 0
        return [b"".join(map(get, pieces))[skip:] for pieces in cut]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
