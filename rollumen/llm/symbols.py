"""A word tokenizer's merges over symbols, for whole lots of texts at once.

The tokenizer file describes byte pairs with word ends: a text is normalised (composed, lower case), parted into pieces
(a contraction, letters, one number, other marks), and the last byte of each piece is a symbol of its own. Here numpy parts
the pieces, every symbol becomes one character, and a rank table over these characters merges all pieces of a lot in
one call. Ranks give the tokenizer's own ids: each token has one merge, ids follow the order of merges, and every token is what
its own characters encode to, so taking the lowest rank first takes the same merges.

Characters whose class and lower case are plain (ASCII, Latin, general punctuation) are known; a word (between white space)
with any other, with a very long piece or with a special token in it is handed back to the caller.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: What the tokenizer file must say for the rules below to be its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SUFFIX = "</w>"

LETTER, NUMBER, SPACE, MARK, OTHER = range(5)
LIMIT, LONGEST = 0x2060, 200
#: Characters that stand for a word handed back, and for the end of a text.
WORD, STOP = 0x20, 0x7F
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_WHITE = re.compile(r"[ \t\n\v\f\r]")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each character below LIMIT; the last entry is for all others."""
    kind, low = np.full(LIMIT + 1, OTHER, np.uint8), np.arange(LIMIT + 1, dtype=np.uint16)
    for c in [*range(33, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        lower, group = chr(c).lower(), unicodedata.category(chr(c))[0]
        if len(lower) == 1 and ord(lower) < LIMIT and unicodedata.is_normalized("NFC", chr(c)) and c != 0xAD:
            kind[c] = {"L": LETTER, "N": NUMBER}.get(group, MARK)
            low[c] = ord(lower)
    kind[[9, 10, 11, 12, 13, 32]] = SPACE
    return kind, low


KIND, LOWER = _tables()


def symbol(byte: int, last: bool) -> str:
    """The character for a byte within a piece, or at its end."""
    if byte >= 128:
        return chr((0x200 if last else 0x100) + byte)
    if not last or chr(byte).isdigit():
        return chr(byte)
    return chr(byte - 32) if chr(byte).islower() else chr(_MARKS.index(byte))


#: Characters of ASCII bytes: within a piece, then at its end.
_ASCII = np.zeros(256, np.uint16)
for _c in [*range(48, 58), *range(97, 123), *_MARKS]:
    _ASCII[_c], _ASCII[128 + _c] = ord(symbol(_c, False)), ord(symbol(_c, True))

_PIECE = r"[a-z!-/:-@\[-`{-~" + "ƀ-ǿ" + r"]*[A-Z0-9\x00-\x20\x7f" + "ʀ-˿]"


def byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def parts(texts: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """Texts, long ones cut at white space after `most` characters, and which text each part is of."""
    out, owner = [], []
    for k, text in enumerate(texts):
        a = 0
        while len(text) - a > most and (m := _WHITE.search(text, a + most)):
            out.append(text[a : m.start()])
            owner.append(k)
            a = m.start()
        out.append(text[a:])
        owner.append(k)
    return out, np.array(owner, np.int64)


class Coder:
    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], special: list[str]) -> None:
        import tiktoken

        table: dict[str, str] = {}
        for char, byte in byte_of().items():
            for text, last in ((char, False), (char + SUFFIX, True)):
                known = byte >= 128 or byte in _MARKS or chr(byte).isdigit() and last or chr(byte).islower()
                if known and text in ids:
                    table[text] = symbol(byte, last)
        for a, b in merges:
            if a in table and b in table:
                table[a + b] = table[a] + table[b]
        ranks = {s.encode(): ids[t] for t, s in table.items()}
        self.word, self.stop = max(ids.values()) + 1 + len(special), max(ids.values()) + 2 + len(special)
        ranks |= {bytes([WORD]): self.word, bytes([STOP]): self.stop}
        self.own = tiktoken.Encoding("symbols", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    @classmethod
    def of_file(cls, path: str) -> Coder | None:
        """None if the file says anything that the rules here don't cover."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model.get("merges", [])]
        ids = model.get("vocab", {})
        fits = (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == SUFFIX
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and spec["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER}
            and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [split, level]}
            and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
            and len(ids) == 512 + len(merges)
            and all(ids.get(a + b) == 512 + k for k, (a, b) in enumerate(merges))
        )
        return cls(ids, merges, [t["content"] for t in spec["added_tokens"]]) if fits else None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts one after the other, places of the texts' ends, places of words handed back, these words."""
        whole = "\n".join(texts) + "\n"
        code = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kind, low = KIND.take(code, mode="clip"), LOWER.take(code, mode="clip")
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        last = self.ends(kind, low)
        at, odd = self.handed_back(whole, kind, last)
        kept = kind != SPACE
        kept[stops] = True
        kept[at] = True
        chars = low[kept]
        # after the space class is gone, these two are what a kept space can be
        marks = np.zeros(len(whole), np.uint8)
        marks[stops], marks[at] = STOP, WORD
        ids = np.asarray(self.own.encode_to_numpy(characters(chars, last[kept], marks[kept]), disallowed_special=()))
        return ids, np.flatnonzero(ids == self.stop), np.flatnonzero(ids == self.word), odd

    @staticmethod
    def ends(kind: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which characters end a piece."""
        letter, mark = kind == LETTER, kind == MARK
        last = kind == NUMBER
        last[:-1] |= (letter[:-1] & ~letter[1:]) | (mark[:-1] & ~mark[1:])
        # contractions: an apostrophe that no mark comes before, with letters that go with it
        at = np.flatnonzero(low == 39)
        if len(at):
            at = at[~mark[np.maximum(at - 1, 0)] | (at == 0)]
            n = len(low) - 1
            one, two = low[np.minimum(at + 1, n)], low[np.minimum(at + 2, n)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            last[at[short | pair]] = False
            last[at[short] + 1] = True
            last[at[pair] + 2] = True
        return last

    def handed_back(self, whole: str, kind: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Where words begin that aren't known here, and the words; their characters become white space in kind."""
        bad = [np.flatnonzero(kind == OTHER)]
        ends = np.flatnonzero(last)
        long = np.diff(ends, prepend=-1) > LONGEST
        bad.append(ends[long])
        if self.special is not None and "<" in whole:
            bad.append(np.array([m.start() for m in self.special.finditer(whole)], np.int64))
        at = np.unique(np.concatenate(bad).astype(np.int64))
        if not len(at):
            return at, []
        white = np.flatnonzero(kind == SPACE)
        stop = np.searchsorted(white, at)
        stop = stop[np.append(True, stop[1:] != stop[:-1])]
        begin, end = np.where(stop > 0, white[stop - 1] + 1, 0), white[stop]
        cover = np.zeros(len(kind) + 1, np.int8)
        cover[begin] = 1
        np.add.at(cover, end, -1)
        kind[np.cumsum(cover[:-1], dtype=np.int8) > 0] = SPACE
        return begin, [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]


def characters(low: np.ndarray, last: np.ndarray, marks: np.ndarray) -> str:
    """One character for each byte of the characters `low`, in UTF-8; marks stand for themselves."""
    ascii_ = _ASCII.take(np.minimum(low, 127) + np.where(last, 128, 0))
    np.copyto(ascii_, marks, where=marks > 0)
    wide = np.flatnonzero((low >= 128) & (marks == 0))
    if not len(wide):
        return ascii_.astype(np.uint8).tobytes().decode("ascii")
    size = np.ones(len(low), np.int64)
    size[wide] += 1 + (low[wide] >= 0x800)
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]), "<u2")
    out[stop - 1] = ascii_
    c, at = low[wide], stop[wide] - 1
    out[at] = np.where(last[wide], 0x200, 0x100) + (0x80 | c & 63)
    two = c < 0x800
    out[at[two] - 1] = 0x100 + (0xC0 | c[two] >> 6)
    out[at[~two] - 1] = 0x100 + (0x80 | c[~two] >> 6 & 63)
    out[at[~two] - 2] = 0x100 + (0xE0 | c[~two] >> 12)
    return out.tobytes().decode("utf-16-le")
