"""Encoding through a cache of words, for tokenizers that never look across a cut.

A text is cut where the tokenizer's own pre-splitting always cuts; each
distinct part is encoded once by the library and remembered.  The cache keeps
two generations of bounded size, so frequent parts stay and memory is bounded.

Where spaces belong to the word after them, parts are written without it: a
part ``w`` stands for ``" " + w`` and ``RAW + w`` for ``w`` itself.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Callable

#: Parts kept in the young generation; the old one holds as many.
CACHE = 800_000
#: Longer parts are encoded without being remembered.
LONGEST = 80
#: Texts above this many characters are cut into segments, so lists stay small.
SEGMENT = 1 << 20
RAW = "\x00"
_SEGMENT_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE_BPE_PARTS = re.compile(r"\s+(?!\S)| ?\S+|\s")
_SPACE_RUNS = re.compile(r" *[^ ]+| +")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", RAW)  # white space to Python but not to Unicode, and the mark for raw parts
#: A word and signs after it, which byte-level BPE always parts (an apostrophe may belong to the word).
_WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([.,;:!?|*&%$#()\[\]\"]+)")


def segments(text: str) -> list[str]:
    """Parts of a long text, cut before single spaces between words."""
    out, at = [], 0
    while len(text) - at > SEGMENT:
        m = _SEGMENT_CUT.search(text, at + SEGMENT)
        if m is None:
            break
        out.append(text[at:m.start()])
        at = m.start()
    out.append(text[at:] if at else text)
    return out


def _odd(text: str) -> bool:
    return any(c in text for c in _ODD)


def _marked(parts: list[str]) -> list[str]:
    return [p[1:] if p[0] == " " else RAW + p for p in parts]


def word_parts(text: str) -> list[str]:
    """For tokenizers that drop white space: the words."""
    return [text] if _odd(text) else text.split()


def byte_bpe_parts(text: str) -> list[str]:
    """For byte-level BPE: words with the space before them, white space runs apart.

    Where all white space is single spaces and line breaks between words, cutting
    at each space is the same and quicker.
    """
    if _odd(text):
        return [RAW + text]
    if len(text.split()) == text.count(" ") + text.count("\n") + 1:
        parts = text.split(" ")
        parts[0] = RAW + parts[0]
        return parts
    return _marked(_BYTE_BPE_PARTS.findall(text))


def space_parts(text: str) -> list[str]:
    """For piece models: runs of spaces with the word after them."""
    if RAW in text:
        return [RAW + text]
    if "  " in text or text[-1:] == " ":
        return _marked(_SPACE_RUNS.findall(text))
    first, *rest = text.split(" ")
    return [RAW + first, *rest] if first else rest


class WordCache(dict):
    """Maps parts to their ids as little-endian unsigned 32-bit bytes, encoding each at first sight."""

    def __init__(self, parts: Callable[[str], list[str]], encode_part: Callable[[str], bytes], limit: int = CACHE):
        super().__init__()
        self.parts, self.encode_part, self.limit = parts, encode_part, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode_part(part)
            if len(part) > LONGEST or "\n" in part:
                return ids
        self[part] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in order."""
        out, get = [], self.__getitem__
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and every collection would walk the cache
        try:
            for t in texts:
                if len(t) > SEGMENT:
                    out.append(b"".join([b"".join(map(get, self.parts(s))) for s in segments(t)]))
                else:
                    out.append(b"".join(map(get, self.parts(t))))
                if len(self) > self.limit:
                    self.old = dict(self)
                    self.clear()
        finally:
            if collecting:
                gc.enable()
        return out


def _ranks(path: str) -> tuple[dict[bytes, int], str] | None:
    """Tokens of a byte BPE file as bytes with their ids, where the ids are in merge order; and the end-of-word mark.

    Bytes that end a word carry NUL behind them.  None if the file is of another kind.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
        return None
    byte_of, vocab, ranks = {c: b for b, c in enumerate(_byte_letters())}, model["vocab"], {}
    for token, i in vocab.items():
        ends = bool(suffix) and token.endswith(suffix) and len(token) > len(suffix)
        letters = token[:len(token) - len(suffix)] if ends else token
        if all(c in byte_of for c in letters) and not (suffix and byte_of.get("\u0100") in map(byte_of.get, letters)):
            ranks[bytes(map(byte_of.get, letters)) + (b"\0" if ends else b"")] = i
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [i for t, i in ranks.items() if len(t.rstrip(b"\0")) <= 1]
    if merged != sorted(set(merged)) or not merged or max(single) >= merged[0] or len(single) < 256 * (2 if suffix else 1) - 2:
        return None
    if suffix:
        ranks[b"\0"] = vocab[_byte_letters()[0]]  # never left over: every byte takes the NUL behind it first
    return ranks, suffix


#: How byte-level BPE parts a text; fixed value.
_BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are looked through for runs of ``LONG_RUN`` characters without a cut.
LONG_TEXT, LONG_RUN = 100_000, 2000


class TextEncoder:
    """Whole texts by a quicker library with the same tokens; texts it might part differently go through the words."""

    def __init__(self, ranks: dict[bytes, int], words: WordCache):
        import tiktoken

        self.encode_text = tiktoken.Encoding("bytes", pat_str=_BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        self.words, self.none = words, set()

    @staticmethod
    def plain(text: str) -> bool:
        """Letters that every version of Unicode has alike, and no run without a cut that is very long."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                if max(text) >= "\u0250":
                    return False
        if _odd(text):
            return False
        if len(text) > LONG_TEXT:
            words = text.split()
            spaces = len(text) - sum(map(len, words)) - len(words)
            return spaces < LONG_RUN and max(map(len, words), default=0) < LONG_RUN
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.plain(t):
                out.append(b"".join([bytes(self.encode_text(x, self.none)) for x in segments(t)]))
            else:
                out += self.words.encode([t])
        return out


def library_encoder(path: str, parts: Callable[[str], list[str]]) -> WordCache | TextEncoder:
    """A tokenizers file behind a ``WordCache``; special tokens in texts are ordinary text.

    A part of letters only is one word to the pre-splitting, so its bytes go
    straight to the merges.  Words around line
    breaks, and a word with signs after it, are parts of their own; all else
    takes the library's whole way.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    model, spaced = tok.model, parts is not word_parts
    model._resize_cache(0)  # every part is seen once here
    found = _ranks(path)
    if found:
        import tiktoken

        merge = tiktoken.Encoding("parts", pat_str=r"(?s:.+)", mergeable_ranks=found[0], special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        end, none = "\0" if found[1] else "", set()
    normalise = tok.normalizer.normalize_str if tok.normalizer else None
    letters = _byte_letters()
    space, mark = letters[32], RAW if spaced else ""

    def whole(raw: str) -> bytes:
        return array("I", tok.encode(raw, add_special_tokens=False).ids).tobytes()

    def one(part: str) -> bytes:
        lead = spaced and part[:1] != RAW
        word = part if lead or not spaced else part[1:]
        if word.isalpha():
            if normalise:
                word = word.lower() if word.isascii() else normalise(word)
                if not word.isalpha():
                    return whole(word)
            if found:
                return bytes(merge((" " + word if lead else word) + end, none))
            text = word if word.isascii() else "".join(map(letters.__getitem__, word.encode()))
            return array("I", [t.id for t in model.tokenize(space + text if lead else text)]).tobytes()
        if spaced and "\n" in word and len(word.split()) == word.count("\n") + 1:
            first, *rest = word.split("\n")
            line = cache.line
            return cache[first if lead else RAW + first] + b"".join([line + cache[RAW + w] for w in rest])
        m = _WORD_AND_SIGNS.fullmatch(word)
        if m and m[1].isalpha():
            return cache[part[:-len(m[2])]] + cache[mark + m[2]]
        return whole(" " + word if lead else word)

    cache = WordCache(parts, one)
    cache.line = whole("\n")
    if found and spaced and _byte_level(path):
        return TextEncoder(found[0], cache)
    return cache


def _byte_level(path: str) -> bool:
    """Whether a tokenizers file parts texts by the byte-level pattern and changes nothing before."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre = file.get("pre_tokenizer") or {}
    return file.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def _byte_letters() -> list[str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_ENCODERS: dict[tuple, WordCache | TextEncoder] = {}


def cached_encoder(path: str, parts: Callable[[str], list[str]]) -> WordCache | TextEncoder:
    """One encoder for each worker process and file."""
    key = (path, parts.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = library_encoder(path, parts)
    return _ENCODERS[key]
