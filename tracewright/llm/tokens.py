"""Token ids of whole texts by the tokenizers library, one pre-token at a time.

Byte-level BPE splits a text into pre-tokens (words with their leading space, digits, marks, white
space) before it merges anything within each. Pre-tokens repeat far more often than texts do, so
each worker keeps the ids that the library's BPE model gave for those it has seen, and for the stretches from
one space to the next. Of many texts at a time, each distinct stretch is looked up once. In texts of
Latin-1 characters the split needs no Unicode tables and is done here; in other texts, the
stretches between spaces that hold other characters take the library's whole path, which is
possible as a pre-token always starts at a space that a visible character follows. Texts that hold
the string of an added token, and all texts under vocabulary files of another make (a normalizer,
another pre-tokenizer, word ends), take the library's whole path.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches of text in a generation; a worker keeps two of them. Only speed and memory depend on it (some 200 bytes a stretch).
CACHE_WORDS = 600_000
#: Longer ones are encoded each time and not kept.
CACHE_CHARS = 64
#: Longer texts are encoded one by one.
TOGETHER_CHARS = 1 << 20
#: Rows and bytes of texts that are encoded together.
TOGETHER = (2048, 8 << 20)

#: Letters, digits and white space of Latin-1, and English endings after an apostrophe.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_PRE_TOKEN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: A space that a cut may not be made at, as white space or nothing follows.
_NO_CUT = re.compile(" (?:[\\t-\\r \u0085\u00a0]|$(?!\\n))")
_CUT = re.compile(" (?=[!-~\u00a1-\u00ff])")
#: The printable stand-in of each byte in byte-level BPE: itself where visible, else the next code point from 256.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
_STAND_IN = {b: 256 + k for k, b in enumerate(_HIDDEN)}
_SPACE = chr(_STAND_IN[0x20])


def _is_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _is_plain_byte_level(path: str) -> bool:
    """Whether a vocabulary file splits texts by the byte-level pattern alone and merges within pre-tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    by_pattern = split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    outer = ("normalizer", "truncation", "padding")
    return bool(by_pattern and model.get("type") == "BPE" and not any(model.get(k) for k in odd) and not any(spec.get(k) for k in outer))


class _KnownWords(dict):
    """Ids of stretches of text, made when first asked for.

    A full generation becomes the older one, from which what is asked for again moves on, so that frequent
    stretches outlive the many that occur once.
    """

    def __init__(self, make: Callable[[str], bytes], words: int):
        self.make, self.words, self.older = make, words, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.words:
                self.older = self.copy()
                self.clear()
            self[word] = ids
        return ids


class PreTokenEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers in bytes.

    They are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the string
    of a special token in a text is that token. With ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, words: int | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.whole = not _is_plain_byte_level(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        self.model = self.tokenizer.model
        self.known = _KnownWords(self._word, words or CACHE_WORDS)

    def _word(self, word: str) -> bytes:
        words = _PRE_TOKEN.findall(word)
        if len(words) > 1:
            return b"".join(map(self.known.__getitem__, words))
        if word.isascii() and word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            shown = word.replace(" ", _SPACE)
        else:
            shown = word.encode().decode("latin-1").translate(_STAND_IN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _latin1(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _PRE_TOKEN.findall(text)))

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _splits(self, text: str | None) -> bool:
        """Whether a text is made of Latin-1 stretches that each begin at a single space."""
        return bool(text) and len(text) <= TOGETHER_CHARS and _is_latin1(text) and not _NO_CUT.search(text) and not any(t in text for t in self.added)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """As ``encode`` for each text, null ones included."""
        known = texts.to_pylist()
        split = [not self.whole and self._splits(t) for t in known]
        own = [t for t, yes in zip(known, split) if yes]
        if not own:
            return [self.encode(t) for t in known]
        lists = pc.split_pattern(texts.filter(pa.array(split)), " ")
        found = lists.flatten().dictionary_encode()
        # the first stretch of a text has no space before it
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        values = list(map(self.known.__getitem__, map(" ".__add__, found.dictionary.to_numpy(zero_copy_only=False))))
        code = found.indices.to_numpy().astype(np.int64)
        code[first] = len(values) + np.arange(len(own))
        values += [self._latin1(t[: t.find(" ")] if " " in t else t) for t in own]
        ids, size = np.frombuffer(b"".join(values), np.uint32), np.fromiter(map(len, values), np.int64, len(values)) // 4
        n = size[code]
        ids = ids[np.repeat((np.cumsum(size) - size)[code] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        raw, end = ids.tobytes(), 4 * np.cumsum(np.add.reduceat(n, first))
        done = iter([raw[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist())])
        return [next(done) if yes else self.encode(t) for t, yes in zip(known, split)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole or any(t in text for t in self.added):
            return self._library(text)
        if _is_latin1(text):
            return self._latin1(text)
        cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
        out, run = [], 0
        for a, b in zip(cuts[:-1], cuts[1:]):
            if not _is_latin1(text[a:b]):
                if run < a:
                    out.append(self._latin1(text[run:a]))
                out.append(self._library(text[a:b]))
                run = b
        if run < len(text):
            out.append(self._latin1(text[run:]))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False, words: int | None = None) -> PreTokenEncoder:
    """One encoder for each worker, vocabulary file and number of kept stretches."""
    return PreTokenEncoder(path, special_as_text, words)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
