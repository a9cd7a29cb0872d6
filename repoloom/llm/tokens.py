"""Token ids of whole texts by a word-level tokenizer file, each distinct word encoded once per worker.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words in order. Arrow parts the texts and finds the distinct words,
a sign that ends a word is one for itself. New words of common Latin letters and
signs are lowered and parted into the runs that the tokenizer itself forms:
letters, single digits, signs. A word with any other character (marks that compose,
letters whose lower form is longer, other scripts, the sign of special tokens)
goes to the tokenizer whole.
"""

from __future__ import annotations

import codecs
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that every part of the tokenizer takes as such.
PLAIN = " \t\n\r"
#: Letters whose lower form is one letter in every library, and which no mark composes with unless it stands in the text.
LETTERS = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)]) if c.isalpha() and len(c.lower()) == 1)
SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "|")
_ODD = re.compile(f"[^{re.escape(LETTERS + SIGNS)}0-9{PLAIN}]")
#: What the tokenizer parts lowered words into; between words a line break.
_RUNS = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{''.join(sorted(set(LETTERS.lower())))}]+|[0-9]|[{re.escape(SIGNS)}]+")
#: One sign that ends a word of a letter or digit before: the tokenizer parts it, so it can be a word for itself.
_LAST = f"([{re.escape(LETTERS)}0-9])([.,;:!?]) "
#: No id has these bytes, at no alignment, as ids stay below 2^24.
_BREAK = b"\xff\xff\xff\xff"
#: Characters after which a long text is cut at the next white space, and that short ones are encoded together up to.
_LONG = 1 << 18


def _stretches(text: str) -> Iterator[str]:
    """A text in stretches of about ``_LONG`` characters, cut at white space."""
    at = 0
    while len(text) - at > _LONG:
        cut = re.compile(f"[{PLAIN}]").search(text, at + _LONG)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, in lists of at most ``_LONG`` characters; a longer text has one for itself."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > _LONG:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


class Encoder:
    """Ids of texts; words met in two calls are kept, in two generations of at most ``most``, frequent ones move to the newer.

    Many words of a corpus are met once. They would fill a worker's memory, which stays taken while the worker lives; so
    of those only the last ``most // 2`` wait to be met again.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        spelled = {byte: sign for c in LETTERS + SIGNS + "0123456789" for byte, sign in zip(c.encode(), spell(c)[0][0], strict=True)}
        #: Bytes as the tokenizer spells them, by place; between runs a line break; no sign for bytes that no run has.
        self.spelling = "".join({**spelled, 10: "\n"}.get(byte, "\ufffe") for byte in range(256))
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        #: Ids by word, and by run of one kind inside words of several.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"\n": _BREAK}

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words as the tokenizer itself takes them."""
        for first in range(0, len(words), 8192):
            part = words[first : first + 8192]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            cuts = 4 * np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part) + 1))
            ids = np.array(got.ids, dtype="<u4").tobytes()
            yield from (ids[a:b] for a, b in itertools.pairwise(cuts.tolist()))

    def _of_runs(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """Runs of one kind with the ids of their lowered form."""
        raw, tokenize = self.raw, self.tokenizer.model.tokenize
        spelled, _ = codecs.charmap_decode("\n".join(runs).lower().encode(), "strict", self.spelling)
        return ((run, b"".join([raw[t.id] for t in tokenize(s)])) for run, s in zip(runs, spelled.split("\n")))  # of no runs, split leaves one

    def _by_runs(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of plain characters with their ids: lowered, parted into runs, and the runs' ids joined again."""
        found = _RUNS.findall("\n".join(words).lower())
        if 4 * len(self.runs) > self.most:
            self.runs = {"\n": _BREAK}
        self.runs.update(self._of_runs(list(set(found).difference(self.runs))))
        return zip(words, b"".join(map(self.runs.__getitem__, found)).split(_BREAK))

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those met before are known from now on."""
        if len(self.known) > self.most:
            self.known, self.older = {"": b""}, self.known
        if 2 * len(self.once) > self.most:
            self.once = dict(itertools.islice(self.once.items(), len(self.once) // 2, None))
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        met = {w: self.older[w] for w in missing if w in self.older}
        met.update((w, self.once.pop(w)) for w in missing if w in self.once)
        new = [w for w in missing if w not in met]
        odd = list(filter(_ODD.search, new)) if _ODD.search("\n".join(new)) else []
        fresh = dict(zip(odd, self._whole(odd), strict=True))
        plain = [w for w in new if w not in fresh] if odd else new
        fresh.update(self._of_runs(list(filter(str.isalpha, plain))))
        fresh.update(self._by_runs([w for w in plain if not w.isalpha()]))
        self.once.update(fresh)
        self.known.update(met)
        fresh.update(met)
        return [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = []
        for part in parts(texts):
            if len(part) == 1 and len(part[0]) > _LONG:
                found.append(b"".join(self._encode([s])[0] for s in _stretches(part[0])))
            else:
                found += self._encode(part)
        return found

    def _encode(self, texts: list[str]) -> list[bytes]:
        given = pa.array(texts, pa.large_string())
        plain = pc.if_else(pc.match_substring_regex(given, _ODD.pattern), given, pc.utf8_lower(given))
        for space in PLAIN.strip(" "):
            plain = pc.replace_substring(plain, space, " ")
        words = pc.split_pattern(pc.replace_substring_regex(plain, _LAST, r"\1 \2 "), " ")
        distinct = words.values.dictionary_encode()
        ids = pa.array(self._ids(distinct.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(distinct.indices)
        _, ends, data = ids.buffers()
        cuts = np.frombuffer(ends, dtype=np.int64)[words.offsets.to_numpy()]
        return [data[a:b].to_pybytes() for a, b in itertools.pairwise(cuts.tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
