"""Token ids of whole texts by a tokenizers file, with a bounded memory of words already seen.

A byte-level BPE splits a text into pre-tokens and merges within each, and no pre-token runs from a character
that isn't white space on to white space. So a text may be cut before a space or line end that follows other
than white space, and the ids of the cuts, one after another, are the ids of the text. Texts whose only white
space is single spaces and line ends inside are cut there; each cut not yet known goes to the library, all of
a batch as one string. Any other text goes to the library whole, as does one that holds a special token's literal,
and every text where the file is not a byte-level BPE that leaves texts as they are.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Cuts remembered by a worker for the tasks of one job; those met later are encoded each time.
REMEMBERED = 400_000
#: Characters of text that are cut at once.
AT_ONCE = 1 << 20
#: White space other than the space and the line end.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class Ids:
    """Ids by the tokenizer at path; special tokens' literals in a text are split like other text if split_special."""

    def __init__(self, path: str, split_special: bool = True):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = split_special
        added = self.library.get_added_tokens_decoder().values()
        self.literals = [] if split_special else [t.content for t in added if t.special and t.content]
        made = json.loads(self.library.to_str())
        before = made.get("pre_tokenizer") or {}
        #: whether ids of cuts make the ids of a text: BPE within pre-tokens of bytes, nothing added in front
        self.cuts = made["model"]["type"] == "BPE" and not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.cuts = self.cuts and not made["model"].get("dropout") and not any(made["model"].get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a character for each byte
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cuts: list[str]) -> dict[str, bytes]:
        """Ids of cuts that begin with a line end, or else with a space that is not written."""
        parts = [c if c[0] == "\n" else " " + c for c in cuts]
        ids = self._whole(["".join(parts)])[0]
        ends = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
        at = 4 * np.searchsorted(ends, np.cumsum([len(p.encode()) for p in parts]) - 1, "right") + 4
        lo, out = 0, {}
        for c, hi in zip(cuts, at.tolist(), strict=True):
            out[c] = ids[lo:hi]
            lo = hi
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        out, lo, size = [], 0, 0
        for hi, text in enumerate(texts, 1):
            size += len(text)
            if size >= AT_ONCE or hi == len(texts):
                out += self._encode(texts[lo:hi])
                lo, size = hi, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        rows, heads, ends, cuts, whole = [], [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            own = text.replace("\n", " \n").split(" ") if self.cuts else [""]
            if "" in own or "\n" in own or any(c in text for c in _OTHER_SPACE) or any(x in text for x in self.literals):
                whole.append(i)
                continue
            rows.append(i)
            heads.append(own[0])
            cuts += own[1:]
            ends.append(len(cuts))
        for i, x in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = x
        ids = list(map(self.known.get, cuts))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            new = self._learn(list(dict.fromkeys([cuts[k] for k in missing])))
            for k in missing:
                ids[k] = new[cuts[k]]
            if len(self.known) + len(new) <= REMEMBERED:
                self.known.update(new)
        lo = 0
        for i, head, hi in zip(rows, self._whole(heads), ends, strict=True):
            out[i] = head + b"".join(ids[lo:hi])
            lo = hi
        return out


@lru_cache(maxsize=1)
def ids_of(path: str, job: str = "") -> Ids:
    """Ids as the library gives them by default. A worker keeps one job's memory at a time."""
    return Ids(path, split_special=False)
