"""Token ids of whole texts by byte-level BPE.

Where a tokenizer's ids are also its merge order, the same vocabulary is handed to
the faster library that merges by rank; its ids are the same (the tests compare
them).  Special strings are cut out first, as the library does by default, and very long
runs without a boundary are left to that library.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

from .token_counts import BYTE_CHARS

#: Fixed: how byte-level BPE cuts a text, and the characters it counts as white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Where a text may be cut with no change: before a single space between two other characters.
SEAM = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")
#: Characters encoded at a time, about.
SLAB = 1 << 20
#: A run of white space, or of anything else, of RUN characters or more: the faster library takes quadratic time or stack for it.
RUN = 4096
HARD = re.compile(f"(?<![{BLANK}])[{BLANK}]{{{RUN},}}|(?<![^{BLANK}])[^{BLANK}]{{{RUN},}}")


def _hard(text: str) -> list[tuple[int, int]]:
    """Where runs of RUN characters or more begin and end, with what belongs to their pieces.

    The last blank of a run goes with what follows it, and a run of anything else takes the blank before it.
    """
    # Such a run holds one of these windows whole; most windows have a space early on, and begin with a letter.
    windows = (text[a : a + RUN // 2] for a in range(0, len(text) - RUN // 2 + 1, RUN // 2)) if len(text) >= RUN else ()
    if not any(" " not in w or w.isspace() for w in windows):
        return []
    out, at = [], 0
    for m in HARD.finditer(text):
        a, b = m.span()
        a, b = (a, b - (b < len(text))) if _blank(text[a]) else (max(at, a - 1), b)
        out.append((a, b))
        at = b
    return out


def _blank(character: str) -> bool:
    return bool(re.match(f"[{BLANK}]", character))


def id_type(tokenizer_json: str) -> np.dtype:
    """The least type that holds the vocabulary's ids: of 16 or of 32 bits, little-endian."""
    spec = json.loads(tokenizer_json)
    most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])], default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def _by_rank(tokenizer_json: str):
    """The vocabulary for the library that merges by rank, where ids are the merges' order; else None."""
    import tiktoken

    spec = json.loads(tokenizer_json)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not spec["normalizer"]
    if not (plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    byte_of = {c: b for b, c in BYTE_CHARS.items()}
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or sorted(vocab.get(c, -1) for c in byte_of) != list(range(256)):
        return None
    added = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, as numbers of ``dtype``."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_str(tokenizer_json), id_type(tokenizer_json)
        self.special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fast = _by_rank(tokenizer_json)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        out, at = [], 0
        for a, b in [*_hard(text), (len(text), len(text))]:
            while at < a:
                seam = SEAM.search(text, at + SLAB, a)
                end = seam.start() if seam else a
                out.append(self.fast.encode_to_numpy(text[at:end], disallowed_special=()))
                at = end
            if at < b:
                out.append(self._library(text[at:b]))
                at = b
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, as the library gives them without added special tokens."""
        if self.fast is None:
            return self._library(text).astype(self.dtype)
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        return np.concatenate([self._plain(p) if i % 2 == 0 else np.array([self.special[p]], np.uint32) for i, p in enumerate(parts)]).astype(self.dtype)


_WORKER: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """This worker's encoder, kept from task to task."""
    key = hash(tokenizer_json)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(tokenizer_json)
    return _WORKER[key]


def tokenizer_text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")
