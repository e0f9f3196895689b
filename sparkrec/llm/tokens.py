"""Token ids of whole texts, as the tokenizers library gives them for a tokenizer
file (special tokens not added), at less cost where the file allows it.

* ``ranks`` (byte-level, each merge makes the next id): the vocabulary's bytes are
  their own ranks, and the rank encoder of ``tiktoken`` gives the same ids.
* ``words`` (white space dropped): a text is cut at white space and its pieces are
  encoded apart. Pieces repeat a lot, so their ids are kept in a bounded table. Most
  are plain: Latin letters, digits and marks. Their pre-tokens are the runs of one
  kind, which go straight to the tokenizer's merge model and are kept as well.
* ``whole``: anything else is encoded by the library as it is.

A text that holds the string of an added token (``<|endoftext|>``), which the
library finds before it cuts, is encoded whole by the library, and so is a text with
a word or gap of thousands of characters, for which rank encoding is quadratic.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+\Z")  # Latin-1 letters, digits, ASCII marks but the apostrophe
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+").findall
_LONG = re.compile(r"\S{2000}|\s{2000}").search
# the pre-tokens of byte-level vocabularies
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_ids(spec: dict) -> list[int]:
    """Id that each merge of the file makes, in the file's order."""
    vocab = spec["model"]["vocab"]
    return [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]


def cut_rule(spec: dict) -> str:
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None and model.get("type", "BPE") == "BPE":
        made = merge_ids(spec)
        if not model.get("ignore_merges") and made == sorted(set(made)) and set(made) == set(range(256, 256 + len(made))):
            return "ranks"
    first = (pre.get("pretokenizers") or [{}])[0]
    if pre.get("type") == "Sequence" and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return "words"
    return "whole"


class Kept(dict):
    """What ``make`` gave for each key, in two generations: a full one becomes
    the old one, from which keys still in use move over."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """``encode(texts)`` -> little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, tokenizer_json: str, keep: int = 250_000):
        spec = json.loads(tokenizer_json)
        self.json = tokenizer_json
        self.rule = cut_rule(spec)
        self.vocab_size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) if self.rule != "whole" else self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.lowered = spec.get("normalizer") is not None  # an added token may be looked for in normalised text
        self.added = [t["content"].lower() if self.lowered else t["content"] for t in spec.get("added_tokens", [])]
        self.signs = {re.match(r"[^A-Za-z]*", t)[0] for t in self.added}  # their beginnings without case
        if self.rule == "words":
            self.keep, self.letters, self.merge = keep, byte_letters(), self.tokenizer.model.tokenize
            self.pieces = Kept(self._piece)
        if self.rule == "ranks":
            import tiktoken

            byte = {letter: b for b, letter in byte_letters().items()}
            ranks = {bytes(byte.get(c, ord(c)) for c in t): i for t, i in spec["model"]["vocab"].items() if i < 256 + len(spec["model"]["merges"])}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        """The library's tokenizer; rank encoding needs it for few texts or none."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.json)

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, text: str) -> bool:
        """Whether the library has to see the whole text."""
        if any(sign in text for sign in self.signs):
            seen = text.lower() if self.lowered else text
            if any(t in seen for t in self.added):
                return True
        return self.rule == "ranks" and len(text) >= 2000 and _LONG(text) is not None

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece between white space, its A-Z in lower case. A plain piece is
        its runs, and a run is a piece that may have been met before."""
        if not (piece.isascii() and piece.isalpha()):
            if not _PLAIN.match(piece):
                return self._ids([piece])[0]
            runs = _RUNS(piece)
            if len(runs) > 1:
                return b"".join([self.pieces[r] for r in runs])
            if not piece.isascii():
                piece = piece.lower().encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.rule == "whole":
            return self._ids(texts)
        apart = [i for i, t in enumerate(texts) if self._apart(t)]
        by_library = self._ids([texts[i] for i in apart])
        texts = list(texts)
        for i in apart:
            texts[i] = ""
        if self.rule == "ranks":
            out = [array("I", self.by_rank(t)).tobytes() for t in texts]
        else:
            self.pieces.age(self.keep)
            of = self.pieces.__getitem__
            out = [b"".join(map(of, _spaced(t).split(" "))) for t in texts]
        for i, ids in zip(apart, by_library):
            out[i] = ids
        return out


def _spaced(text: str) -> str:
    """The text with A-Z in lower case and its ASCII white space as spaces."""
    text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _irregular(text: str) -> bool:
    """Whether a space or line feed stands beside other white space or at the end."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in (" ", "\n"):
        return True
    if text.isascii():
        return any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    return _OTHER_SPACE.search(text) is not None


_ENCODERS: dict[int, TextEncoder] = {}


def encoder(tokenizer_json: str) -> TextEncoder:
    """The worker's encoder for this tokenizer file."""
    key = hash(tokenizer_json)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(tokenizer_json)
    return _ENCODERS[key]


def in_parts(texts: list[str], chars: int = 2_000_000):
    """Slices of the list of about ``chars`` characters each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end
