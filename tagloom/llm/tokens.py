"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

A text is cut where the tokenizer's own rules always cut, so the ids of the parts, joined, are the ids of the text;
each part is looked up in the memo, and only a part that isn't there goes through the library. Texts for which
the cut isn't certain (special tokens, unusual blanks) go through the library as a whole. Ids are little-endian unsigned
32-bit integers throughout.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts in each of the memo's two generations; about 30 MB each.
MEMO_PARTS = 150_000
#: Longer parts are not remembered.
LONGEST_PART = 64
#: Marks and letters between which either tokenizer has a border.
MARKS = ".,;:!?%#$&*"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LATIN = re.compile(f" ?[{LETTERS}]+")
SPLIT = rf"^(?P<lead>\n?)(?P<letters> ?[{LETTERS}]+)(?P<marks>[{MARKS}]*)$"
#: Blanks besides space and line break, as regular expression classes.
RARE_BLANKS = r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
OTHER_BLANKS = r"\t\r\x{0b}\x{0c}"
#: Text bytes that are cut into parts at once.
SLICE_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer, with truncation and padding off and one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Memo(dict):
    """Part -> value, of bounded size: when a generation is full it becomes the old one, and the older one goes."""

    def __init__(self, make, most: int = MEMO_PARTS):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, part: str):
        found = self.old.get(part)
        if found is None:
            found = self.make(part)
        if len(part) <= LONGEST_PART:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


def part_rule(spec: dict) -> str:
    """How texts of this tokenizer may be cut: "words" (blanks are dropped), "spaced" (a blank leads its word) or "" (not known)."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "spaced"
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") and "\\s" in first["pattern"].get("Regex", ""):
        return "words"
    return ""


def byte_names() -> dict[str, int]:
    """The character by which byte-level files name each byte: itself if it prints, else one from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def latin_names() -> dict[int, str]:
    """For str.translate: the bytes of a space and of Latin letters beyond ASCII, by their names."""
    names = {b: c for c, b in byte_names().items()}
    return {k: "".join(names[b] for b in chr(k).encode()) for k in [32, *range(0xC0, 0x100)]}


def odd_pattern(rule: str, specials: list[str]) -> str:
    """Matches the texts that have to be taken whole: where the cut isn't certain."""
    found = [re.escape(s) for s in specials] + [f"[{RARE_BLANKS}]"]
    if rule == "spaced":
        found += [f"[{OTHER_BLANKS}]", r"[ \n][ \n]", r"[ \n]\z"]
    return "|".join(found)


def parts_of(texts: pa.Array, rule: str) -> pa.ListArray:
    """The parts of each text: words (some may be empty), or words with the blank before them."""
    if rule == "words":
        for c in "\n\t\r\x0b\x0c":
            texts = pc.replace_substring(texts, c, " ")
        return pc.split_pattern(texts, " ")
    for c in " \n":
        texts = pc.replace_substring(texts, c, f"\x1f{c}")
    return pc.split_pattern(texts, "\x1f")


def sliced(texts: pa.Array, most: int = SLICE_BYTES):
    """(first, texts) of consecutive slices of about so many bytes; nulls become empty texts."""
    texts = pc.fill_null(texts, "")
    place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo < hi:
            yield lo, texts.slice(lo, hi - lo)


def word_parts(words: pa.Array, rule: str) -> tuple[list[str], np.ndarray]:
    """Different parts of words, and the three of each word (3 x words). A word of letters and marks is taken apart, so that its
    other forms find its letters; one of ASCII letters alone is them."""
    plain = pc.ascii_is_alpha(words)
    split = pc.extract_regex(pc.if_else(plain, pa.scalar(None, words.type), words), SPLIT)
    lead, letters, marks = (split.field(k) for k in range(3))
    letters = pc.if_else(plain, words, letters)
    if rule == "words":
        letters = pc.utf8_lower(letters)
    split_up = split.is_valid()
    parts = pa.concat_arrays([pc.if_else(split_up, lead, ""), pc.if_else(pc.or_(plain, split_up), letters, words), pc.if_else(split_up, marks, "")]).dictionary_encode()
    return parts.dictionary.to_pylist(), parts.indices.to_numpy().reshape(3, -1)


def gathered(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Number of ids and the ids themselves, for columns of places in a list of id bytes."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
    sizes = size[at].sum(0)
    flat = lists.take(pa.array(at.T.ravel())).flatten()
    return sizes, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)


def text_bytes(offsets: np.ndarray, indices: pa.Array, size: np.ndarray, lists: pa.ListArray) -> list[bytes]:
    """Id bytes of each text, from its words' places among the different words."""
    data = memoryview(lists.take(indices).flatten().to_numpy()).cast("B")
    chosen = indices.to_numpy()
    ends = np.concatenate(([0], np.cumsum(size[chosen] if len(chosen) else size[:0])))
    cut = (4 * ends[offsets - offsets[0]]).tolist()
    return [bytes(data[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Encoder:
    """Texts -> id bytes. One per Python worker and file; see encoder()."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rule = part_rule(spec)
        self.odd = odd_pattern(self.rule, [t["content"] for t in spec.get("added_tokens", [])])
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.names = latin_names()
        self.memo = Memo(self._part)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not (part.isascii() and part.isalpha()):
            if not LATIN.fullmatch(part):
                return self._whole(part)
            part = part.translate(self.names)
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """Number of ids, and the ids, of each of the different words."""
        parts, at = word_parts(words, self.rule)
        return gathered(list(map(self.memo.__getitem__, parts)), at)

    def __call__(self, text: str | None) -> bytes:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[bytes]:
        """Id bytes of each text. Of the parts, each different one is looked up once."""
        out: list[bytes] = []
        for _, some in sliced(texts):
            odd = pc.match_substring_regex(some, self.odd) if self.rule else pa.array([True] * len(some))
            parts = parts_of(pc.if_else(odd, "", some), self.rule)
            words = parts.flatten().dictionary_encode()
            size, lists = self._ids(words.dictionary)
            found = text_bytes(parts.offsets.to_numpy(), words.indices, size, lists)
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                found[k] = self._whole(some[k].as_py())
            out += found
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; workers are reused, so the memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
