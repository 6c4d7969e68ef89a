"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a state machine.

Merges apply in the order of the list. What is still unread can only change tokens near the right end of what has been
read: for it to reach a token further left, a chain of ever later merges is needed in which each one's right side starts with
the left side of the one before. `sufficient_lookahead` is the greatest number of symbols that such a chain can span, computed
once from the merge list by dynamic programming over it. Tokens that end further left than that are stable and are
emitted; the rest of the buffer is kept, so a word of any length takes constant memory. (The remaining symbols can be merged on
their own, since no merge crosses a border between final tokens.)

This holds for a merge list in which every product is new and made of earlier products, which is checked; for another list the
lookahead is unbounded and words are held whole.

Normalisation and the split into words are the tokenizer file's own, through the library. A text is read in pieces that end at a
blank between two letters or after a mark, where every such rule has a border, so they too hold a bounded part of it; a run of letters
without either is normalised whole, and merged in constant memory. Words recur, so ids of
finished ones are remembered in a memo of bounded size; each document's ids are decoded as they come.

Defined cases: null is the empty text, whose ids and decoded text are empty; special tokens in a text give their ids; bytes that
don't form a character decode to U+FFFD as the library has it; repeated rows each give a row.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.common import releasing
from tagloom.llm.tokens import LATIN, Memo, byte_names, gathered, latin_names, load, odd_pattern, part_rule, parts_of, sliced, text_bytes, tokenizer_path, word_parts

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
UNBOUNDED = 1 << 60
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1
NO_RULE = 1 << 62
#: Characters of a piece of a text, up to the next place where it may end: before a blank between two letters of any script, or
#: after a mark that a letter follows. Every rule has a border there, and no normal form joins what stands on either side.
PIECE = 1 << 18
PIECE_END = re.compile(r"(?<=[^\W\d_])[ \n](?=[^\W\d_])|(?<=[.,;:!?\u3001\u3002\uFF0C\uFF01\uFF1A\uFF1B\uFF1F])(?=[^\W\d_])")


def pieces_of(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `most` characters whose ids, joined, are its own. What has no such place stays whole."""
    at = 0
    while len(text) - at > most and (end := PIECE_END.search(text, at + most)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


class MergeList:
    """Ranks and products of a merge list over token ids."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rules: dict[tuple[int, int], int] = {}  # rank and product in one number
        self.left: dict[int, int] = {}  # product -> its left side
        self.length: dict[int, int] = {}
        order, proper = [], True
        for rank, pair in enumerate(merges):
            u, v = pair if not isinstance(pair, str) else pair.split(" ")
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            proper &= w not in self.left and w not in (a, b)
            self.rules[a, b] = rank << TOKEN_BITS | w
            self.left[w] = a
            order.append((a, b, w))
        products, made = {w for _, _, w in order}, set()
        for a, b, w in order:  # sides that are products must have been made before
            proper &= (a not in products or a in made) and (b not in products or b in made)
            made.add(w)
            self.length[w] = self.length.setdefault(a, 1) + self.length.setdefault(b, 1)
        self.proper = proper
        self.lookahead = self._lookahead(order) if proper else UNBOUNDED

    def _lookahead(self, order: list[tuple[int, int, int]]) -> int:
        """Longest chain of merges by which the right end can reach left, in symbols; one more for the mark of a word's end."""
        reach: dict[int, int] = {}  # left side -> most symbols of a chain that ends with a merge of it
        most = 0
        for a, b, _ in order:
            before, spine = 0, b
            while spine is not None:
                before = max(before, reach.get(spine, 0))
                spine = self.left.get(spine)
            now = self.length[a] + before
            reach[a] = max(reach.get(a, 0), now)
            most = max(most, now)
        return most + 1

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply all merges: lowest rank first, equal ones from the left. Only the neighbours of a merge are looked up again."""
        rules, ids = self.rules, list(symbols)
        now = [rules.get(pair, NO_RULE) for pair in zip(ids, ids[1:])]  # noqa: B905
        while now and (best := min(now)) != NO_RULE:
            k = now.index(best)
            while k >= 0:
                ids[k : k + 2] = (best & TOKEN_MASK,)
                del now[k]
                if k:
                    now[k - 1] = rules.get((ids[k - 1], ids[k]), NO_RULE)
                if k < len(now):
                    now[k] = rules.get((ids[k], ids[k + 1]), NO_RULE)
                # in a proper list no merge makes way for an earlier one, so the other places of this rule are next
                k = now.index(best, k) if self.proper and best in now[k:] else -1
        return ids


class Transducer:
    """Symbols of one word in, tokens out as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, []
        self.window = 2 * merges.lookahead + 64

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        for symbol in symbols:
            self.held.append(symbol)
            if len(self.held) >= self.window:
                yield from self._stable()

    def _stable(self) -> list[int]:
        keep, at, out = self.merges.lookahead, 0, []
        for token in self.merges.merge(self.held):
            n = self.merges.length.get(token, 1)
            if at + n > len(self.held) - keep:
                break
            at += n
            out.append(token)
        self.held = self.held[at:]
        return out

    def close(self) -> list[int]:
        """The word ends: everything is stable."""
        out, self.held = self.merges.merge(self.held), []
        return out


class StreamingBpe:
    """text -> token ids, word by word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only plain BPE models are read")
        self.library, self.rule = load(path), part_rule(spec)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = MergeList(model["vocab"], model["merges"], self.suffix)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_text = latin_names()
        self.odd = odd_pattern(self.rule, list(self.specials))
        self.vocab = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if any(re.search(r"\s", s) for s in self.specials):
            raise ValueError("special tokens with blanks are not read")
        self.memo, self.words = Memo(self._part), Memo(self._remembered, 50_000)

    def _symbols(self, word: str) -> Iterator[int]:
        """One symbol a character; the last one carries the mark of the word's end."""
        for c in word[:-1]:
            yield self.vocab[c]
        yield self.vocab[word[-1] + self.suffix]

    def word(self, word: str) -> list[int]:
        transducer = Transducer(self.merges)
        return [*transducer.feed(self._symbols(word)), *transducer.close()]

    def _remembered(self, word: str) -> tuple[int, ...]:
        return tuple(self.word(word))

    def _plain(self, text: str) -> list[int]:
        """Ids of text without special tokens."""
        normalizer = self.library.normalizer
        text = normalizer.normalize_str(text) if normalizer and text else text
        return [i for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if word for i in self.words[word]]

    def pieces(self, text: str) -> Iterator[list[int]]:
        """Ids of the whole text, in pieces; special tokens stand for themselves."""
        at = 0
        while at < len(text):
            where, special = min(((p, -len(s), s) for s in self.specials if (p := text.find(s, at)) >= 0), default=(len(text), 0, None))[::2]
            if where > at:
                yield self._plain(text[at:where])
            if special:
                yield [self.specials[special]]
            at = where + len(special or "")

    def ids(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in piece]

    def _part(self, part: str) -> bytes:
        """Id bytes of a part of a word; a text's are joined from them."""
        # letters alone are one word, and normalised: word_parts has them in lower case
        return array("I", self.word(part.translate(self.byte_text)) if LATIN.fullmatch(part) else self._plain(part)).tobytes()

    def decoder(self) -> ByteDecoder | SpacedDecoder:
        return ByteDecoder(self) if self.byte_level else SpacedDecoder(self)

    def decode(self, ids: Iterable[int]) -> str:
        machine = self.decoder()
        return machine.feed(ids) + machine.close()

    def digests(self, pieces: Iterable[str]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their bytes and of the decoded text, of one text in pieces."""
        state = Digests(self)
        for piece in pieces:
            for ids in self.pieces(piece):
                state.feed(array("I", ids).tobytes())
        return state.close()

    def all_digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """digests of each text. Where words stand for themselves, each different part of them is encoded once a slice."""
        if self.rule != "words":
            return [self.digests(pieces_of(t or "")) for t in texts.to_pylist()]
        states: list[Digests | None] = [None] * len(texts)
        out: list[tuple[int, str, str]] = [(0, "", "")] * len(texts)

        def feed(of: int, last: bool, ids: bytes) -> None:
            state = states[of] = states[of] or Digests(self)
            state.feed(ids)
            if last:
                out[of], states[of] = state.close(), None

        for of, last, pieces in self._pieces(pc.fill_null(texts, "")):
            odd = pc.match_substring_regex(pieces, self.odd)
            cut = parts_of(pc.if_else(odd, "", pieces), self.rule)
            words = cut.flatten().dictionary_encode()
            offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            names, at = word_parts(words.dictionary, self.rule)
            size, lists = gathered(list(map(self.memo.__getitem__, names)), at)
            ids = text_bytes(offsets, words.indices, size, lists)
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                ids[k] = array("I", self.ids(pieces[k].as_py())).tobytes()
            for k, x in enumerate(ids):
                feed(of[k], last[k], x)
        return out

    @staticmethod
    def _pieces(texts: pa.Array) -> Iterator[tuple[list[int], list[bool], pa.Array]]:
        """Slices of pieces of the texts in order: each one's text, whether it is that text's last, and the pieces."""
        for lo, some in sliced(texts):
            long = pc.greater(pc.utf8_length(some), PIECE).to_numpy(zero_copy_only=False)
            at = 0
            for k in [*np.flatnonzero(long).tolist(), len(some)]:
                if k > at:
                    yield list(range(lo + at, lo + k)), [True] * (k - at), some.slice(at, k - at)
                if k < len(some):
                    text = None
                    for piece in pieces_of(some[k].as_py(), PIECE):
                        if text is not None:
                            yield [lo + k], [False], pa.array([text], some.type)
                        text = piece
                    yield [lo + k], [True], pa.array([text], some.type)
                at = k + 1


class Digests:
    """Of one text: ids in, their number and digest and that of the decoded text out. Holds neither ids nor text."""

    def __init__(self, bpe: StreamingBpe):
        self.n, self.ids, self.text, self.machine = 0, hashlib.sha256(), hashlib.sha256(), bpe.decoder()

    def feed(self, ids: bytes) -> None:
        self.n += len(ids) // 4
        self.ids.update(ids)
        self.text.update(self.machine.feed(array("I", ids)).encode())

    def close(self) -> tuple[int, str, str]:
        self.text.update(self.machine.close().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


class SpacedDecoder:
    """For files without a decoder: tokens' own names, a space between two. Its state is whether there was one before."""

    def __init__(self, bpe: StreamingBpe):
        self.names, self.begun = bpe.names, False

    def feed(self, ids: Iterable[int]) -> str:
        text = " ".join(map(self.names.__getitem__, ids))
        if not text:  # no token has an empty name
            return ""
        lead, self.begun = " " if self.begun else "", True
        return lead + text

    def close(self) -> str:
        return ""


class ByteDecoder:
    """Bytes of tokens to text. Its state is the bytes of a character that isn't complete yet."""

    def __init__(self, bpe: StreamingBpe):
        self.names, self.bytes = bpe.names, byte_names()
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _bytes(self, token: int) -> bytes:
        name = self.names[token]
        return bytes(self.bytes[c] for c in name) if all(c in self.bytes for c in name) else name.encode()

    def feed(self, ids: Iterable[int]) -> str:
        return self.utf8.decode(b"".join(map(self._bytes, ids)))

    def close(self) -> str:
        return self.utf8.decode(b"", True)


_loaded: dict[str, StreamingBpe] = {}


def transducer_of(path: str) -> StreamingBpe:
    """This worker's transducer for a file."""
    if path not in _loaded:
        _loaded[path] = StreamingBpe(path)
    return _loaded[path]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text)."""

    def run(batches):
        bpe = transducer_of(tokenizer)
        for batch in batches:
            n, ids, decoded = zip(*bpe.all_digests(batch.column(1)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
