import hashlib
import random
import tracemalloc
from array import array

import pyarrow as pa
import pytest

from tagloom.llm import bpe, tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = tokens.tokenizer_path(request.param)
    return bpe.StreamingBpe(path), tokens.load(path)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_equals_the_library(both, tiny):
    own, library = both
    pick = random.Random(3)
    texts = ["", "a  b", "It's don't  x\n\ny <|endoftext|> z<|endoftext|>", "\tfoo\r\nbar", "İ ΣΑΣ", "é x́.", "foo... bar!? 'tis", "e" * 3000, "!?" * 1500]
    texts += ["".join(pick.choice(letters) for _ in range(n)) for letters, n in (("abcdeinrst", 8000), ("an", 4000), ("他们🙂é", 2000))]
    texts += [r.text for r in tiny.limit(30).collect()]
    for text in texts:
        found = library.encode(text, add_special_tokens=False)
        decoded = library.decode(found.ids, skip_special_tokens=False)
        assert own.ids(text) == found.ids
        assert own.decode(found.ids) == decoded
        assert own.all_digests(pa.array([text, None])) == [own.digests([text]), own.digests([])]
        assert own.digests([text]) == (len(found.ids), sha(array("I", found.ids).tobytes()), sha(decoded.encode()))


def test_decoder_holds_back_incomplete_characters(both):
    own, library = both
    if not own.byte_level:
        return
    ids = list(range(0, 50000, 37))
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_is_constant(both):
    own, _ = both
    transducer = bpe.Transducer(own.merges)
    most, out = 0, []
    symbols = [*own._symbols("entreerst" * 4000)]
    for s in symbols:
        out += transducer.feed([s])
        most = max(most, len(transducer.held))
    assert most <= transducer.window
    assert out + transducer.close() == own.merges.merge(symbols)


def test_long_texts_in_pieces(both, monkeypatch):
    """A text of many pieces has the digests of the whole, whatever stands beside it in the batch."""
    own, library = both
    monkeypatch.setattr(bpe, "PIECE", 700)
    pick = random.Random(2)
    words = ["Foo", "bar's", "e.g.", "naïve", "x" * 40, "他们", "<|endoftext|>", "ß", "12", "end.\n\nNew", "a\tb"]
    texts = ["short one", " ".join(pick.choice(words) for _ in range(3000)), None, "e" * 5000, " ".join(pick.choice(words[:2]) for _ in range(900))]
    assert len(list(bpe.pieces_of(texts[1], 700))) > 3 and "".join(bpe.pieces_of(texts[1], 700)) == texts[1]
    for text, got in zip(texts, own.all_digests(pa.array(texts)), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want = len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())
        assert got == want == own.digests(bpe.pieces_of(text or "", 700))


def test_memory_does_not_grow_with_the_text(both):
    own, _ = both
    pick = random.Random(9)
    words = [" " + "".join(pick.choice("abcdeinrst") for _ in range(pick.randrange(2, 9))) for _ in range(500)]

    def peak(pieces):
        tracemalloc.start()
        n = own.digests("".join(pick.choice(words) for _ in range(3000)) for _ in range(pieces))[0]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, most

    peak(2)  # words are remembered
    (few, low), (many, high) = peak(3), peak(24)
    assert many > 6 * few and high < 1.3 * low


def test_decoding_in_steps(both):
    own, library = both
    ids = library.encode("Naïve 他们 <|endoftext|> 🙂 it's done.", add_special_tokens=False).ids
    machine = own.decoder()
    assert "".join([*(machine.feed([i]) for i in ids), machine.close()]) == library.decode(ids, skip_special_tokens=False)


def small(merges):
    vocab = {c: k for k, c in enumerate("abcd")}
    for u, v in merges:
        vocab.setdefault(u + v, len(vocab))
    return bpe.MergeList(vocab, merges)


def test_lookahead_of_random_lists():
    """Every list, however its chains run: tokens further left than the lookahead don't change with what follows."""
    pick = random.Random(11)
    for _ in range(150):
        names, merges = list("abcd"), []
        while len(merges) < 12:
            u, v = pick.choice(names), pick.choice(names)
            if u + v not in names and len(u + v) < 9:
                names.append(u + v)
                merges.append((u, v))
        rules = small(merges)
        assert rules.lookahead < bpe.UNBOUNDED
        for _ in range(20):
            symbols = [pick.randrange(4) for _ in range(120)]
            transducer = bpe.Transducer(rules)
            transducer.window = rules.lookahead + 1
            assert [*transducer.feed(symbols), *transducer.close()] == rules.merge(symbols)


def test_improper_list_is_held_whole():
    assert small([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]).lookahead == bpe.UNBOUNDED


def test_rows(spark, awkward, nothing):
    path = tokens.tokenizer_path(FILES[0])
    library = tokens.load(path)
    rows = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(awkward, path).collect())
    want = []
    for r in awkward.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or 0, len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert rows == sorted(want)
    assert bpe.encoded(nothing, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_any_script(name):
    """Cyrillic and Chinese texts end pieces too, at blanks and after marks, and their ids are those of the whole."""
    library = tokens.load(tokens.tokenizer_path(name))
    for text in ("Съешь же ещё этих мягких французских булок, да выпей чаю. " * 40, "天地玄黄。宇宙洪荒，日月盈昃。" * 60, "λόγος καὶ ἔργον καὶ λόγος " * 50):
        pieces = list(bpe.pieces_of(text, 100))
        assert len(pieces) > 5 and "".join(pieces) == text and max(map(len, pieces)) < 200
        ids = [i for p in pieces for i in library.encode(p, add_special_tokens=False).ids]
        assert ids == library.encode(text, add_special_tokens=False).ids
