import hashlib
import random
import struct

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from cellspan.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return bpe.Tokenizer(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    tok, enc = both
    r = random.Random(1)
    for _ in range(2000):
        s = "".join(r.choice("ab  \n\t\x85 　\x1c'sré.,01ß漢🙂theingandof") for _ in range(r.randint(0, 90)))
        assert tok.encode(s) == enc.encode_ordinary(s)
        assert "".join(tok.decode_parts([i] for i in tok.encode(s))) == s


def test_every_token_and_long_pieces(both):
    tok, enc = both
    r = random.Random(2)
    for t in r.sample(sorted(tok.transducer.ranks), 3000):
        s = t.decode("utf-8", "ignore")
        assert tok.encode(s + s) == enc.encode_ordinary(s + s)
    for s in ("a" * 9001, "the" * 5000, " " * 5000 + "x", "é" * 5000, "<|endoftext|>"):
        assert tok.encode(s) == enc.encode_ordinary(s)


def test_small_tables_are_refilled(both):
    _, enc = both
    tok = bpe.Tokenizer(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, remembered=20, moves=20)
    s = "Onhalyti the in erthst orth it " * 9 + "antidisestablishmentarianism" * 30
    assert tok.encode(s) == enc.encode_ordinary(s)


def test_utf8_stream_by_bytes():
    s = "aé漢🙂ࠀz"
    for step in (1, 2, 3):
        d, raw = bpe.Utf8Stream(), s.encode()
        got = [d.feed(raw[i : i + step]) for i in range(0, len(raw), step)] + [d.feed(b"", final=True)]
        assert "".join(got) == s
    d = bpe.Utf8Stream()
    assert d.feed(b"a\xe6\xbc") == "a" and d.feed(b"", final=True) == "�"


def test_documents(spark, both):
    _, enc = both
    texts = ["", None, "a", "Hello  world\n\n it's 1 2", "word " * 300_000, "x" * 50_000, "Hello"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    path = P.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, path, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(got[i]["ids"]) == raw and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), path, P.PATTERN).count() == 0


def test_tables_stay_small(both):
    """Hundreds of thousands of different pieces: what a worker keeps stays under 150 MB."""
    import subprocess
    import sys

    code = """
import random, public_tokenizers as P
from cellspan.llm import bpe
def resident():
    return int(next(x for x in open('/proc/self/status') if x.startswith('VmRSS')).split()[1]) / 1024
before = resident()
tok = bpe.Tokenizer(bpe.read_ranks(P.path('byte_bpe_50k.tiktoken')), P.PATTERN)
r = random.Random(5)
for _ in range(400):
    tok.encode(' '.join(''.join(r.choices('etaoinshrdlucmfwypvé漢', k=r.randint(1, 14))) for _ in range(1000)))
assert len(tok.memo) <= tok.remembered and len(tok.old_memo) <= tok.remembered
assert len(tok.transducer.moves) <= bpe.MOVES and len(tok.transducer.pairs) <= bpe.PAIRS
print(resident() - before)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(got.stdout) < 150


def words(r, n, letters="etaoinshrdlucmfwypvéö漢🙂"):
    return ["".join(r.choices(letters, k=r.randint(1, 14))) for _ in range(n)]


def test_side_by_side(both, monkeypatch):
    """Pieces that go side by side give what the library gives, with tables of any size."""
    tok, enc = both
    r = random.Random(3)
    pieces = [w.encode() for w in words(r, 3000)] + r.sample(sorted(tok.transducer.ranks), 3000)
    pieces += [b"", b"\0", b"\0\0a", b"a" * 300]
    want = [bpe.packed(tok.transducer.encode(p)) for p in pieces]
    for states, often, bits in ((50_000, 4, 17), (50_000, 1, 17), (9, 1, 4), (400, 1, 9), (2000, 2, 5)):
        for name, value in (("STATES", states), ("OFTEN", often), ("MOVE_BITS", bits), ("PAIR_BITS", bits + 1)):
            monkeypatch.setattr(bpe.SideBySide.__module__ + "." + name, value)
        many = bpe.SideBySide(tok.transducer)
        for _ in range(3):
            assert many.encode(pieces) == want
            assert len(many.states) <= states
        assert many.encode([]) == []
    texts = ["", *(" ".join(words(r, r.randint(0, 400))) for _ in range(60)), "漢 " * 700_000, "a1" * 400_000, "b"]
    monkeypatch.undo()
    for got, text in zip(bpe.Tokenizer(tok.transducer.ranks, P.PATTERN).encode_texts(texts), texts, strict=True):
        assert list(bpe.unpacked(b"".join(got))) == enc.encode_ordinary(text)


def test_side_by_side_small_vocabularies():
    r = random.Random(4)
    for _ in range(60):
        tokens = [bytes([b]) for b in b"abc"]
        while len(tokens) < 25:
            t = r.choice(tokens) + r.choice(tokens)
            if t not in tokens:
                tokens.append(t)
        if r.random() < 0.5:
            tokens.append(b"cabbacca" + r.choice(tokens))  # often no merge makes it
        one = bpe.Transducer({t: i for i, t in enumerate(dict.fromkeys(tokens))})
        pieces = ["".join(r.choices("abc", k=r.randint(1, 30))).encode() for _ in range(200)] + tokens
        want = [bpe.packed(one.encode(p)) for p in pieces]
        assert all(one.encode_many(pieces) == want for _ in range(3))
        with pytest.raises(ValueError):
            one.encode_many([*pieces, b"abdc"])


def test_new_pieces_of_a_text_go_together(both):
    """Text of words that no worker remembers costs clearly less than its pieces one by one."""
    import time

    ranks = both[0].transducer.ranks
    text = " ".join(words(random.Random(6), 60_000))

    def seconds(run, tok):
        begin = time.process_time()
        run(tok)
        return time.process_time() - begin

    def singly(tok):
        for p in tok.split.findall(text):
            tok.transducer.encode(p.encode())

    one_by_one = min(seconds(singly, bpe.Tokenizer(ranks, P.PATTERN)) for _ in range(2))
    together = min(seconds(lambda tok: tok.encode(text), bpe.Tokenizer(ranks, P.PATTERN)) for _ in range(2))
    assert together < 0.8 * one_by_one, (together, one_by_one)
