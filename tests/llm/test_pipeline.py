import random

import pytest

import corpus_pipeline
from cellspan.llm import bpe
from test_simhash import components, fingerprint


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(900)]
    texts = ["\n".join(" ".join(r.choices(vocab, k=12)) for _ in range(r.randint(6, 20))) for _ in range(80)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:20]] + texts[:10] + ["too short", None, "", "a b c " * 90, "#$ " * 70]
    texts = [f"the boiler plate line of this source here\n{t}" if i % 2 and t else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", ["s0", "s1", None][i % 5 % 3], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got[name] = {r["doc_id"]: r for r in docs.collect()}
    assert {i for i, t, *_ in rows if t and len(t.split()) >= 50 and "#" not in t and "a b c" not in t} == set(got["quality_rules"])
    assert set(got["line_dedup"]) == set(got["quality_rules"])
    assert all("boiler plate" not in r["text"] and r["n_chars"] == len(r["text"]) for r in got["line_dedup"].values())
    want = components([(i, fingerprint(r["text"])) for i, r in got["line_dedup"].items()])
    assert set(got["near_dedup"]) == {i for i, _, c in want if i == c}
    assert set(got["mix_sources"]) <= set(got["near_dedup"])


def test_run(spark, folder):
    path, _ = folder
    P = pytest.importorskip("public_tokenizers")
    tok = bpe.tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    a = corpus_pipeline.run(spark, path).collect()
    assert a and all(r["n_tokens"] * 4 == len(r["ids"]) for r in a)
    assert sorted(map(str, a)) == sorted(map(str, corpus_pipeline.run(spark, path).collect()))
    import array

    for r in a[:20]:
        ids = array.array("I", bytes(r["ids"]))
        assert tok.encode(tok.decode_bytes(ids).decode()) == list(ids)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_an_id_are_mixed_on_their_own(spark, tmp_path):
    """Rows that share no id are not taken as often as the one of them that is taken most."""
    rows = [(None, f"text {i} " + "w " * (20 + i % 7), "en", "s", 1) for i in range(300)] + [(i, "x " * 30, "en", "t", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["source"] for r in corpus_pipeline.mix_sources(spark, df, str(tmp_path)).select("source").collect()]
    size = sum(len(r[1].split()) for r in rows if r[3] == "s"), sum(len(r[1].split()) for r in rows if r[3] == "t")
    share = [min(2 * size[0], 1.5 * sum(size) * 3 / 4), min(2 * size[1], 1.5 * sum(size) / 4)]
    share = [share[0], min(2 * size[1], 1.5 * sum(size) - share[0])]
    for s, n, w in zip("st", (300, 300), range(2)):
        assert abs(got.count(s) - n * share[w] / size[w]) <= 5


def test_near_dedup_is_operator_10(spark, tmp_path):
    """What links is the fingerprints of operator 10: near copies beyond three bits stay, whatever their shingles share."""
    r = random.Random(3)
    base = [" ".join(r.choices("abcdefghijklmnop", k=60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(" ", " x ", 1)) for i, t in enumerate(base)]
    rows = [(i, t, "en", "s", len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, _, c in components([(i, fingerprint(t)) for i, t, *_ in rows]) if i == c}
    assert 60 < len(want) < 120
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()} == want
