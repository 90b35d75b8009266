import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    return [len(x) for x in T.processor(PATH).encode([t or "" for t in texts], num_threads=1)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t.,'é日▁\x01\x02\x03\x00😀<s>/1") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_pieces_of_pretokens_add_up(text):
    import pyarrow as pa

    tokens = T.marked(pa.array([text], pa.large_string()))[0].as_py().split(" ")
    assert sum(T.pieces(T.processor(PATH), tokens)) == brute([text])[0] or not text


def test_rows(spark):
    texts = ["the cat\nsat", None, "", " ", "a  b   c\n\n d", "the cat\nsat", "x" * 9000, "<s>a</s>", "word " * 5000, "a, " * 70000]
    ids = [1, 2, 3, 4, 5, 1, None, 8, 9, 10]
    df = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_tokens int").repartition(3)
    df.write.parquet(path := __import__("tempfile").mkdtemp(prefix="spark-") + "/d")
    got = T.token_counts(spark.read.parquet(path), PATH).collect()
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t, n in zip(ids, texts, brute(texts), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in T.op1_token_counts(spark, f"/root/testdata/{sf}").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
