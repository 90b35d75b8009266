import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pytest

from termweave.llm import fim as M


def plain(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "\n", "\n\n\n", "a", "no line feed", "one\n", "é日😀\n\r\n x y\x0b\n", "<P>", "a<S>b\n", "x<M", "M>\n", "<", "S>", "<P", ">", "long " * 50_000, "l\n" * 60_000, "日本\n" * 9, "a\nਊਊ\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("a\nåé日😀<PSM>", max_size=40), min_size=1, max_size=8), st.sampled_from(["line", "char"]), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_are_those_of_the_units(texts, unit, h1, h2):
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    n, a, b, first, second = M.cuts(data, off, np.array([[h1, h2]] * len(texts)), unit)
    held = M.holds(data, off)
    for i, t in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
        x, y = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m = "".join(units[:x]), "".join(units[x:y])
        assert n[i] == len(units) and held[i] == any(s in t for s in ("<P>", "<S>", "<M>"))
        assert (a[i] - off[i], b[i] - off[i]) == (len(p.encode()), len((p + m).encode())) and (first[i], second[i]) == (len(p), len(m))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=70), st.data())
def test_rank_and_select(data, draw):
    bits = np.frombuffer(data, np.uint8)
    marks = M.Marks(M.line_ends(M.words_of(bits)))
    at = [i for i, x in enumerate(data) if x == 10]
    i = draw.draw(st.integers(0, len(data)))
    assert marks.rank(np.array([i]))[0] == sum(x < i for x in at)
    assert marks.select(np.arange(1, len(at) + 1)).tolist() == at


@pytest.mark.parametrize("unit", ["line", "char"])
def test_whole_texts(spark, unit):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "no\nid\n"), (3, "a\nb\nc"), (3, "a\nb\nc")]
    df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in docs], "doc_id long, text string, output string, n int, form int").repartition(3)
    got = M.transform(df, unit=unit)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(plain(d, t, unit)) for d, t in docs)
    back = got.select("doc_id", M.restored(got.output, got.form).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((d, t or "")) for d, t in docs)


def test_rates_and_an_empty_table(spark):
    df = spark.createDataFrame([(i, f"a{i}\nb\nc\n") for i in range(200)], "doc_id long, text string")
    got = sorted(map(tuple, M.transform(df, rate=30, spm=0, seed=1).collect()))
    assert got == sorted(plain(i, f"a{i}\nb\nc\n", seed=1, rate=30, spm=0) for i in range(200))
    assert 20 < sum(r[2] == "psm" for r in got) < 100
    assert M.transform(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.transform(df, unit="page")
