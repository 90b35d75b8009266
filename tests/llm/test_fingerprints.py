import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import fingerprints as P


@settings(max_examples=200, deadline=None)
@given(st.text("ab日😀", max_size=60), st.data())
def test_spans_and_extensions(text, data):
    p = P.Prefixes(text)
    i, j = (data.draw(st.integers(0, len(text))) for _ in "ij")
    n = data.draw(st.integers(0, 60))
    assert p.equal(i, j, n) == (i + n <= len(text) and j + n <= len(text) and text[i : i + n] == text[j : j + n])
    x, y = text[i:], text[j:]
    assert p.extension(i, j) == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def plain_hash(text, i, n):
    """The hash of a span by its definition."""
    out = 0
    for prime, base, shift in ((P.MODULI[0][0], P.MODULI[0][1], 0), (P.MODULI[1][0], P.MODULI[1][1], 34)):
        total = 0
        for k, c in enumerate(text[i : i + n]):
            mark = (int(P.MARKS[ord(c) & 0xFFFF]) + (ord(c) >> 16) * 0xC2B2AE3D27D4EB4F) % 2**64
            total += (mark >> shift) % 2**30 * pow(base, k, prime) % prime
        out = out << 32 | total % prime
    x = (out + n * 0x9E3779B97F4A7C15) % 2**64
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * m % 2**64
    return x ^ x >> 33


def plain_print(text):
    if not text:
        return "0" * (16 + 4 * P.WIDTH)
    n = min(P.GRAM, len(text))
    grams = sorted({plain_hash(text, i, n) for i in range(len(text) - n + 1)})
    least = [min((g for g in grams if g >> 57 == part), default=None) for part in range(P.WIDTH)]
    least = [g if g is not None else next(least[k] for k in P.LENDERS[part].tolist() if least[k] is not None) for part, g in enumerate(least)]
    return f"{plain_hash(text, 0, len(text)):016x}" + "".join(f"{(g >> 32) % 2**16:04x}" for g in least)


def same_ends(a, b):
    k = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return k, next((i for i in range(min(len(a), len(b))) if a[-1 - i] != b[-1 - i]), min(len(a), len(b)))


def check(rows, ordered, plain=False):
    """rows of the result against the texts in order; plain: fingerprints by their definition."""
    want = []
    prints = (lambda texts: [plain_print(t) for t in texts]) if plain else P.fingerprints
    for k, (d, t) in enumerate(ordered):
        t, f = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + f[:q]
        a, b, c = prints([t, e, f])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c), *same_ends(t, e), *same_ends(t, f)))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_plain_fingerprints(spark):
    docs = [(5, "é" * 40 + "abc" * 20), (2, "one two three four five six seven eight nine ten"), (9, None), (3, "one two three four five six seven eight nine ten"), (1, ""), (7, "x"), (8, "日本😀" * 30 + "end"), (10, "one two three four and the end")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    check(P.edited(df).collect(), sorted(docs), plain=True)
    rng = random.Random(2)
    for share in (0.0, 0.3, 0.7, 0.95):
        a = "".join(rng.choices("abcdefgh ", k=6000))
        b = a[: int(share * 6000)] + "".join(rng.choices("abcdefgh ", k=6000 - int(share * 6000)))
        s, t = ({x[i : i + P.GRAM] for i in range(len(x) - P.GRAM + 1)} for x in (a, b))
        j = len(s & t) / len(s | t)
        assert abs(P.likeness(*P.fingerprints([a, b])) - 2 * j / (1 + j)) < 0.2


def test_hard_texts_have_their_own_hash():
    """Thue-Morse words collide for every base modulo a power of two."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    p = P.Prefixes(word + word.translate(str.maketrans("ab", "ba")))
    assert not p.equal(0, 4096, 4096) and p.equal(0, 0, 4096)


def test_rows(spark):
    docs = [(5, "é" * 40 + "abc" * 20), (2, "one two three four five six seven eight"), (9, None), (2, "same id"), (1, ""), (None, "last of all, without an id"), (7, "x"), (3, "long " * 90_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_chars int").coalesce(1)
    ordered = sorted(((d, i, t) for i, (d, t) in enumerate(docs)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    check(P.edited(df).collect(), [(d, t) for d, _, t in ordered])
    check(P.edited(df.limit(1)).collect(), docs[:1])
    assert P.edited(df.limit(0)).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    rows = P.op8_document_fingerprints(spark, sf).collect()
    check(rows, docs)
    long = [r for r in rows if r.n_chars > 1000]
    assert sum(r.near_edited for r in long) / len(long) > 0.7 and sum(r.near_next for r in long) / len(long) < 0.1
