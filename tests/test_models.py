"""Models and clients that run in tasks: vectors of texts, and resolution behind a guard."""

import hashlib
import re

import numpy as np
import pytest

from termweave.operators import clients, embed, retrieve


def plain(text, most=None):
    tokens = re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))[:most]
    total = np.zeros(16)
    for t in tokens:
        for i in range(len(t)):
            h = hashlib.md5(f"#{t}#"[i : i + 3].encode()).hexdigest()
            total[int(h[:4], 16) % 16] += -1 if int(h[4], 16) % 2 else 1
    return len(tokens), total / max(len(tokens), 1)


TEXTS = ["Blood of a patient", "blood OF a patient", None, "", "!!", "İstanbul é x9", "a", "word " * 3000, *(f"text {i} " * (i % 7) for i in range(90))]


def test_vectors_are_those_of_the_definition(spark):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "id int, text string, tokens string").repartition(3)
    for most in (None, 512):
        rows = embed.embed(df, "text", most_tokens=most).collect()
        assert len(rows) == len(TEXTS) and all(r.tokens == "kept" for r in rows)
        for r in rows:
            n, v = plain(r.text, most)
            assert r.n_tokens == n and np.allclose(r.embedding, v, atol=1e-12)
    assert embed.embed(df.limit(0), "text").collect() == []


def test_a_model_is_loaded_once_and_sees_small_batches(spark):
    def load():
        loads, sizes = [], []
        loads.append(1)

        def vectors(batch):
            sizes.append(len(batch))
            assert len(batch) <= 5
            mask = np.array([[k < len(t) for k in range(max(map(len, batch)))] for t in batch])
            return np.full((*mask.shape, 2), [len(loads), len(sizes)], float) * np.arange(1, mask.shape[1] + 1)[None, :, None], mask

        return str.split, vectors

    df = spark.createDataFrame([(i, "a b c") for i in range(23)], "id int, text string").coalesce(1)
    rows = embed.embed(df, "text", embed.Model("counting", 2, load, "first"), batch=5).collect()
    assert {r.embedding[0] for r in rows} == {1.0} and sorted({r.embedding[1] for r in rows}) == [1.0, 2.0, 3.0, 4.0, 5.0]
    with pytest.raises(ValueError, match="pooling"):
        embed.embed(df, "text", embed.Model("x", 2, load, "last"))
    with pytest.raises(ValueError, match="embedding"):
        embed.embed(df.withColumnRenamed("id", "Embedding"), "text")


def test_pooling_leaves_padding_out():
    v, mask = np.arange(12.0).reshape(2, 3, 2), np.array([[True, True, False], [False, False, False]])
    assert embed.pooled(v, mask, "mean").tolist() == [[1.0, 2.0], [0.0, 0.0]]
    assert embed.pooled(v, mask, "first").tolist() == [[0.0, 1.0], [0.0, 0.0]]
    assert embed.pooled(np.zeros((2, 0, 2)), np.zeros((2, 0), bool), "first").tolist() == [[0.0, 0.0]] * 2


def test_requests_get_their_vectors(spark):
    plans = spark.createDataFrame([("r1", [("MONDO", ["skin", "skin swab"])]), ("r2", [("MONDO", ["skin"]), ("ENVO", ["sea"])])], "record_id string, mappings array<struct<ontology:string,query_texts:array<string>>>")
    asked = retrieve.requests(plans)
    rows = embed.answered(asked).collect()
    assert len(rows) == 4 and all(np.allclose(r.embedding, plain(r.query_text)[1]) for r in rows)
    made = retrieve.embedded(asked, embed.answered(asked), 16)
    assert made.count() == 4


FOUND = [("r1", "MONDO", "M:1", "flu", 0.9, 0), ("r1", "MONDO", "M:2", "cold", 0.7, 1), ("r1", "ENVO", "E:1", "sea", 0.95, 0), ("r2", "MONDO", "M:3", None, 0.85, 0), ("r3", "MONDO", "M:4", "x", 0.5, 0), ("r4", "ENVO", "M:1", "flu", 0.99, 0), ("r5", "ENVO", "E:2", "lake", 0.9, 0)]


def test_a_client_is_guarded(spark):
    def teller():
        def tell(found):
            names = [c["curie"] for c in found]
            if not found:
                return []
            if names == ["M:3"]:
                raise RuntimeError("no such model")
            if names == ["M:4"]:
                return [{"curie": "Z:9", "confidence": "high"}]
            if names == ["M:1"]:
                return [{"role": "primary"}]  # what cannot be read is an error
            if names == ["E:2"]:
                return None
            assert found == [{"curie": "E:1", "label": "sea", "ontology": "ENVO", "score": 0.95}, {"curie": "M:1", "label": "flu", "ontology": "MONDO", "score": 0.9}, {"curie": "M:2", "label": "cold", "ontology": "MONDO", "score": 0.7}]
            return [{"curie": "M:2", "role": "secondary", "confidence": "0.2", "score": 1.0}, {"curie": "E:1", "confidence": "HIGH"}, {"curie": "M:2"}, {"curie": "made:up"}]

        return tell

    candidates = spark.createDataFrame(FOUND, "record string, bucket string, term_id string, label string, score double, rank int").repartition(3)
    records = spark.createDataFrame([(r,) for r in ("r1", "r2", "r3", "r4", "r5", "r6", "r6")], "record string")
    got = {r.record: r for r in clients.resolved_by(candidates, records, teller).collect()}
    assert len(got) == 6
    assert [tuple(t) for t in got["r1"].terms] == [("MONDO", "M:2", "cold", 0.7, "secondary", "low"), ("ENVO", "E:1", "sea", 0.95, "primary", "high")]
    assert (got["r1"].flags, got["r1"].outcome, got["r1"].abstain_reason) == (["invented_curie_removed"], "proposed_with_flags", None)
    assert [tuple(t) for t in got["r2"].terms] == [("MONDO", "M:3", None, 0.85, "primary", "high")] and got["r2"].flags == ["resolve_agent_error: no such model"]
    assert (got["r3"].terms, got["r3"].flags, got["r3"].outcome, got["r3"].abstain_reason) == ([], ["invented_curie_removed"], "insufficient_evidence", "No terms selected")
    assert got["r4"].flags == ["resolve_agent_error: 'curie'"] and got["r4"].terms[0].term_id == "M:1" and got["r5"].flags[0].startswith("resolve_agent_error")
    assert (got["r6"].terms, got["r6"].candidate_curies, got["r6"].outcome, got["r6"].abstain_reason) == ([], [], "insufficient_evidence", "No terms selected")
    assert clients.resolved_by(candidates.limit(0), records.limit(0), teller).collect() == []
