"""Long words, repeated ids, whole training texts, several window lengths, and scores against naive networks."""
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.llm import chat, decontaminate, embeddings, lm, quality, suffixes, toxicity

from tests.llm.test_llm_operators import brute_hits, prose


def test_words_longer_than_a_chunk_stay_one_word(monkeypatch):
    texts = [b"ab " + b"x" * 5000 + b" cd", b"y" * 4000, "é".encode() * 3000 + b"!z", b"a b " * 600, b"x" * 999 + b" " + b"x" * 5000]
    want = [lm.word_hashes(t, suffixes.Hasher(lm.CHUNK)).tolist() for t in texts]
    mine = [toxicity.encode(t.decode()).tolist() for t in texts]
    monkeypatch.setattr(lm, "CHUNK", 64)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert [lm.word_hashes(t, suffixes.Hasher(64)).tolist() for t in texts] == want
    assert [toxicity.encode(t.decode()).tolist() for t in texts] == mine
    assert [len(w) for w in want] == [3, 1, 2, 1200, 2] and want[0][1] == want[4][1]


def test_one_id_on_several_vectors(spark):
    r = np.random.default_rng(8)
    a, b = r.normal(size=(2, 16))
    rows = [(5, a.tolist(), 0), (5, b.tolist(), 0), (6, (a + 1e-4).tolist(), 0), (7, (b + 1e-4).tolist(), 0), (5, a.tolist(), 0), (9, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = Counter((x["id"], x["n_links"], x["component_id"]) for x in embeddings.near_duplicates(df).collect())
    assert got == Counter({(5, 2, 5): 2, (5, 1, 5): 1, (6, 2, 5): 1, (7, 1, 5): 1, (9, 0, 9): 1})


def test_passes_hold_every_window_length_once():
    for lengths in ([13], [3, 13], list(range(1, 14)), [2, 5, 12, 13]):
        got = decontaminate._passes(lengths)
        assert [m for p in got for m in p] == lengths and len(got) <= 3
        assert all(len(p) == 1 or sum(p) <= decontaminate.PASS_WORDS for p in got)


@pytest.mark.parametrize("limit", [0, decontaminate.MAX_BROADCAST])
def test_many_window_lengths_match_brute_force(spark, limit):
    local = [(i, prose(n, 500 + i)) for i, n in enumerate([0, 1, 2, 5, 40, 400])] + [(90, None), (91, " . "), (4, prose(40, 504))]
    whole = prose(400, 505).split()
    items = [(k, " ".join(whole[3 * k:4 * k])) for k in range(1, 14)] + [(20, " ".join(whole[100:140])), (21, "nowhere " * 5), (22, "")]
    docs = spark.createDataFrame(local, "doc_id bigint, text string").withColumn("m", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter((x["id"], x["n_words"], x["n_hit"], ",".join(sorted(x["items"]))) for x in
                  decontaminate.report(docs, bench, max_broadcast=limit).collect())
    assert got == brute_hits(local, items) and max(k[2] for k in got) > 50


def test_a_long_text_and_short_items_stay_in_generated_code(spark):
    text = " ".join(f"w{i % 5000}" for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2 w3")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "w1 w2 w3"), (2, " ".join(f"w{i}" for i in range(10, 50)))], "item_id bigint, text string")
    got = {r["id"]: (r["n_words"], r["n_hit"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (100_000, 20 * 43), 2: (3, 3)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = decontaminate.hits(docs, bench)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # generated code is marked *(n): both explodes and the probe are in one stage, and only hits leave it
    marks = [re.search(r"\*\((\d+)\)", line) for line in plan.splitlines() if "Generate explode" in line and "_copy" not in line
             or "BroadcastHashJoin" in line]
    stages = [m.group(1) for m in marks if m]
    assert Counter(stages).most_common(1)[0][1] >= 3


def naive_quality(text, net):
    """The byte network as loops over a text's chunks, windows and filters."""
    p, a = net.p, (text or "").encode()
    starts = range(0, max(len(a) - quality.OVERLAP, 1), quality.STEP)
    feats = []
    for s in starts:
        chunk = a[s:s + quality.CHUNK]
        wins = [chunk[i:i + quality.WIDTH] for i in range(len(chunk) - quality.WIDTH + 1)]
        z = [max([sum(float(p["K"][k, w[k], f]) for k in range(quality.WIDTH)) for w in wins], default=-9.0) for f in range(quality.FILTERS)]
        z = [max(v + float(c), 0.0) for v, c in zip(z, p["c"])] + [len(wins) / quality.STEP]
        feats.append(np.tanh(np.array(z) @ p["W"] + p["d"]))
    h = np.array(feats)
    return 1 / (1 + np.exp(-(np.concatenate((h.max(0), h.mean(0))) @ p["out"] + p["bias"][0])))


def test_quality_scores_equal_a_naive_network():
    net = quality.ByteCNN(seed=9)
    texts = ["", None, "a", "abcd", prose(50, 1), "é" * 130, prose(300, 2), "x" * (quality.CHUNK + quality.STEP), "y" * quality.CHUNK]
    assert quality.score_texts(texts, net.tables()) == pytest.approx([naive_quality(t, net) for t in texts], abs=1e-4)


def naive_toxicity(text, net):
    """The word network as loops over a text's windows and filters."""
    p, words = net.p, re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    e = [p["E"][i] + p["E"][j] for i, j in (toxicity.encode(w.decode("utf-8", "replace"))[0] for w in words)]
    z = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            sums = [sum(float(e[s + i] @ p[f"K{w}"][i][:, f]) for i in range(w)) for s in range(len(e) - w + 1)]
            z.append(max([v + float(p[f"c{w}"][f]) for v in sums] + [0.0]))
    return 1 / (1 + np.exp(-(np.array(z) @ p["out"] + p["bias"][0])))


def test_toxicity_scores_equal_a_naive_network(monkeypatch):
    net = toxicity.TextCNN(seed=9)
    net.p["E"] = np.random.default_rng(1).normal(0, 0.5, net.p["E"].shape).astype(np.float32)
    texts = ["", None, "a", "a b", "One two, three!", prose(200, 3), "é ü " * 30, "42 x1 " * 9]
    want = [naive_toxicity(t, net) for t in texts]
    assert toxicity.score_texts(texts, net.tables()) == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    assert toxicity.score_texts(texts, net.tables()) == pytest.approx(want, abs=1e-4)


def test_queries_score_as_the_naive_networks(spark):
    """The registered queries' scores on whole documents, from the models that they train."""
    from carelake.llm.common import table
    from carelake.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = []
    original = quality.ByteCNN.tables
    try:
        quality.ByteCNN.tables = lambda self: got.append(self) or original(self)
        rows = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, sf).collect()}
    finally:
        quality.ByteCNN.tables = original
    net = got[-1]
    shift = quality.train(docs, labels, quality.held_out)["bias"] - float(net.p["bias"][0])
    net.p["bias"][0] += shift
    texts = docs.where("length(text) < 1500").orderBy("doc_id").limit(12).collect()
    assert len(texts) == 12
    for r in texts:
        assert rows[r["doc_id"]]["score"] == pytest.approx(naive_quality(r["text"], net), abs=1e-4)


def test_training_reads_every_chunk_of_a_text(spark):
    """The mark that tells the classes apart is only far behind in long texts."""
    rows = [(i, prose(900, 3000 + i) + (" ZZ!!QQ%%" * 3 if i % 2 else "") + prose(900, 9000 + i), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, quality int")
    model = quality.train(docs, labels, quality.held_out, steps=400)
    p = quality.score_texts([r[1] for r in rows], model)
    assert np.mean((p >= 0.5) == (np.array([r[2] for r in rows]) == 1)) > 0.9


def test_later_parts_keep_the_system_turns_and_join_to_the_whole(spark):
    rows = [(1, 0, "system", "Rules é"), (1, 0, "system", "More"), (1, 1, "ann", "a1")] + [
        (1, i, "ann" if i % 2 else "bob", f"turn {i}") for i in range(2, 200)] + [(1, 150, "system", "late rule"), (2, None, "cy", "x"), (2, 70, "cy", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("carried", F.lit("clash"))
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(df, turns_per_part=10 ** 6).collect() if r["part"] >= 0}
    for who in ("ann", "bob"):
        parts = [got[(1, who, p)] for p in range(4)]
        assert [p["carried"] for p in parts] == [0, 2, 2, 2]
        lead = "<|system|>\nMore\n<|end|>\n<|system|>\nRules é\n<|end|>\n"
        assert all(p["text"].startswith(lead) for p in parts)
        own = [p["text"][len(lead) * (p["carried"] > 0):] for p in parts]
        assert "".join(own) == whole[(1, who)]["text"] and [p["text_offset"] for p in parts] == [sum(map(len, own[:k])) for k in range(4)]
        trained = [p["text"][m["start"]:m["end"]] for p in parts for m in p["mask"]]
        assert trained == [whole[(1, who)]["text"][m["start"]:m["end"]] for m in whole[(1, who)]["mask"]] and len(trained) > 90
        assert not any("Rules" in t for t in trained)
    assert got[(2, "cy", 1)]["carried"] == 0 and got[(2, "cy", 1)]["text_offset"] == len(got[(2, "cy", -1)]["text"])


def test_long_dialogues_equal_their_sql(spark, tmp_path):
    import duckdb
    from carelake.llm.queries import ORACLES, QUERIES
    rows = [(c, t, who, f"{c} {t} é") for c in range(4) for t in range(0, 40 + 60 * c) for who in (("system",) if t % 50 == 0 else ("a", "b"))]
    rows += [(9, None, "a", "x"), (9, 3, "system", "y"), (9, 80, "b", None), (9, 80, None, "z")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op8_chat"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    res = con.execute(ORACLES["op8_chat"])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(str, res.fetchall())) == sorted(str(tuple(r)) for r in got.select(*cols).collect())


def test_toxicity_learns_from_every_labelled_row(spark):
    n = 3000
    docs = spark.createDataFrame([(i, f"w{i % 7} zz" if i % 3 == 0 else f"w{i % 7}", "en") for i in range(n)], "doc_id bigint, text string, lang string")
    kept = [r[0] for r in docs.where(~toxicity.held_out(F.col("doc_id"))).select("doc_id").collect()]
    one = spark.createDataFrame([(i, 1) for i in range(n)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, one, toxicity.held_out)[0]["rate"] == (len(kept) + 0.5) / (len(kept) + 1)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)] + [(1, None), (None, 1), (2, 7), (0, 0)], "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, toxicity.held_out, "toxic", "lang", "doc_id", "text")
    hits = toxicity.bucket_counts(rows)
    assert hits[:, toxicity.encode("zz")[0][0]].tolist() == [0, sum(i % 3 == 0 for i in kept)]
    for w in range(7):
        of = [i for i in kept if i % 7 == w]
        assert hits[:, toxicity.encode(f"w{w}")[0][0]].tolist() == [sum(i % 3 > 0 for i in of), sum(i % 3 == 0 for i in of)]
    model, cut = toxicity.train(docs, labels, toxicity.held_out)
    got = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in got) and set(cut) == {"en"}


def test_toxicity_thresholds_have_the_least_error(spark):
    rng = np.random.default_rng(1)
    rows = [(lang, int(y), float(s)) for lang, shift in (("a", 0.0), ("b", 0.3)) for y, s in zip(rng.integers(0, 2, 80), rng.random(80) * 0.6 + shift)]
    rows = [(lang, y, min(1.0, s + 0.1 * y)) for lang, y, s in rows] + [("few", 1, 0.2)] * 5 + [("same", 0, 0.2)] * 30 + [(None, 1, 0.1)] * 20
    cut = toxicity.thresholds(spark.createDataFrame(rows, "lang string, y int, score double"))
    assert set(cut) == {"a", "b"}
    for lang, c in cut.items():
        errors = [sum((s >= g) != (y == 1) for v, y, s in rows if v == lang) for g in toxicity.GRID]
        best = [g for g, e in zip(toxicity.GRID, errors) if e == min(errors)]
        assert c == min(best, key=lambda g: abs(g - 0.5))
