"""Every training-data operator on small hand-made frames: brute force, edge cases, clashing columns."""
import hashlib
import pickle
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from carelake.llm import chat, components, decontaminate, embeddings, lm, packing, quality, simhash, suffixes, toxicity, urls

RNG = np.random.default_rng(7)
WORDS = ["".join(RNG.choice(list("abcdefgé"), 4)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def texts():
    base = prose(200, 1)
    rows = [base, base, base.upper(), base[:500] + " tail " + prose(60, 2), None, "", "  \n", "x", "a" * 3000,
            prose(3000, 3), prose(40, 4) + base[100:700], "<|endoftext|> and <|", "Ünï çødé  two  spaces\n\n"]
    return rows + [prose(int(n), 100 + k) for k, n in enumerate(RNG.integers(1, 300, 25))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, i % 5, "clash", "clash") for i, t in enumerate(texts())]
    rows += [(0, rows[0][1], "en", 0, "again", "again"), (None, "no id", "en", 0, "", "")]      # a repeated row, a null id
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars int, id string, _ka string").repartition(3)


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def none_of(docs):
    return docs.where("1 = 0")


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for i, j in pairs:
        up[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_simhash_groups_match_all_pairs(docs, local, bits):
    fps = [brute_fingerprint(t) for _, t in local]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])
    least = {r: min((local[i][0] for i in range(len(fps)) if root[i] == r and local[i][0] is not None), default=None) for r in root}
    want = Counter((local[i][0], fps[i], least[root[i]]) for i in range(len(fps)))
    got = Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(docs, 3, bits).collect())
    assert got == want


def test_covering_tables_meet_every_pair_in_the_radius(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 40)]
    near = [(b ^ (1 << int(i)) ^ (1 << int(j))) for b in base for i, j in rng.integers(0, 62, (6, 2))]
    fps = sorted(set(base + near))
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) % 2 ** 64).bit_count() <= 2])
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 2).collect()
    at = {f: i for i, f in enumerate(fps)}
    got = roots(len(fps), [(at[r["a"]], at[r["b"]]) for r in links])
    same = lambda r: {frozenset(i for i in range(len(r)) if r[i] == x) for x in r}
    assert same(got) == same(root) and all(((r["a"] ^ r["b"]) % 2 ** 64).bit_count() <= 2 for r in links)


def test_one_document_of_each_group_stays(docs):
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = simhash.simhash_groups(docs).select("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).distinct().count()
    assert len(ids) == groups and len(set(ids)) == len(ids)
    assert simhash.one_per_group(none_of(docs)).count() == 0


def test_suffix_removal_matches_brute_force(docs, local):
    data = [(t or "").encode() for _, t in local]
    seen = Counter(b[p:p + 400] for b in data for p in range(len(b) - 399))
    want = Counter()
    for (i, _), b in zip(local, data):
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p:p + 400]] > 1:
                m[p:p + 400] = True
        runs = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        want[(i, len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())] += 1
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())
                  for r in suffixes.removed(docs).collect())
    assert got == want and sum(k[2] for k in want) > 3000
    cut = suffixes.cut_texts(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert suffixes.removed(none_of(docs)).count() == 0


def test_cut_texts_collects_null_empty_and_cut_texts(docs, local):
    seen = Counter(b[p:p + 400] for _, t in local for b in [(t or "").encode()] for p in range(len(b) - 399))
    want = Counter()
    for i, t in local:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            m[p:p + 400] |= seen[b[p:p + 400]] > 1
        want[(i, None if t is None else np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore"))] += 1
    got = Counter((r["doc_id"], r["text"]) for r in suffixes.cut_texts(docs).collect())
    assert got == want and any(t is None for _, t in got) and any(t == "" for _, t in got)


@pytest.mark.parametrize("run_bytes", [20000, suffixes.RUN_BYTES])
def test_hot_grams_leave_small_groups_and_the_same_result(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(suffixes, "HOT", 20)
    monkeypatch.setattr(suffixes, "RUN_BYTES", run_bytes)
    footer, long = prose(40, 900)[:200], prose(120, 901)[:450]
    rows = [(i, prose(90, 1000 + i) + footer + prose(90, 2000 + i)) for i in range(90)]
    rows += [(100 + i, prose(30, 3000 + i) + long + prose(30, 4000 + i)) for i in range(40)]
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [(300, rows[7][1][100:900]), (7, rows[7][1]), (301, None), (302, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    texts = suffixes.keyed(docs).select(*suffixes.KEY, F.col("text").cast("binary"))
    hot = suffixes.hot_grams(texts, 400)
    assert len(hot)
    batch = pa.RecordBatch.from_pandas(pd.DataFrame(
        [(i, 0, t.encode()) for i, (_, t) in enumerate(rows) if t], columns=["ka", "kb", "text"]), preserve_index=False)
    largest, runs = {}, {}
    for name, grams in (("whole", hot[:0]), ("cut", hot)):
        sizes, runs[name] = Counter(), 0
        for out in suffixes._sorted_runs(400, 1, grams)(iter([batch])):
            if out.column(1)[0].as_py() == 1:
                runs[name] += 1
                blob = pickle.loads(zstandard.ZstdDecompressor().decompress(out.column(2)[0].as_py()))
                sizes.update(k[:8] for _, k, _ in suffixes.read_run(blob))
        largest[name] = max(sizes.values())
    assert largest["whole"] > 60 and largest["cut"] <= 20 + runs["whole"]
    seen = Counter(b[p:p + 400] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 399))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            m[p:p + 400] |= seen[b[p:p + 400]] > 1
        want[(i, len(b), int(m.sum()), np.frombuffer(b, np.uint8)[~m].tobytes())] += 1
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffixes.removed(docs).collect())
    assert got == want


def test_merge_never_loses_order():
    rng = np.random.default_rng(2)
    runs = []
    for _ in range(5):
        keys = sorted(bytes(rng.integers(97, 99, rng.integers(9, 40)).astype(np.uint8)) for _ in range(60))
        before, rows = b"", []
        for k in keys:
            rows.append((suffixes.common_prefix(before, k, 0), k, None))
            before = k
        runs.append(rows)
    out = list(suffixes.merge([iter(r) for r in runs]))
    assert [k for _, k, _ in out] == sorted(k for r in runs for _, k, _ in r)
    for (_, a, _), (same, b, _) in zip(out, out[1:]):
        assert same == suffixes.common_prefix(a, b, 0)


def brute_hits(local, items, n=13):
    import re
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall((t or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = Counter()
    for d, t in local:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                if (got := wins.get(tuple(w[i:i + m]))):
                    hit |= set(range(i, i + m))
                    found |= got
        out[(d, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None)))] += 1
    return out


@pytest.mark.parametrize("limit", [0, decontaminate.MAX_BROADCAST])
def test_decontamination_matches_brute_force(spark, docs, local, limit):
    items = [(1, prose(200, 1)[300:600]), (2, "x"), (3, None), (4, "  "), (1, prose(200, 1)[300:600]), (10, prose(3000, 3)[:400]), (None, "two spaces")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    r = decontaminate.report(docs, bench, max_broadcast=limit).collect()
    got = Counter((x["id"], x["n_words"], x["n_hit"], ",".join(sorted(i for i in x["items"] if i != "\0"))) for x in r)
    assert got == brute_hits(local, items)
    assert all(x["contaminated"] == (x["n_hit"] > 0 and 20 * x["n_hit"] >= x["n_words"]) for x in r)
    assert decontaminate.report(docs, none_of(bench)).where("n_hit > 0").count() == 0


def test_decontamination_drops_documents_or_spans(spark, docs):
    bench = spark.createDataFrame([(1, prose(200, 1))], "item_id int, text string")
    bad = decontaminate.report(docs, bench).where("contaminated").count()
    clean = decontaminate.clean_documents(docs, bench)
    assert bad > 2 and clean.count() == docs.count() - bad and clean.columns == docs.columns
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == docs.columns and decontaminate.report(cut, bench).where("n_hit > 0").count() == 0
    same = cut.exceptAll(docs).select("doc_id")
    assert same.count() <= decontaminate.report(docs, bench).where("n_hit > 0").count()


def test_backoff_scores_match_brute_force(docs, local):
    import math
    import re
    rx = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    ws = [rx.findall((t or "").encode().lower()) for _, t in local]
    c = Counter(tuple(w[i - n + 1:i + 1]) for w in ws for n in (1, 2, 3) for i in range(n - 1, len(w)))
    total, want = sum(map(len, ws)), []
    for (d, _), w in zip(local, ws):
        s = 0.0
        for i in range(len(w)):
            top = min(3, i + 1)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if n == 1 or c[g] >= 2:
                    s += math.log(c[g] / (total if n == 1 else c[g[:-1]])) + (top - n) * math.log(0.4)
                    break
        want.append((d is None, d or 0, len(w), round(s, 6)))
    got = [(r["id"] is None, r["id"] or 0, r["n_words"], round(r["log_score"], 6)) for r in lm.score(docs).collect()]
    assert sorted(got) == sorted(want)
    assert lm.score(none_of(docs)).count() == 0


def test_packing_round_trip(docs, local):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for d, t in local:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at, k = 0, 0
        while at < len(ids):
            to = (len(ids) - 1) % 256 + 1 if k == 0 else at + 256
            want[(d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes()), tuple(ids[at:to]))] += 1
            at, k = to, k + 1
    rows = packing.pack(docs, capacity=256, with_ids=True).collect()
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none_of(docs)).count() == 0


def test_fullest_bin_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 40, 8)
        counts = np.bincount(sizes, minlength=51)
        combo = packing.fullest(counts, 50)
        top = int(sizes.max())
        rest = list(sizes)
        rest.remove(top)
        best = max(top + s for m in range(1 << 7) if top + (s := sum(x for k, x in enumerate(rest) if m >> k & 1)) <= 50)
        assert sum(k * v for k, v in combo.items()) == best and all(v <= counts[k] for k, v in combo.items())


def test_embedding_links_match_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.05).tolist(), int(i % 2)) for i in range(600)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, [x * 3 for x in rows[0][1]], 0), (1003, None, 0), (1004, [0.0] * 16, 0),
             (1005, [float("nan")] * 16, 0), (1006, rows[0][1], None), (1007, [None] * 16, 0), (1008, [1.0], 0), (1009, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("c", F.lit("clash"))
    fine = [k for k, (_, v, g) in enumerate(rows) if v is not None and g is not None and None not in v and np.isfinite(v).all() and any(v)]
    pairs = []
    for a in fine:
        for b in fine:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt(x @ x * (y @ y)) >= 0.98:
                    pairs.append((a, b))
    root = roots(len(rows), pairs)
    n = Counter(x for p in pairs for x in p)
    want = {rows[k][0]: (n[k], min(rows[j][0] for j in range(len(rows)) if root[j] == root[k])) for k in range(len(rows))}
    old, embeddings.BLOCK = embeddings.BLOCK, 32      # so that buckets are dealt in blocks
    try:
        got = {r["id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    finally:
        embeddings.BLOCK = old
    assert got == want and len(pairs) > 1000
    assert embeddings.near_duplicates(df.where("1 = 0")).count() == 0


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Rules"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo é"), (1, 3, None, None), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"),
            (1, 70, "bob", "late"), (2, None, "cy", ""), (3, 0, "system", "alone"), (None, 0, "dee", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (2, "cy", -1), (None, "dee", 0)}
    a = got[(1, "ann", 0)]
    assert [a["text"][m["start"]:m["end"]] for m in a["mask"]] == ["Hi", "Bye", "Bye"] and (a["n_turns"], a["n_trained"]) == (6, 3)
    assert a["text"].startswith("<|system|>\nRules\n<|end|>\n<|assistant|>\nHi\n<|end|>\n<|user name=bob|>\nYo é") and "user name=unknown" in a["text"]
    assert got[(1, "ann", 1)]["mask"] == [] and got[(2, "cy", -1)]["n_trained"] == 1
    assert chat.rotate(df.where("1 = 0")).count() == 0


def test_url_filters_as_of(spark):
    t = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    entries = spark.createDataFrame([
        (1, "block", "d:bad.org", True, t(2)), (2, "block", "d:bad.org", False, t(9)), (3, "block", "d:bad.org", True, t(20)),
        (4, "allow", "p:x.bad.org/ok", True, t(3)), (5, "block", "p:fine.org/a", True, t(4)), (6, "block", "p:fine.org/a", False, t(4)),
        (7, None, "d:bad.org", True, t(1)), (8, "block", None, True, t(1)), (9, "block", "d:bad.org", True, None)],
        "entry_id bigint, list_name string, key string, adds boolean, effective_at string").withColumn("effective_at", F.to_timestamp("effective_at"))
    caps = spark.createDataFrame([
        (1, "http://x.bad.org/a?q", t(1)), (2, "http://x.bad.org/a", t(2)), (3, "https://u:p@X.BAD.org:80/ok/deep#f", t(5)), (4, "http://bad.org", t(8, 23)),
        (5, "http://bad.org/", t(9)), (6, "http://sub.bad.org/z", t(30)), (7, "http://fine.org/a/b", t(6)), (8, None, t(6)), (9, "junk", t(6)),
        (10, "http://bad.org/", None), (11, "http://notbad.org/", t(5)), (2, "http://x.bad.org/a", t(2))],
        "page_id bigint, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("key", F.lit("clash"))
    rows = urls.evaluate(caps, entries).collect()
    got = {r["id"]: (r["verdict"], r["entry_id"]) for r in rows}
    assert len(rows) == 12 and got == {
        1: ("keep", None), 2: ("block", 1), 3: ("allow", 4), 4: ("block", 1), 5: ("keep", None), 6: ("block", 3), 7: ("keep", None),
        8: ("keep", None), 9: ("keep", None), 10: ("keep", None), 11: ("keep", None)}
    two = next(r for r in rows if r["id"] == 4)
    assert str(two["valid_from"]).startswith("2024-01-02") and str(two["valid_to"]).startswith("2024-01-09")
    assert urls.evaluate(caps, entries.where("1 = 0")).where("verdict <> 'keep'").count() == 0


def labelled(spark, mark):
    rows = [(i, prose(30 + i % 50, 1000 + i) + (mark if i % 3 == 0 else ""), "en" if i % 2 else "de", int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[3], 1 - r[3]) for r in rows], "doc_id bigint, toxic int, quality int")
    return docs, labels


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_learn_and_cover_edge_texts(spark, kind):
    mod, mark = (toxicity, " zzgrumpf qq") if kind == "toxic" else (quality, " !!%%!! ZZ!! QQ%% " * 8)
    docs, labels = labelled(spark, mark)
    got = mod.train(docs, labels, mod.held_out)
    model = got[0] if kind == "toxic" else got
    y = {r["doc_id"]: r[kind] for r in labels.collect()}
    held = mod.score(docs, model, "_p").where(mod.held_out(F.col("doc_id"))).collect()
    right = np.mean([(r["_p"] >= 0.5) == (y[r["doc_id"]] == 1) for r in held])
    assert len(held) > 80 and right > 0.95 and held[0]["score"] == "clash"
    edge = ["", None, "x", " " * 10, mark, "long " * 60000 + mark, "éé" * 1000]
    p = mod.score_texts(edge, model)
    assert np.isfinite(p).all() and (0 <= p).all() and (p <= 1).all() and p[0] == p[1]
    if kind == "toxic":
        assert p[5] > 0.5      # the end of a very long text counts
        flagged = toxicity.flag(mod.score(docs, model, "_p"), got[1], "_p")
        assert {"threshold", "flagged"} <= set(flagged.columns)
    one = mod.train(docs, labels.where(f"{kind} = 1"), mod.held_out)
    one = one[0] if kind == "toxic" else one
    assert 0.9 < mod.score(docs, one, "_p").first()["_p"] <= 1
    empty = mod.train(docs, none_of(labels), mod.held_out)
    assert mod.score(none_of(docs), empty[0] if kind == "toxic" else empty, "_p").count() == 0


def test_bad_tokens_do_not_meet_the_fast_path():
    e = packing.Encoder(packing.default_tokenizer())
    for t in texts():
        assert np.frombuffer(e.encode(t or ""), "<u4").tolist() == e.tok.encode(t or "", add_special_tokens=False).ids


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs2 = stage(spark, docs, sf)
        assert docs2.columns == docs.columns
        docs2.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "near_duplicates":
            fps = [brute_fingerprint(t) for _, t in before]
            root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
            assert set(after) == {min(before[i][0] for i in range(len(fps)) if root[i] == r) for r in root}
        if name == "repeated_strings":
            seen = Counter(b[p:p + 400] for _, t in before for b in [(t or "").encode()] for p in range(len(b) - 399))
            for d, t in before:
                b = (t or "").encode()
                m = np.zeros(len(b), bool)
                for p in range(len(b) - 399):
                    m[p:p + 400] |= seen[b[p:p + 400]] > 1
                assert after[d] == np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            bad = {k[0] for k in brute_hits(before, items) if k[2] and 20 * k[2] >= k[1]}
            assert set(after) == {d for d, _ in before} - bad
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_frames_of_pandas_survive_types():
    assert pd.Series(quality.score_texts(["a"], {"rate": 0.25})).tolist() == [0.25]
