"""Token counts, periodic runs and alignment against brute force, with edge cases and clashing columns."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carelake.llm import alignment, encoding, periodic, token_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n \t", "x", "<|endoftext|> and <|", "a▁b", "<0x41> <s></s> <unk>", "don't we'll  I'd've", "naïve Straße  ÆØÅ",
       "日本語 テキスト です。", "Привет, мир 123", "emoji 😀👨‍👩‍👧 end", "tab\tand\r\nlines\n\n\nmore", "a" * 5000, " " * 700, "é" * 900 + " z",
       "é combining ́x", "nul\x00byte \x1c sep\x85nel nbsp ls", "12345 67,89.0"]


def mixed(n, seed):
    """Words of several scripts with odd white space between them."""
    r = random.Random(seed)
    words = ["the", "Ünï", "don't", "x1y2", "日本", "мир", "!!", "<|endoftext|>", "naïve", "▁", "a-b", "42"]
    return "".join(r.choice(words) + r.choice([" ", "  ", "\n", " \n", "\t", ""]) for _ in range(n))


def some_texts():
    return ODD + [mixed(n, n) for n in (3, 40, 400, 3000)] + ["plain words only " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", i, 0) for i, t in enumerate(some_texts())]
    rows += [(4, "x", "again", 0, 0), (None, "no id, no id", "", 0, 0)]      # a repeated row, a null id
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string, block int, pair int").repartition(3)


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_parts_encode_as_the_whole_text(name):
    path = public_tokenizers.path(name)
    tokens = encoding.Tokens(path)
    if path.endswith(".model"):
        whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        tok = Tokenizer.from_file(path)
        whole = lambda t: tok.encode(t, add_special_tokens=False).ids
    assert tokens.cuts
    for t in some_texts():
        t = t or ""
        for most in (1, 7, 100):
            cut = list(encoding.parts(t, most, tokens))
            assert (" " if tokens.kind == "model" else "").join(cut) == t
            assert [i for ids in tokens(cut) for i in ids] == whole(t)
    assert any(len(list(encoding.parts(t or "", 7, tokens))) > 20 for t in some_texts())


def test_special_strings_can_be_plain_text():
    ids = encoding.Tokens(A, plain_specials=True)(["x <|endoftext|>", "é日 <|endoftext|>"])
    assert all(50256 not in i for i in ids) and 50256 in encoding.Tokens(A)(["x <|endoftext|>"])[0]


@pytest.mark.parametrize("part_chars", [5, token_counts.PART_CHARS])
@pytest.mark.parametrize("path", [A, B])
def test_token_counts_match_whole_texts(docs, local, path, part_chars):
    tok = sentencepiece.SentencePieceProcessor(model_file=path).encode if path == B else \
        lambda t, m=Tokenizer.from_file(path): m.encode(t, add_special_tokens=False).ids
    n = {t: len(tok(t or "")) for _, t in local}
    want = Counter((d, len((t or "").encode()), n[t], n[t] > 20) for d, t in local)
    got = token_counts.count_tokens(docs, path, limit=20, batch_bytes=64, part_chars=part_chars)
    assert got.columns == ["id", "n_bytes", "n_tokens", "over_limit"] and Counter(map(tuple, got.collect())) == want
    assert token_counts.count_tokens(docs.where("1 = 0"), path).count() == 0


def test_batches_are_balanced_by_bytes():
    tokens = encoding.Tokens(A)
    texts = ["w " * 30000, "é x " * 10, *["short one"] * 3000]
    batches = list(token_counts.balanced(enumerate(texts), 4000, 1000, tokens))
    sizes = [sum(len(t.encode()) for t in b) for _, b in batches]
    assert all(4000 <= s < 5200 for s in sizes[:-1]) and sizes[-1] < 5200
    assert "".join(t for rows, b in batches for r, t in zip(rows, b) if r == 0) == texts[0]


def brute_runs(w, shortest=6, repeats=4):
    """All maximal stretches with smallest period q, lag by lag."""
    number = {}
    c, found = np.array([number.setdefault(x, len(number)) for x in w], int), []
    for q in range(1, len(c) // repeats + 1):
        d = np.diff(np.concatenate(([0], (c[:-q] == c[q:]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()):
            n = e - s + q
            if n >= max(shortest, repeats * q) and not any((c[s:s + n - k] == c[s + k:s + n]).all() for k in range(1, q)):
                found.append((s, n, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(w, runs):
    keep = [True] * len(w)
    for s, n, q in runs:
        for i in range(s + q, s + n):
            keep[i] = False
    return b" ".join(x for x, k in zip(w, keep) if k)


def run_texts():
    r = random.Random(5)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a " * 7, "a b " * 4, "a b " * 3 + "a", "x " + "a b c " * 4 + "a b q", "a a b " * 9,
           "p q " * 6 + "q p " * 6, "a a a a a a b " * 5, "\x1c\x85 one two " * 9, "a b " * 8 + "b " * 7 + "a b " * 8]
    out += [" ".join(r.choice("ab") for _ in range(r.randrange(5, 200))) for _ in range(60)]
    out += [" ".join(r.choice("abcd") for _ in range(300)) for _ in range(10)]
    for _ in range(40):
        block = [r.choice("abcdef") for _ in range(r.randrange(1, 9))]
        out.append(" ".join([str(k) for k in range(r.randrange(4))] + block * r.randrange(3, 9) + block[:r.randrange(1, 4)] + ["z"] * r.randrange(9)))
    return out


def test_runs_match_brute_force(spark):
    texts = run_texts()
    docs = spark.createDataFrame([(i, t, "clash", []) for i, t in enumerate(texts)] + [(5, texts[5], "", []), (None, "k " * 9, "", [])],
                                 "doc_id bigint, text string, id string, runs array<int>").repartition(3)
    want = Counter()
    for r in docs.collect():
        w = (r["text"] or "").encode().split()
        runs = brute_runs(w)
        want[(r["doc_id"], len(w), tuple(runs), dropped(w, runs).decode())] += 1
    got = Counter((r["id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(docs).collect())
    assert got == want and sum(len(k[2]) for k in want) > 100
    assert periodic.periodic_runs(docs.where("1 = 0")).count() == 0


@pytest.mark.parametrize("shortest,repeats", [(2, 2), (6, 3), (20, 4)])
def test_other_bounds_of_runs(shortest, repeats):
    for t in run_texts():
        w = (t or "").encode().split()
        assert periodic.runs_of([w], shortest, repeats) == [brute_runs(w, shortest, repeats)]


def test_very_long_texts_of_few_words_stay_fast():
    n = 400_000
    assert periodic.runs_of([[b"a"] * n], 6, 4) == [[(0, n, 1)]]
    two = [b"x", *[b"a", b"b", b"a", b"c"] * (n // 4), b"y"]
    assert periodic.runs_of([two, [b"a"] * 9], 6, 4) == [[(1, n, 4)], [(0, 9, 1)]]


def test_rare_words_split_until_nothing_changes():
    # c stands four times, but after d has split the text only twice in each half
    codes = np.array([0, 1, 2, 0, 1, 2, 0, 1, 9, 0, 1, 2, 0, 1, 2, 0, 1] + [5] * 6)
    assert periodic.survivors(codes, np.zeros(len(codes), int), 4, 6) == [(17, 23)]
    assert periodic.survivors(np.zeros(12, int), np.repeat([0, 1], 6), 4, 6) == [(0, 6), (6, 12)]      # never across texts


def brute_alignment(local):
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_a, bytes_b = encoding.Tokens(A, True).token_bytes(), encoding.Tokens(B).token_bytes()
    found, counts, best = [], Counter(), defaultdict(int)
    for d, t in local:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        if any(b"".join(z[i] for i in ids) != (" " + (t or "")).encode() for z, ids in ((bytes_a, a), (bytes_b, b))):
            a = b = []
        spans = []
        for z, ids in ((bytes_a, a), (bytes_b, b)):
            ends = np.cumsum([len(z[i]) for i in ids], dtype=int)
            spans.append([(i, e - len(z[i]), e) for i, e in zip(ids, ends.tolist())])
        # two-pointer walk
        links, groups, i, j, now = [], [], 0, 0, ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = spans[0][i][2], spans[1][j][2]
            if x <= y:
                now[0].append(a[i])
                i += 1
            if y <= x:
                now[1].append(b[j])
                j += 1
            if x == y:
                groups.append("|".join(",".join(map(str, s)) for s in now))
                now = ([], [])
        found.append((d, len(a), len(b), len(groups), links, ";".join(groups)))
        counts.update(set(links))
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return Counter((d, na, nb, ng, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if na else "", g) for d, na, nb, ng, links, g in found)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_brute_force(docs, local, monkeypatch, small):
    if small:      # many blocks, parts and array passes, also inside one text
        for name, n in (("BLOCK", 300), ("CHUNK", 60), ("PART_CHARS", 9)):
            monkeypatch.setattr(alignment, name, n)
    got = alignment.align(docs, with_groups=True)
    assert got.columns[-2:] == ["groups_sha256", "groups"]
    want = brute_alignment(local)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(k[1] == 0 for k in want) >= 3 and sum(k[1] > 0 for k in want) > 10
    assert "groups" not in alignment.align(docs).columns and alignment.align(docs.where("1 = 0")).count() == 0
    assert alignment.align(docs.where("text = ''")).select("n_a", "n_links", "groups_sha256").collect() == [(0, 0, "")]


def test_pointers_reach_the_terminal_of_each_component():
    r = np.random.default_rng(6)
    for _ in range(30):
        a, b = (np.append(np.sort(r.choice(np.arange(1, 200), n, replace=False)), 200) for n in r.integers(0, 199, 2))
        to_a, to_b = alignment.terminals(a, b)
        common = np.intersect1d(a, b)
        for ends, to in ((a, to_a), (b, to_b)):
            assert (b[to] == common[np.searchsorted(common, ends)]).all()
    far = np.arange(1, 100001) * 2
    to_a, _ = alignment.terminals(np.append(far, 200001), np.append(far - 1, 200001))      # one chain of 200,000 tokens
    assert (to_a == 100000).all()


def test_queries_are_registered_with_their_columns(spark):
    from carelake.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    runs = QUERIES["op12_periodic_runs"](spark, sf)
    assert runs.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert runs.count() == n and runs.where(F.col("n_runs") > 0).count() > 0
    first = runs.where("n_runs = 0").first()
    assert first["start"] is None and first["runs_sha256"] == hashlib.sha256(b"").hexdigest()
    assert QUERIES["op11_token_counts"](spark, sf).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert QUERIES["op13_alignment"](spark, sf).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_repeats_a_period_in_a_tenth_of_the_texts(spark, tmp_path):
    import zlib
    from carelake.llm.queries import op12_periodic_runs
    texts = [" ".join(f"w{(i * k) % 17}" for k in range(i % 90)) if i % 7 else None if i % 2 else " " for i in range(400)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a " * 8)], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    want = {None: (1, 0, 8, 1, 8000, hashlib.sha256(b"0,8,1\n").hexdigest(), hashlib.sha256(b"a").hexdigest())}
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want[d] = (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
                   hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(dropped(w, runs)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 20
