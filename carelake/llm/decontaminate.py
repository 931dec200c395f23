"""Benchmark decontamination (operator 3, DataFrame functions only).

Words are runs of ASCII letters and digits and of non-ASCII characters of the text with A-Z
lower-cased. Every ``n`` consecutive words of a benchmark item are a window (an item of fewer
words, but not none, is one window). The distinct windows form a hash set that is
broadcast when it has at most ``MAX_BROADCAST`` windows, a number that is counted first;
beyond that the windows are joined by a shuffle on the hash, in which AQE may split
frequent n-grams. One scan explodes the start positions of a document inside its row,
hashes the windows there, probes the set, and compares the words of what it finds, so only
verified hits are shuffled, next to one row per document. Short items add window lengths; their
hashes are taken in the same scan, up to ``PASS_WORDS`` words, and in at most two more beyond.

Defined results: null, empty and wordless texts have no words and no hits; repeated rows
each get their own row; a null id stays a null id; benchmark items with a null id count
as an item without a name in ``n_items`` and are left out of the hashed list; an empty
benchmark gives documents without hits; other columns of either table are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import KEY, keyed, with_key

# What separates words (in lower-cased text, and in text as it is).
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST = 200_000      # windows of at most some hundred bytes each
PASS_WORDS = 40              # words that one generated method hashes at a start


def words(text: Column) -> Column:
    parts = F.split(F.translate(text, UPPER, LOWER), SEPARATOR)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def benchmark_windows(bench: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, len, h, h2, items): distinct windows with the items they come from."""
    w = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    each = w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("window"))
    return each.groupBy("window").agg(F.collect_set(F.coalesce("item", F.lit("\0"))).alias("items")).select(
        "window", F.size("window").alias("len"), F.xxhash64("window").alias("h"),
        F.xxhash64(F.lit(1), "window").alias("h2"), "items")


def _at(i: Column, length: int, *seed: Column) -> Column:
    """Hash of the ``length`` words from position i; equals the hash of the array of them."""
    return F.xxhash64(*seed, *[F.get("words", i + k) for k in range(length)])


def _passes(lengths: list[int]) -> list[list[int]]:
    """``lengths`` in groups whose hashes fit one compiled method: at most ``PASS_WORDS`` words a group."""
    out: list[list[int]] = []
    for m in lengths:
        if out and sum(out[-1]) + m <= PASS_WORDS:
            out[-1].append(m)
        else:
            out.append([m])
    return out


def _starts(base: DataFrame, lengths: list[int], words_verify: bool) -> DataFrame:
    """A row (i, m, _h[, _h2]) for every start i and length m that fit, and one with i = -1 for the document.

    Both explodes and what follows stay in generated code, where ``words`` is read in place and
    not copied from row to row, so the bytes grow with the words and not with their square.
    """
    rows = base.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(
        F.col("n_words") - lengths[0], F.lit(-1)))).alias("i"))
    i, seeds = F.col("i"), [()] if words_verify else [(), (F.lit(1),)]

    def probe(m: int) -> list:
        return [F.when(i >= 0, _at(i, m, *seed)).alias(name) for seed, name in zip(seeds, ("_h", "_h2"))]
    if len(lengths) == 1:
        return rows.select("*", F.lit(lengths[0]).alias("m"), *probe(lengths[0]))
    each = [F.when((i >= 0) & (i + m <= F.col("n_words")) | ((i < 0) & F.lit(k == 0)), F.struct(F.lit(m).alias("m"), *probe(m)))
            for k, m in enumerate(lengths)]
    return rows.select("*", F.explode(F.array(*each)).alias("e")).where("e is not null").select(
        *rows.columns, "e.*")


def hits(docs: DataFrame, bench: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
         max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, __llm_ka, __llm_kb, n_words, spans, items) per row; spans are sorted word ranges [start, end)
    of verified windows, items the benchmark items whose windows occur."""
    win = benchmark_windows(bench, n)
    sizes = {r["len"]: r["c"] for r in win.groupBy("len").agg(F.count("*").alias("c")).collect()}    # at most n rows
    lengths = sorted(sizes) or [n]
    base = keyed(docs, id_col, text_col).select("id", *KEY, words(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words"))
    small = sum(sizes.values()) <= max_broadcast
    found = None
    for k, some in enumerate(_passes(lengths)):
        rows = _starts(base, some, small)
        if k:      # the first pass has the row of the document itself
            rows = rows.where("i >= 0")
        if small:
            got = rows.join(F.broadcast(win), (F.col("_h") == F.col("h")) & (F.col("m") == F.col("len")), "left")
            got = got.where((F.col("i") < 0) | (F.slice("words", F.col("i") + 1, F.col("m")) == F.col("window")))
        else:      # words do not travel with every start: a second hash of the window verifies
            thin = rows.select("id", *KEY, "n_words", "i", "m", "_h", "_h2")
            got = thin.join(win.drop("window"), (F.col("_h") == F.col("h")) & (F.col("m") == F.col("len")), "left")
            got = got.where((F.col("i") < 0) | (F.col("_h2") == F.col("h2")))
        got = got.select("id", *KEY, "n_words", "i", "m", "items")
        found = got if found is None else found.unionByName(got)
    span = F.when(F.col("i") >= 0, F.struct(F.col("i").alias("start"), (F.col("i") + F.col("m")).alias("end")))
    per = found.select("id", *KEY, "n_words", "i", span.alias("span"), "items").groupBy(*KEY).agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.count_if(F.col("i") < 0).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return per.select("id", *KEY, "n_words", "spans", "items",
                      F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).drop("_copy")


def covered(spans: Column) -> Column:
    """Number of words inside sorted spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).cast("bigint").alias("total"),
        F.greatest(a["upto"], s["end"]).cast("bigint").alias("upto")), lambda a: a["total"])


def report(docs: DataFrame, bench: DataFrame, n: int = 13, share: int = 20, **kw) -> DataFrame:
    """``hits`` plus n_hit and ``contaminated``: hits exist and are at least 1/share of the words."""
    r = hits(docs, bench, n, **kw).withColumn("n_hit", covered(F.col("spans")))
    return r.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean_documents(docs: DataFrame, bench: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows."""
    bad = report(docs, bench, n, share, id_col=id_col, text_col=text_col).where("contaminated").select(*KEY).distinct()
    return with_key(docs, id_col, text_col).join(bad, KEY, "left_anti").drop(*KEY)


def without_spans(docs: DataFrame, bench: DataFrame, n: int = 13, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what separates them from the next word, cut out of the text."""
    spans = hits(docs, bench, n, id_col, text_col).where(F.size("spans") > 0).select(*KEY, F.col("spans").alias("__llm_spans")).dropDuplicates(KEY)
    rows = with_key(docs, id_col, text_col).join(spans, KEY, "left")
    t = F.col(text_col)
    head = F.regexp_extract(t, "^" + SEPARATOR.replace("\\x60", "\\x40\\x5B-\\x60", 1), 0)
    kept = F.filter(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), lambda w, i: ~F.exists(
        F.col("__llm_spans"), lambda s: (s["start"] <= i) & (i < s["end"])))
    cut = F.concat(head, F.array_join(kept, ""))
    return rows.withColumn(text_col, F.when(F.col("__llm_spans").isNull(), t).otherwise(cut)).drop(*KEY, "__llm_spans")
