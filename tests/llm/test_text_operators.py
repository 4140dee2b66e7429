"""Lines, near duplicates, decontamination and the pipeline against brute force, with nulls,
empty and very long texts, repeated rows, clashing columns and empty tables."""

import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraquilt.llm import common, decontamination, line_dedup, near_dedup, packing, quality, queries
from terraquilt.llm.words import shingle_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """doc_id and text: copies, near copies, shared passages, edited lines and odd rows."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(30, 120)).replace(" ", "\n", 3) for _ in range(25)]
    shared = prose(rng, 60)
    for i in range(12):
        w = out[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{prose(rng, 40)}\n{shared}\n{prose(rng, 40)}" for _ in range(8)]
    base = prose(rng, 14)
    out += [f"{base}\n{base[:-1]}", base[1:], base.replace("a", "", 1), base + "zz", base + "zzz"]
    out += [out[0], out[0], out[1].upper(), "", None, "\n\n", "word", "two words", prose(rng, 30_000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in corpus]
    return spark.createDataFrame([*rows, (None, "a text without an id that nobody else has at all", None, None, None)], DOCS)


def test_words_and_shingles(corpus):
    texts = [t or "" for _, t in corpus] + ["É, été x a-b 1.5", "ab", "Ab"]
    words, bounds = word_hashes(pa.array(texts, pa.large_string()))
    name, back = {}, {}
    for text, at, to in zip(texts, bounds[:-1], bounds[1:]):
        own = brute.words(text)
        assert len(own) == to - at
        for w, h in zip(own, words[at:to].tolist()):
            assert name.setdefault(h, w) == w and back.setdefault(w, h) == h
    for k in (1, 3, 5):
        h, bounds_k = shingle_hashes(words, bounds, k)
        seen = {}
        for text, at, to in zip(texts, bounds_k[:-1], bounds_k[1:]):
            own = brute.shingles(text, k)
            assert len(own) == to - at
            for s, x in zip(own, h[at:to].tolist()):
                assert seen.setdefault(x, s) == s


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("kitten", "sitting")]
    for _ in range(300):
        a = "".join(rng.choices("abé", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, edits + 1)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b) + 1)] = rng.choices("abé", k=rng.randint(0, 1))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    for r in got:
        assert r["w"] == (brute.edit_distance(r["a"], r["b"]) <= edits), r
    begun = df.where(line_dedup.within(F.col("a"), F.col("b"), edits)).where(~line_dedup.within(F.col("a"), F.col("b"), edits, 4))
    far = df.where(line_dedup.within(F.col("a"), F.col("b"), edits))
    far = far.where(~line_dedup.letters_near(line_dedup.letters(F.col("a")), line_dedup.letters(F.col("b")), edits))
    assert begun.count() == 0 and far.count() == 0


def test_letters_of_a_line(spark):
    """Four bits a letter, modulo 16, whatever else the line holds; no letter's count reads the whole line again."""
    texts = ["", "e", "é e\u20ac tt.", "a" * 17 + "n" * 16 + " ", "The quick brown fox jumped over the lazy dog. " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "line string").withColumn("got", line_dedup.letters(F.col("line")))
    for r in df.collect():
        want = sum((r["line"].count(c) % 16) << (4 * i) for i, c in enumerate(line_dedup.LETTERS))
        assert r["got"] % 2**64 == want
    assert " length(" not in str(df._jdf.queryExecution().analyzed().toString()).replace("octet_length(", "")


def test_line_classes(docs, corpus, monkeypatch):
    monkeypatch.setattr(line_dedup, "LIST_ROWS", 3)  # so that hot segments are split
    got = line_dedup.line_classes(docs).where("doc_id is not null").collect()
    want = brute.kept_lines(corpus, line_dedup.EDITS, line_dedup.MIN_CHARS)
    assert {(r["doc_id"], r["line_no"]): ((r["class_doc"], r["class_line"]), r["links"], r["kept"]) for r in got} == want
    assert len(got) == len(want)


def test_drop_lines(docs, corpus):
    wide = docs.withColumns({"row_key": F.lit("x"), "d": F.lit(1), "at": F.lit(2)})
    got = line_dedup.drop_lines(wide)
    assert got.columns == wide.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    flags = brute.kept_lines(corpus, line_dedup.EDITS, line_dedup.MIN_CHARS)
    for i, t in corpus:
        lines = [x for n, x in enumerate((t or "").split("\n")) if flags.get((i, n), (0, 0, True))[2]]
        changed = len(lines) < len((t or "").split("\n"))
        if changed and not "\n".join(lines).strip():
            assert i not in rows
        else:
            assert rows[i]["text"] == ("\n".join(lines) if changed else t)
    assert None in rows


def test_short_lines_repeat_exactly(spark, tmp_path):
    """Equal short lines are one class and go, near ones don't, blank ones stay; by the query and the stage."""
    base = "a line that is long enough to be joined by edits"
    texts = ["Les.\n- one\n\nAnd ornd.", "Les.\n- two\nLes.", f"les.\n{base}", "And ornd.\n\n\nLes.", "", None, "\n\n", " \nx", f"{base}s\nx", "Les.", "x"]
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = [(i, n, x) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    short = {x: min(y[:2] for y in found if y[2] == x) for *_, x in found if len(x) < line_dedup.MIN_CHARS}
    want = brute.kept_lines(list(enumerate(texts)), line_dedup.EDITS, line_dedup.MIN_CHARS)
    want |= {(i, n): (short[x], 0, short[x] == (i, n)) for i, n, x in found if x in short}
    got = queries.op2_line_dedup(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["line_no"]): ((r["class_doc"], r["class_line"]), r["links"], r["kept"]) for r in got} == want
    assert len(got) == len(want) == len(found)
    left = corpus_pipeline.repeated_lines(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {
        0: texts[0], 1: "- two", 2: texts[2], 4: "", 5: None, 6: "\n\n", 7: " \nx"
    }
    assert {r["doc_id"]: r["n_chars"] for r in left}[1] == 5


def test_near_duplicates(docs, corpus, monkeypatch):
    found = near_dedup.near_duplicates(docs.withColumn("class_id", F.lit(9)))
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    got.pop(None)  # a row without an id
    own = {i: brute.shingles(t) for i, t in corpus}
    pairs = {p: brute.jaccard(own[p[0]], own[p[1]]) for p in itertools.combinations(own, 2)}
    assert got.keys() == own.keys()
    # Nothing at the threshold is lost; weights may link a few pairs close under it.
    assert all(got[a] == got[b] for (a, b), x in pairs.items() if x >= near_dedup.THRESHOLD)
    wide = brute.classes(own, [p for p, x in pairs.items() if x >= near_dedup.THRESHOLD - 0.1])
    assert all(wide[i] == wide[c] for i, c in got.items())
    assert all(c == min(i for i in got if got[i] == c) for c in got.values())


def test_samples_follow_similarity():
    """The share of equal samples estimates the weighted Jaccard similarity."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 600, dtype=np.uint64)
    weights = rng.choice([1.0, 1.25, 2.5, 0.5], 600)
    other = np.where(rng.random(600) < 0.3, weights * 2, weights)
    first, second = np.sort(rng.choice(600, 450, False)), np.sort(rng.choice(600, 450, False))
    both = np.intersect1d(first, second)
    least = np.minimum(weights[both], other[both]).sum()
    truth = least / (weights[first].sum() + other[second].sum() - least)
    draw = near_dedup.Sampler(800)
    a = draw.draw(h[first], weights[first], np.array([0, 450]))
    b = draw.draw(h[second], other[second], np.array([0, 450]))
    assert abs((a == b).mean() - truth) < 0.06


def test_fine_screen_spares_linked_pairs():
    """Samples follow TF-IDF, where a pair of THRESHOLD by TF weights may be lower: the screen lies below any linked pair."""
    rng, close = np.random.default_rng(5), 0
    for _ in range(3000):
        shared, x, y = (rng.integers(0, n, rng.integers(1, 40)) for n in (4, 2, 2))
        counts = [np.concatenate([shared, x, np.zeros(len(y))]), np.concatenate([shared, np.zeros(len(x)), y])]
        idf = rng.uniform(1, 1 + near_dedup.DAMPING, len(counts[0])) if rng.random() < 0.5 else rng.choice([1, 1 + near_dedup.DAMPING], len(counts[0]))
        weights = [c * idf for c in counts]
        if min(w.sum() for w in weights) == 0:
            continue
        tf, tfidf = (np.minimum(*v).sum() / np.maximum(*v).sum() for v in (counts, weights))
        size, weight = (np.array([v.sum() for v in w]) for w in (counts, weights))
        least = near_dedup.least_alike(size, weight, np.array([0]), np.array([1]))[0]
        if max(tf, tfidf) >= near_dedup.THRESHOLD:
            equal = tfidf + (1 - tfidf) / 16
            close += 1
            assert least <= equal - 5.99 * (equal * (1 - equal) / near_dedup.FINE) ** 0.5
    assert close > 100
    x, y = (rng.integers(0, 256, (5, 400)).astype(np.uint8) for _ in "xy")
    nibbles = lambda z: np.stack([z >> 4, z & 15], 2).reshape(5, -1)
    assert np.allclose(near_dedup.alike(x, y), (nibbles(x) == nibbles(y)).mean(1))


def test_frequent_shingles(spark, corpus):
    df = spark.createDataFrame([(t,) for _, t in corpus], "text string").repartition(3)
    keys, weights = near_dedup.frequencies(df, rare=0.1)
    count = {}
    for _, t in corpus:
        for s in set(brute.shingles(t)):
            count[s] = count.get(s, 0) + 1
    assert len(keys) == sum(n >= 0.1 * len(corpus) for n in count.values()) > 0
    assert ((weights >= 1) & (weights <= 1.25 + 1e-9)).all()


def test_repeated_and_null_ids(spark):
    """Rows are documents by doc_id and text: none is lost, and copies go whatever their ids are."""
    text, other = "some words that are here more than once in this small table", "quite other words, these are"
    rows = [(1, text, 5, 0), (1, text, 5, 0), (2, text, 6, 0), (3, "else", 7, 0), (None, text, 8, 0), (1, other, 9, 0), (1, "  ", 1, 0), (1, "  ", 1, 0)]
    rows += [(None, "words of no id", 2, 0), (None, "words of no id", 2, 0), (None, "more words of no id", 3, 0), (None, None, 4, 0), (4, other, 4, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, row_key long")
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(tuple(r)[:3] for r in kept.na.fill({"doc_id": 0, "text": "null"}).collect())
    assert got == [(0, "more words of no id", 3), (0, "null", 4), (0, "words of no id", 2), (1, "  ", 1), (1, "  ", 1), (1, other, 9), (1, text, 5), (3, "else", 7)]
    found = near_dedup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by_id = sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in found if (r["class_id"] or 0) >= 0)
    assert by_id == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 1)]
    below = [r["class_id"] for r in found if (r["class_id"] or 0) < 0]
    assert len(below) == 3 and len(set(below)) == 2


def test_leaks(spark, docs, corpus, monkeypatch):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (3, 12, 30, 45, 45, 60)] + ["", None, prose(rng, 45)]
    items[8] = items[3]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def altered(item, n):
        w = item.split()
        for at in rng.sample(range(len(w)), n):
            w[at] = "other"
        return " ".join(w)

    texts = [f"{prose(rng, 20)}. {items[i].title()}! {prose(rng, 20)}" for i in (0, 1, 2, 3, 5)]
    texts += [prose(rng, 9) + " " + altered(items[5], 1), altered(items[5], 4), items[5][: int(len(items[5]) * 0.9)], items[4] * 2]
    rows = [(1000 + i, t, None, None, 1) for i, t in enumerate(texts)]
    mine = docs.union(spark.createDataFrame(rows, DOCS)).withColumns({"item_id": F.lit(1), "start": F.lit(2)})
    want = set()
    for doc, text in [*corpus, *((r[0], r[1]) for r in rows)]:
        for i, item in enumerate(items):
            k = min(5, len(brute.words(item)))
            if not k or len(brute.words(text)) < k:
                continue
            a, b = brute.shingles(text, k), brute.shingles(item, k)
            size = min(len(b), len(a))
            if not set(a) & set(b):
                continue
            if any(brute.jaccard(a[j : j + size], b) >= 0.8 for j in range(len(a) - size + 1)):
                want.add((doc, i))
    assert len(want) > 6
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 300)  # several passes
    got = decontamination.leaks(mine, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    left = decontamination.drop_leaks(mine, bench)
    assert left.columns == mine.columns
    gone = {d for d, _ in want}
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in mine.collect()} - gone


def test_text_goes_to_python_in_bounded_batches(spark):
    """Under 10,000 rows may be tens of megabytes; a size that the session names itself is kept."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 200_000).alias("text"))

    class Rows(quality.Model):
        def score(self, features):
            return np.full(len(features), float(len(features)))

    def most():
        scored = quality.score(docs, Rows(b"", b"", (), (), (), 0.5))
        return scored.agg(F.count("*"), F.max("score")).first()

    spark.conf.unset(size)
    try:
        rows, largest = most()
        assert rows == 200 and largest * 200_000 < 5_000_000
        spark.conf.set(size, "1m")
        assert most()[1] <= 6 and spark.conf.get(size) == "1m"
        bench = spark.createDataFrame([(1, "x y")], "item_id long, text string")
        path = __import__("public_tokenizers").path("word_bpe_49k.json")
        few = docs.limit(2)
        for operator in (near_dedup.near_duplicates, lambda d: decontamination.drop_leaks(d, bench), lambda d: packing.tokenize(d, path)):
            spark.conf.unset(size)
            operator(few)
            assert spark.conf.get(size) == common.TEXT_BATCH
    finally:
        spark.conf.unset(size)


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(empty, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    assert line_dedup.line_classes(empty).collect() == []
    assert near_dedup.near_duplicates(empty).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(empty, bench).collect() == []


def test_quality_keeps_all_without_labels(spark, docs, corpus, tmp_path):
    """No labels, or too few of a class with a share of good ones under the threshold: nothing was learnt."""
    few = [(i, int(i > 9), 0) for i in range(20)]
    for n, rows in enumerate(([], few)):
        path = tmp_path / str(n)
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
        left = corpus_pipeline.quality_filter(spark, docs, str(path))
        assert left.dtypes == docs.dtypes and left.count() == len(corpus) + 1


def test_stages_keep_columns(spark, docs, tmp_path):
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes, name
    assert packing.pack(docs, __import__("public_tokenizers").path("word_bpe_49k.json")).count() > 0
