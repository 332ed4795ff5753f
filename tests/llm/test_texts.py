import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cepage.llm import bpe, leakage, reading
from cepage.llm.words import words

ODD = [None, "", " ", " ", "\t \n", "a", "I'll they're\r\n\r\n  x", "<|endoftext|> a", "ブドウ" * 50, "é​﻿ x­", "ab" * 4000 + " " * 300, "\U0001f600 12345 ١٢", "z" * 20000]


def test_rank_queue_pops_in_rank_order():
    q = bpe.RankQueue()
    rng = random.Random(1)
    want = {}
    for k in range(500):
        r = rng.randrange(1 << 18)
        q.push(r, k)
        want.setdefault(r, []).append(k)
    got = []
    while (item := q.pop()) is not None:
        got.append(item)
    assert got == sorted(want.items())


def test_ids_equal_those_of_the_public_library(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    texts = ODD + [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(texts)] + [(None, "a b", "x", [1])], "doc_id bigint, text string, TEXT2 string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        assert got[k] == (theirs.encode(t, add_special_tokens=False).ids if t else []), k
    assert bpe.encode_corpus(df.limit(0)).collect() == []


def test_words_without_regard_to_writing():
    assert words("<p>Café&nbsp;ＡＢ de<b>gree</b>-day</p><p>x</p>") == ["cafe", "ab", "degree", "day", "x"]
    assert words("asym-\nmetric cell-\r\nwall ca​no­py", {"asymmetric"}) == ["asymmetric", "cell", "wall", "canopy"]
    assert words(None) == words("") == words(" .,! ") == []


def plain_leaks(text, item, span=12):
    """Brute force of both conditions."""
    d, i = words(text, set(words(item))), words(item)
    runs = {tuple(i[k : k + span]) for k in range(len(i) - span + 1)}
    if any(tuple(d[k : k + span]) in runs for k in range(len(d) - span + 1)):
        return True
    stretch, least = len(i) * 4 // 3, -(-len(i) * 4 // 5)
    for s in range(len(d)):
        row = [0] * (len(i) + 1)
        for w in d[s : s + stretch]:
            before = 0
            for k, v in enumerate(i, 1):
                before, row[k] = row[k], before + 1 if v == w else max(row[k], row[k - 1])
        if row[-1] >= least and i:
            return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(rng.randint(10, 45)))) for k in range(12)] + [(98, None), (99, ""), (100, "short one")]
    docs = [(k, t) for k, t in enumerate([None, "", " ", "short one", "SHORT, one!"])]
    for k in range(160):
        body = make(rng.randint(5, 60))
        source = items[rng.randrange(12)][1].split()
        at = rng.randrange(len(body))
        if k % 4 == 0:
            body[at:at] = source[: rng.randint(9, len(source))]
        elif k % 4 == 1:
            kept = [w for w in source if rng.random() < rng.choice([0.75, 0.82, 0.9])]
            for _ in range(rng.randint(0, 6)):
                kept.insert(rng.randrange(len(kept) + 1), rng.choice(vocabulary))
            body[at:at] = kept
        docs.append((100 + k, " ".join(body)))
    df = spark.createDataFrame([(*d, 0, "x") for d in docs + docs[:9] + [(None, docs[9][1])]], "doc_id bigint, text string, item_id int, __key string")
    it = spark.createDataFrame([(*i, 0) for i in items + items[:2]], "item_id bigint, text string, doc_id int")
    want = {(d, i) for d, t in docs if t for i, s in items if s and plain_leaks(t, s)}
    for options in ({}, {"item_bytes": 0}, {"item_bytes": 0, "hot_rows": 20}):
        got = [tuple(r) for r in leakage.find_leaks(df, it, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 30
    assert leakage.find_leaks(df.limit(0), it).collect() == [] and leakage.find_leaks(df, it.limit(0)).collect() == []


def test_leaks_of_items_of_every_length():
    """Reworked stretches that keep just four fifths of the words, with fillers between neighbours."""
    rng = random.Random(9)
    for n in range(1, 41):
        item = [f"w{k}" for k in range(n)]
        index = leakage.Items([(1, " ".join(item))])
        least, stretch = -(-n * 4 // 5), n * 4 // 3
        for trial in range(12):
            kept = sorted(rng.sample(range(n), least - (trial % 4 == 3)))
            body = [item[k] for k in kept]
            for _ in range(stretch - least + (trial % 4 == 2)):
                body.insert(rng.randrange(1, len(body) + 1), "filler")
            text = " ".join(["so", *body, "it", "ends"])
            assert bool(index.leaks(text)) == plain_leaks(text, " ".join(item)), (n, text)


def test_leaks_across_broken_lines_alike_both_ways(spark):
    items = [(1, "the downy mildew of the vine spreads in warm wet nights from leaf to leaf quickly"), (2, "a two step rule")]
    docs = [(1, "x the downy mil-\ndew of the vine spreads in warm wet nights from leaf y"), (2, "a two-\nstep rule"), (3, "a twos-\ntep rule"), (4, "the <b>dow</b>ny mildew of the vi-\r\nne spreads in warm wet ni-\nghts from leaf")]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for item_bytes in (1 << 20, 0):
        assert sorted(tuple(r) for r in leakage.find_leaks(df, it, item_bytes=item_bytes).collect()) == [(1, 1), (2, 2), (4, 1)]
    with pytest.raises(ValueError):
        leakage.find_leaks(df, it, item_bytes=0, known_bytes=1)


def test_winnowing_keeps_a_print_of_every_window():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    at = leakage.winnow(h, 8)
    assert all(((at >= k) & (at < k + 8)).any() for k in range(300 - 8 + 1))
    assert len(leakage.winnow(h[:0], 8)) == 0 and len(leakage.winnow(h[:3], 8)) == 1


EASY, HARD = "the red bug is on the big leaf . we cut a vine and look .", "notwithstanding heterogeneous sampling, the estimator nevertheless underrepresents phenotypic variability, whereas resampling attenuates it."


def corpus(n=60):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        level = 1 if k % 2 else 4
        part = (EASY if level == 1 else HARD).split()
        rows.append((k, level, " ".join(" ".join(rng.sample(part, len(part))) for _ in range(4))))
    return rows


def test_levels_follow_the_labels(spark):
    rows = corpus()
    odd = [(1000 + k, t) for k, t in enumerate(ODD)] + [(2000, "a=1 b=2 c=3\n" * 30), (2001, "x;y;z;w\n1;2;3;4\n" * 20), (None, EASY * 5)]
    docs = spark.createDataFrame([(k, t, 9, "x") for k, _, t in rows] + [(k, t, 9, "x") for k, t in odd], "doc_id bigint, text string, n int, words string")
    labels = spark.createDataFrame([(k, lv, "r") for k, lv, _ in rows[:30]] + [(rows[0][0], rows[0][1], "q"), (5, None, "q"), (None, 2, "q"), (2000, 3, "q"), (77777, 1, "q")], "doc_id bigint, reading_level int, level string")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels).collect()}
    assert {k: got.get(k) for k, _, _ in rows} == {k: lv for k, lv, _ in rows}
    assert not {2000, 2001, None, *range(1000, 1006)} & set(got)
    few = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels, hot_words=5).collect()}
    assert few == got
    assert reading.reading_levels(docs, labels.limit(0)).collect() == []
    assert reading.reading_levels(docs.limit(0), labels).collect() == []


def test_prose_drops_logs_tables_and_lists():
    text = "One fine day (n = 4, p = 2) it rained; we left; we ran; we hid.\na=1 b=2\nx;1;2;3\n- ESCA: 91\n{\"a\": 1}\n> said they\n| a | b |\nEnd."
    lines, of = reading.prose_lines(pa.array(["", text, "a<br>b\r\nc\u200bd\u2028e"]))
    assert lines.to_pylist() == ["", "One fine day (n = 4, p = 2) it rained; we left; we ran; we hid.", "End.", "a b", "", "cd", "e"]
    assert of.tolist() == [0, 1, 1, 2, 2, 2, 2]


def test_words_are_runs_of_letters_in_any_script():
    rng = random.Random(4)
    lines = ["", "a", "B1c", "one TWO", "r\u00c9sum\u00e9 m\u00b2 x\u00bd", "\u4e2d\u6587 abc", "'tis 9", *("".join(rng.choice("aZ\u00e9\u00df -1_.") for _ in range(rng.randrange(30))) for _ in range(300))]
    found, of = reading.words_of(pa.array(["skipped", *lines]).slice(1))
    got = sorted(zip(of.tolist(), found.to_pylist(), strict=True))
    assert got == sorted((k, w) for k, line in enumerate(lines) for w in re.findall(r"[^\W\d_]+", line.lower()))
    assert reading.words_of(pa.array([], pa.string()))[0].to_pylist() == []


def test_texts_are_counted_alike_in_blocks_of_any_size():
    texts = ["One two, two three. " * 9, None, "", "x " * 40, EASY * 30, "n o"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([t or "" for t in texts])], ["k", "t"])
    whole = pa.Table.from_batches([*reading._counted(15)([batch])]).to_pydict()
    for most in (1, 100, 700):
        assert _sorted_words(reading._counted(15, most)([batch])) == _sorted_words(reading._counted(15)([batch]))
    assert whole["__key"] == [0, 3, 4] and whole["n"][:2] == [36, 40]


def _sorted_words(batches):
    return [(r["__key"], sorted(zip(r["words"], r["counts"], strict=True)), r["n"]) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("hot_words", [20_000, 30, 1])
def test_coverage_ranks_against_brute_force(spark, data, hot_words):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["coverage_rank"]) for r in reading.coverage_ranks(docs, hot_words=hot_words).collect()}
    texts = reading.texts_of(docs, "doc_id", "text", 15).toPandas()
    counts: dict = {}
    for ws, cs in zip(texts.words, texts.counts, strict=True):
        for w, c in zip(ws, cs, strict=True):
            counts[w] = counts.get(w, 0) + c
    values = pd.Series(list(counts.values()))
    rank = {c: int((values > c).sum()) + 1 for c in set(values)}
    for key, ws, cs, n in zip(texts["__key"], texts.words, texts.counts, texts.n, strict=True):
        seen, at = 0, 0
        for r, c in sorted((rank[counts[w]], c) for w, c in zip(ws, cs, strict=True)):
            seen, at = seen + c, r
            if seen >= -(-n * 8 // 10):
                break
        assert got[key] == (n, at)


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    try:
        labels = spark.read.parquet(f"{path}/reading_label.parquet")
    except Exception:
        pytest.skip("no test tables here")
    held = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)) == 0
    got = reading.reading_levels(spark.read.parquet(f"{path}/documents.parquet"), labels.where(~held))
    both = labels.where(held & F.col("reading_level").isNotNull()).join(got.withColumnRenamed("reading_level", "p"), "doc_id")
    row = both.agg(F.avg((F.col("p") == F.col("reading_level")).cast("int")), F.count("*")).first()
    assert row[1] > 100 and row[0] > 0.85


def test_texts_searched_together_and_one_by_one():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(40)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.randint(1, 30))) for k in range(15)] + [(99, "")]
    texts = [None, "", make(3), *(make(rng.randint(0, 25)) + " " + rng.choice(items)[1] + " " + make(rng.randint(0, 25)) for _ in range(60)), make(400)]
    index = leakage.Items(items)
    together = index.leaks_of(texts)
    want = {(d, n) for d, t in enumerate(texts) if t for n, (_, s) in enumerate(items) if s and plain_leaks(t, s)}
    assert set(together) == want and len(want) > 50 and index.leaks_of([None, ""]) == []
    assert [(d, r) for d, t in enumerate(texts) for r in index.leaks(t)] == together
    lone = leakage.Items(items)
    assert {d: m.tolist() for d, m in lone._enough(*_numbered(lone, texts), dense=1)} == {d: m.tolist() for d, m in lone._enough(*_numbered(lone, texts))}


def _numbered(index, texts):
    found = [words(t, index.known) for t in texts]
    return np.array([index.vocabulary.get(w, 0) for f in found for w in f], np.int64), np.array([len(f) for f in found])


def test_winnowing_of_texts_one_after_the_other():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 9, n).astype(np.uint64) for n in (0, 3, 8, 20, 0, 1, 50)]
    ends = np.cumsum([len(p) for p in parts])
    got = leakage.winnow_all(np.concatenate(parts), np.array([len(p) for p in parts]), 8)
    want = []
    for part, end in zip(parts, ends, strict=True):
        for s in range(max(1, len(part) - 7) if len(part) else 0):
            w = part[s : s + 8]
            want.append(int(end) - len(part) + s + len(w) - 1 - int(np.argmin(w[::-1])))
    assert got.tolist() == sorted(set(want))
