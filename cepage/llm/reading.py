"""Reading level of each document from the vocabulary that covers it.

The coverage rank of a document is the size of the smallest frequency-ranked vocabulary that covers a given share
of its words. It is taken against the corpus (ranks by counts over all documents) and against the vocabulary of
each reading level (ranks by counts over the labelled documents of that level): a text is covered soonest by the
words of its own level, whatever their length. Coverage ranks and sentence complexity are calibrated against the
human levels by a linear discriminant whose sums are taken in SQL; scoring is one SQL expression.

Corpus ranks alone, with sentence complexity, agree with the raters much less often than with the ranks per level,
as short words can carry research argument (figures in the README). The ranks by which a labelled document enters the
fit come from the other half of the labelled documents.

Scale: lines and words are found by Arrow's own kernels, whole batches at a time; a document's words are counted
within its row; counts per word are summed before the shuffle; ranks come from the histogram of counts, so no task
sorts the vocabulary. Exactly ``hot_words`` most frequent words are sent to all tasks. Only documents that those do
not cover send their rarer words through a join with all other ranks; no such word is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.operators.joins import skewed_lookup
from cepage.session import cut, spread

SHARES = (0.5, 0.8, 0.95)
LEVELS = (1, 2, 3, 4)
RANKS = ("g", *(f"l{k}" for k in LEVELS))
COMPLEXITY = ("words_per_sentence", "word_length", "long_words", "commas")
COVERED = tuple(f"{r}_{s}" for r in RANKS for s in range(len(SHARES)))
FEATURES = (*COVERED, *COMPLEXITY)
# Lines that are no running prose (logs, tables, records, bare list entries, quoted mail), and tags.
NO_PROSE = (
    r"^\s*\S+=\S+(\s+\S+=\S+)+\s*$|^\s*[\[{].*[\]}]\s*$|^[^\s;]*(;[^\s;]*){3,}$|^.{0,200}(\|.{0,200}){2,}$"
    r"|^([^\t]{0,60}\t){2,}[^\t]{0,60}$|^\s*(>|&gt;)|^\s*[-*\x{2022}\x{2013}]\s*[^.!?:]{0,40}:\s*[-+0-9.,%]+\s*$"
)
MARKS = r"[=;|\t>{\[:]|&gt;"
TAGS = r"<[A-Za-z/!][^<>]*>"
UNSEEN = r"[\x{200b}-\x{200f}\x{2060}\x{feff}\x{00ad}]"
BREAKS = r"[\r\x{2028}\x{2029}]"
NO_LETTER = r"[^\p{L}\p{Nl}\p{No}]+"
END = r"[.!?]+(\s|$)"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _where(mask: pa.Array, values: pa.Array, change) -> pa.Array:
    """``values``, changed where ``mask`` holds."""
    at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    if not len(at):
        return values
    return pc.replace_with_mask(values, mask, change(values.take(pa.array(at))))


def prose_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lines of running prose, the text each is of): without tags, logs, tables, records, bare lists and quoted mail."""
    texts = texts.cast(pa.string())
    texts = _where(pc.match_substring(texts, "<"), texts, lambda t: pc.replace_substring_regex(t, TAGS, " "))
    wide = pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts).cast(pa.int32()))
    texts = _where(wide, texts, lambda t: pc.replace_substring_regex(t, UNSEEN, ""))
    texts = _where(pc.or_(pc.match_substring(texts, "\r"), wide), texts, lambda t: pc.replace_substring_regex(t, BREAKS, "\n"))
    split = pc.split_pattern(texts, "\n")
    lines = split.flatten()
    of = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    # Most lines have none of the marks that the patterns ask for.
    marked = np.flatnonzero(pc.match_substring_regex(lines, MARKS).to_numpy(zero_copy_only=False))
    keep = np.ones(len(lines), bool)
    if len(marked):
        keep[marked] = ~pc.match_substring_regex(lines.take(pa.array(marked)), NO_PROSE).to_numpy(zero_copy_only=False)
    return lines.filter(pa.array(keep)), of[keep]


def _ascii_words(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words in lower case, the line each is of) of lines of ASCII letters."""
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    if at[-1] == at[0]:
        return pa.array([], pa.string()), np.empty(0, np.int64)
    data = np.frombuffer(lines.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(letter & (edge[:-1] | ~np.append(False, letter[:-1])))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.append(letter[1:], False))) + 1
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]]))
    return found, np.searchsorted(at, starts, "right") - 1


def words_of(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words in lower case: runs of letters, the line each is of)."""
    plain = pc.equal(pc.binary_length(lines), pc.utf8_length(lines).cast(pa.int32())).to_numpy(zero_copy_only=False)
    narrow, wide = np.flatnonzero(plain), np.flatnonzero(~plain)
    one, of_one = _ascii_words(lines.take(pa.array(narrow)))
    parts = pc.split_pattern_regex(pc.utf8_lower(lines.take(pa.array(wide))), NO_LETTER)
    two = parts.flatten()
    of_two = np.repeat(wide, np.diff(parts.offsets.to_numpy()))
    filled = pc.not_equal(two, "").to_numpy(zero_copy_only=False)
    return pa.concat_arrays([one, two.filter(pa.array(filled))]), np.concatenate([narrow[of_one], of_two[filled]])


def _counted(min_words: int, most: int = 1 << 27):
    """A mapInArrow function: (key, text) to its distinct words, their counts and the complexity."""

    def count(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
        lines, of = prose_lines(texts)
        if not len(lines):
            return None
        found, line = words_of(lines)
        n = np.bincount(of[line], minlength=len(texts))
        kept = np.flatnonzero(n >= min_words)
        if not len(kept):
            return None
        coded = found.dictionary_encode()
        length = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
        code = coded.indices.to_numpy().astype(np.int64)
        # One sort by text and word gives the distinct words of each text and their counts.
        pairs = np.sort((of[line] << 32) | code)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        doc, word, times = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF, np.diff(np.append(first, len(pairs)))
        inside = n[doc] >= min_words
        doc, word, times = doc[inside], word[inside], times[inside]
        sums = lambda weight: np.bincount(doc, weight, minlength=len(texts))[kept]
        ends = np.bincount(of, pc.count_substring_regex(lines, END).to_numpy(), minlength=len(texts))[kept]
        commas = np.bincount(of, pc.count_substring(lines, ",").to_numpy(), minlength=len(texts))[kept]
        many = n[kept]
        at = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts))[kept])).astype(np.int32))
        columns = [np.log(many / np.maximum(1, ends)), np.log(sums(times * length[word]) / many), sums(times * (length[word] >= 9)) / many, commas / many]
        lists = [pa.ListArray.from_arrays(at, coded.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(kept)), *lists, pa.array(many.astype(np.int64)), *map(pa.array, columns)], ["__key", "words", "counts", "n", *COMPLEXITY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts are taken together up to ``most`` bytes; a longer one is taken by itself.
            upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
                out = count(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at))
                if out is not None:
                    yield out
                at = to

    return run


def texts_of(documents: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """__key, distinct words, their counts, their sum n and the complexity of documents that hold running prose."""
    rows = documents.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = spread(rows.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("p")))
    kind = dict(rows.dtypes)["__key"]
    return rows.mapInArrow(_counted(min_words), f"`__key` {kind}, words array<string>, counts array<bigint>, n bigint, " + ", ".join(f"{c} double" for c in COMPLEXITY))


def _entries(texts: DataFrame, *more: str) -> DataFrame:
    return texts.select("__key", *more, F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("c"))))


def corpus_ranks(texts: DataFrame) -> DataFrame:
    """word, g: one more than the number of words that occur more often in all documents."""
    counts = cut(_entries(texts).groupBy("word").agg(F.sum("c").alias("c")))
    sizes = counts.groupBy("c").agg(F.count("*").alias("k"))
    # Distinct counts are few (about the square root of the number of words at most); many words have the same low one.
    above = F.sum("k").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = cut(sizes.select("c", "k", (F.coalesce(above, F.lit(0)) + 1).alias("g")))
    return skewed_lookup(counts, ranks, "c", "k").select("word", "g")


def level_ranks(texts: DataFrame, judged: DataFrame, level_words: int = 200_000) -> DataFrame:
    """fold, word and its rank l1..l4 among the words of each level; fold 0 and 1 hold the other half, 2 all.

    judged: __key, level, half. Ranks are null where a level lacks the word, or has ``level_words`` more frequent ones.
    """
    used = texts.join(F.broadcast(judged), "__key").withColumn("fold", F.explode(F.array(1 - F.col("half"), F.lit(2))))
    counts = _entries(used, "fold", "level").groupBy("fold", "level", "word").agg(F.sum("c").alias("c"))
    order = Window.partitionBy("fold", "level").orderBy(F.desc("c"), "word")
    ranked = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= level_words)
    return ranked.groupBy("fold", "word").agg(*(F.max(F.when(F.col("level") == k, F.col("r"))).alias(f"l{k}") for k in LEVELS))


def weighted_coverage(doc: np.ndarray, rank: np.ndarray, count: np.ndarray, totals: np.ndarray, shares: tuple[float, ...]) -> list[np.ndarray]:
    """For each document (0, 1, ...), the smallest ranks up to which its words make up shares of its total; 0 if none."""
    order = np.argsort((doc.astype(np.int64) << 40) | rank)
    doc, rank = doc[order], rank[order]
    upto = np.append(np.cumsum(count[order]), 0)
    first, last = np.searchsorted(doc, np.arange(len(totals)), "left"), np.searchsorted(doc, np.arange(len(totals)), "right")
    base = upto[first - 1]
    out = []
    for share in shares:
        at = np.searchsorted(upto[:-1], base + np.ceil(share * totals - 1e-9).astype(np.int64), "left")
        out.append(np.where(at < last, np.append(rank, 0)[np.minimum(at, len(rank))], 0))
    return out


def _covered(words: pa.Array, table: np.ndarray):
    """A mapInArrow function: the coverage ranks of texts; table: per word, column g and l1..l4 of each fold."""
    flat = np.ascontiguousarray(table.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                lists, counts = batch.column("words"), batch.column("counts").flatten().to_numpy()
                found = pc.index_in(lists.flatten().cast(pa.string()), value_set=words)
                at = found.fill_null(len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                totals = batch.column("n").to_numpy()
                fold = batch.column("fold").to_numpy()[doc].astype(np.int64)
                out = []
                for r in range(len(RANKS)):
                    rank = flat[0].take(at) if r == 0 else flat.reshape(-1).take((fold * len(LEVELS) + r) * flat.shape[1] + at)
                    if r == 0:
                        known = rank > 0
                        out += map(pa.array, weighted_coverage(doc[known], rank[known], counts[known], totals, SHARES))
                    else:
                        out += map(pa.array, weighted_coverage(doc, rank, counts, totals, SHARES))
                yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("fold"), *out], ["__key", "fold", *COVERED])

    return run


def coverage(entries: Column, field: str, seen: Column, total: Column, shares: tuple[float, ...]) -> Column:
    """Coverage ranks at each share, over an array of structs with c and ``field``, after ``seen`` words of lower rank."""
    pairs = F.array_sort(F.transform(entries, lambda e: F.struct(e[field].cast("bigint").alias("r"), e["c"].alias("c"))))
    start = F.struct(seen.cast("bigint").alias("seen"), *(F.lit(None).cast("bigint").alias(f"s{k}") for k in range(len(shares))))

    def step(acc: Column, e: Column) -> Column:
        upto = acc["seen"] + e["c"]
        return F.struct(upto.alias("seen"), *(F.coalesce(acc[f"s{k}"], F.when(upto >= F.ceil(total * s - 1e-9), e["r"])).alias(f"s{k}") for k, s in enumerate(shares)))

    return F.aggregate(pairs, start, step)


def _split_ranks(corpus: DataFrame, hot_words: int) -> tuple[DataFrame, Column]:
    """(the ``hot_words`` words of least rank, ties by word; the condition that a word of ``corpus`` is none of them)."""
    hot = corpus.orderBy("g", "word").limit(hot_words)
    last = hot.agg(F.max(F.struct("g", "word")).alias("x")).first()["x"]
    if last is None:
        return hot, F.lit(True)
    return hot, (F.col("g") > last["g"]) | ((F.col("g") == last["g"]) & (F.col("word") > last["word"]))


def _rare_coverage(texts: DataFrame, corpus: DataFrame, rare: Column, shares: tuple[float, ...]) -> DataFrame:
    """(__key, x) of texts whose shares lie beyond the hot words: their rarer words meet their ranks in a join."""
    entries = _entries(texts, "n").join(corpus.where(rare), "word")
    lists = entries.groupBy("__key", "n").agg(F.collect_list(F.struct("c", "g")).alias("e"), F.sum("c").alias("rare"))
    return lists.select("__key", coverage(F.col("e"), "g", F.col("n") - F.col("rare"), F.col("n"), shares).alias("x"))


def coverage_of(texts: DataFrame, corpus: DataFrame, levels: DataFrame, hot_words: int) -> DataFrame:
    """__key, fold and the coverage ranks of texts with a fold; words that a level lacks rank behind all its own."""
    first, rare = _split_ranks(corpus, hot_words)
    hot, known = first.toPandas(), levels.toPandas()
    words = sorted({*hot["word"], *known["word"]})
    place = {w: k for k, w in enumerate(words)}
    behind = 2 * len(known) + 1
    table = np.full((len(words) + 1, 1 + 3 * len(LEVELS)), behind, np.int64)
    table[:, 0] = 0
    table[[place[w] for w in hot["word"]], 0] = hot["g"]
    rows = [place[w] for w in known["word"]]
    for k in LEVELS:
        table[rows, 1 + known["fold"] * len(LEVELS) + k - 1] = known[f"l{k}"].fillna(behind)
    sent = texts.sparkSession.sparkContext.broadcast((pa.array(words, pa.string()), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _covered(*sent.value)(batches)

    kind = dict(texts.dtypes)["__key"]
    covered = texts.select("__key", "fold", "words", "counts", "n").mapInArrow(run, f"`__key` {kind}, fold int, " + ", ".join(f"{c} bigint" for c in COVERED))
    covered = cut(covered)
    short = covered.where(" or ".join(f"g_{k} = 0" for k in range(len(SHARES))))
    if short.isEmpty():
        return covered
    left = texts.join(short.select("__key").distinct(), "__key", "left_semi").dropDuplicates(["__key"])
    exact = _rare_coverage(left, corpus, rare, SHARES)
    filled = [F.when(F.col(f"g_{k}") > 0, F.col(f"g_{k}")).otherwise(F.col(f"x.s{k}")).alias(f"g_{k}") for k in range(len(SHARES))]
    return covered.join(exact, "__key", "left").select("__key", "fold", *filled, *(c for c in COVERED if not c.startswith("g_")))


def _discriminant(labelled: DataFrame, shrink: float) -> dict[int, tuple[np.ndarray, float]]:
    """Weights and constant of each level, from sums over pairs of features taken in SQL."""
    n = len(FEATURES)
    f = F.array(F.lit(1.0), *(F.col(c) for c in FEATURES))
    long = labelled.select("level", F.posexplode(f).alias("i", "x"), f.alias("f")).select("level", "i", "x", F.posexplode("f").alias("j", "y")).where("i <= j")
    sums = long.groupBy("level", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s")).toPandas()
    within, means, total = np.zeros((n, n)), {}, 0
    for level, part in sums.groupby("level"):
        m = np.zeros((n + 1, n + 1))
        m[part.i, part.j] = m[part.j, part.i] = part.s
        rows, s = m[0, 0], m[0, 1:]
        means[int(level)] = s / rows
        within += m[1:, 1:] - np.outer(s, s) / rows
        total += rows
    within /= max(1, total - len(means))
    within += shrink * np.diag(np.diag(within)) + 1e-6 * np.eye(n)
    inverse = np.linalg.inv(within)
    return {k: (inverse @ m, float(-0.5 * m @ inverse @ m)) for k, m in means.items()}


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "reading_level", min_words: int = 15, hot_words: int = 20_000, max_labels: int = 20_000, shrink: float = 0.02) -> DataFrame:
    """(key, reading_level) of every document with running prose of ``min_words`` words or more.

    labels: key and level, several per document; their rounded median counts, null levels and levels other than 1
    to 4 don't. At most ``max_labels`` labelled documents (the first by hash of the key) fit the discriminant and
    the vocabularies of the levels; all documents make up the corpus counts and get a level. Null, empty and blank
    texts, stubs, logs and bare tables have no row; without any label there are no rows. Keys are taken to be
    unique, null keys are passed over, further columns are ignored.
    """
    require_columns(documents, (key, text))
    require_columns(labels, (key, level))
    kind = dict(documents.dtypes)[key]
    texts = cut(texts_of(documents, key, text, min_words))
    judged = labels.where(F.col(f"`{level}`").isin(*LEVELS)).groupBy(F.col(f"`{key}`").cast(kind).alias("__key"))
    judged = judged.agg(F.floor(F.median(f"`{level}`") + 0.5).cast("int").alias("level"))
    judged = judged.join(texts.select("__key"), "__key").orderBy(F.xxhash64("__key"), "__key").limit(max_labels)
    judged = cut(judged.withColumn("half", F.pmod(F.xxhash64(F.lit(7), F.col("__key")), F.lit(2)).cast("int")))
    if judged.isEmpty():
        return texts.where(F.lit(False)).select(F.col("__key").alias(key), F.lit(0).alias("reading_level"))
    # A labelled document is covered twice: by the other half to fit, by all to be scored.
    folds = texts.join(F.broadcast(judged), "__key", "left").withColumn("fold", F.explode(F.when(F.col("half").isNull(), F.array(F.lit(2))).otherwise(F.array(F.lit(2), "half"))))
    covered = coverage_of(folds, cut(corpus_ranks(texts)), level_ranks(texts, judged), hot_words)
    logs = covered.select("__key", "fold", *(F.ln(F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)).cast("double")).alias(c) for c in COVERED))
    rows = cut(logs.join(texts.select("__key", *COMPLEXITY), "__key"))
    weights = _discriminant(rows.where("fold < 2").join(F.broadcast(judged), "__key"), shrink)
    scores = [F.struct(sum((F.col(f) * float(w) for f, w in zip(FEATURES, v, strict=True)), F.lit(c)).alias("score"), F.lit(k).alias("level")) for k, (v, c) in weights.items()]
    best = F.array_max(F.array(*scores))["level"]
    return rows.where("fold = 2").select(F.col("__key").alias(key), best.alias("reading_level"))


def coverage_ranks(documents: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.8, min_words: int = 15, hot_words: int = 20_000) -> DataFrame:
    """(key, n_words, coverage_rank): the corpus rank that covers ``share`` of each prose document's words.

    As in ``reading_levels``, the ``hot_words`` most frequent words are looked up in each task, and only documents
    that need rarer ones send those through a join.
    """
    require_columns(documents, (key, text))
    texts = cut(texts_of(documents, key, text, min_words))
    corpus = cut(corpus_ranks(texts))
    first, rare = _split_ranks(corpus, hot_words)
    hot = first.toPandas()
    sent = texts.sparkSession.sparkContext.broadcast((pa.array(hot["word"], pa.string()), np.append(hot["g"].to_numpy(np.int64), 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ranks = sent.value
        for batch in batches:
            lists, counts = batch.column("words"), batch.column("counts").flatten().to_numpy()
            rank = ranks[pc.index_in(lists.flatten().cast(pa.string()), value_set=words).fill_null(len(words)).to_numpy(zero_copy_only=False)]
            doc, known = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), rank > 0
            covered = weighted_coverage(doc[known], rank[known], counts[known], batch.column("n").to_numpy(), (share,))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("n"), pa.array(covered[0])], ["__key", "n", "r"])

    kind = dict(texts.dtypes)["__key"]
    covered = cut(texts.select("__key", "words", "counts", "n").mapInArrow(run, f"`__key` {kind}, n bigint, r bigint"))
    exact = _rare_coverage(texts.join(covered.where("r = 0").select("__key"), "__key", "left_semi"), corpus, rare, (share,))
    return covered.join(exact, "__key", "left").select(F.col("__key").alias(key), F.col("n").alias("n_words"), F.when(F.col("r") > 0, F.col("r")).otherwise(F.col("x.s0")).alias("coverage_rank"))
