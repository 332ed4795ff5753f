"""Evaluation texts leaking into training text, by winnowing.

Texts become word sequences. Of every ``window`` successive k-gram hashes the smallest is kept, which guarantees a
common fingerprint for every shared span of k + window - 1 words: the whole span that counts as a leak. Training
and test fingerprints are joined, and hits are extended word by word in both directions.

Reworked items (a stretch at most a third longer than the item that keeps four fifths of its words in order) may
share no long span. The same fingerprints with k = 2 and a window of one keep every pair of words, and such a
stretch must share a number of them that follows from its length (none for a few short lengths, where this filter
is passed over); what has so many in one stretch, and enough of the item's words there, is put to an exact
longest-common-subsequence check.

Items of at most ``item_bytes`` in all are sent to all tasks, and the join is a lookup there: the corpus is read
once and never shuffled. Beyond that size fingerprints are joined by a shuffle: the corpus is broken into words
once, for any number of items, and written as winnowed prints and distinct words. A text is a candidate for an item
if they share a print, or one of the item's rarest words (of which a reworked text must have one: it lacks at most
n - ceil(4n/5) words). Candidates and texts meet sorted by text and stream through the same exact search. Words
of more than ``hot_rows`` texts are salted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.llm.bits import ranges
from cepage.llm.words import HYPHEN_AT_END, broken_words, words
from cepage.session import cut, parallelism, spread

_PRIME = 0x9E3779B185EBCA87


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive words."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_PRIME) + word_hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each ``window`` successive ones, the last of equal ones."""
    return winnow_all(hashes, np.array([len(hashes)]), window)


def winnow_all(hashes: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """``winnow`` of texts one after the other, of so many hashes each; a text shorter than a window is one window."""
    ends = np.cumsum(lengths)
    kept = np.zeros(len(hashes), bool)
    m = len(hashes) - window + 1
    if m > 0:
        least, at = hashes[:m].copy(), np.zeros(m, np.int64)
        for j in range(1, window):
            later = hashes[j : j + m]
            better = later <= least
            least[better] = later[better]
            at[better] = j
        whole = np.zeros(len(hashes) + 1, np.int64)  # windows that lie in one text
        long = lengths >= window
        np.add.at(whole, (ends - lengths)[long], 1)
        np.add.at(whole, (ends - window + 1)[long], -1)
        inside = np.flatnonzero(np.cumsum(whole)[:m] > 0)
        kept[inside + at[inside]] = True
    for k in np.flatnonzero((lengths > 0) & (lengths < window)):
        part = hashes[ends[k] - lengths[k] : ends[k]]
        kept[ends[k] - 1 - int(np.argmin(part[::-1]))] = True
    return np.flatnonzero(kept)


def common_subsequence(masks: dict[int, int], length: int, ids: list[int]) -> int:
    """Length of the longest common subsequence; masks: where in the item (bit set) each word stands."""
    full = (1 << length) - 1
    v = full
    for w in ids:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def needed_words(n: np.ndarray, keep: float) -> np.ndarray:
    """How many of n words a reworked text must keep."""
    return np.ceil(keep * n - 1e-9).astype(np.int64)


class Items:
    """A block of evaluation items with their words, fingerprints and word pairs, ready for lookups."""

    def __init__(self, rows: list[tuple], span: int = 12, k: int = 5, keep: float = 0.8, longer: float = 1 / 3, known: frozenset | None = None) -> None:
        if known is None:
            # A word broken at a line's end is joined if any item has the joined word.
            known = frozenset(w for _, t in rows for w in words(t))
        self.known = known
        texts = [words(t, known) for _, t in rows]
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({w for t in texts for w in t}))}
        self.keys = [key for key, _ in rows]
        self.ids = [np.array([self.vocabulary.get(w, 0) for w in t], np.int64) for t in texts]
        self.span, self.k, self.window = span, k, span - k + 1
        self.hashes: dict[str, int] = {}
        n = np.array([len(t) for t in texts])
        self.length = n
        self.least = needed_words(n, keep)
        self.stretch = np.floor((1 + longer) * n + 1e-9).astype(np.int64)
        # Of the neighbours among the kept words, each left-out word and each filler parts one at most.
        self.pairs_needed = (self.least - 1) - (n - self.least) - (self.stretch - self.least)
        self.masks = []
        for ids in self.ids:
            where: dict[int, int] = {}
            for p, w in enumerate(ids.tolist()):
                where[w] = where.get(w, 0) | 1 << p
            self.masks.append(where)
        filled = np.flatnonzero(n > 0)
        self.filled, self.all_words = filled, np.concatenate([self.ids[r] for r in filled]) if len(filled) else np.empty(0, np.int64)
        self.starts = np.cumsum(n[filled]) - n[filled]
        self.counts = [Counter(ids.tolist()) for ids in self.ids]
        self.table: np.ndarray | None = None
        prints = []
        for r, t in enumerate(texts):
            g = gram_hashes(self.hashed(t), k)
            at = np.arange(len(g))  # every position, so that the winnowed ones of a corpus text find their like
            prints.append(np.column_stack([g[at], np.full(len(at), r, np.uint64), at.astype(np.uint64)]))
        self.prints = self._sorted(prints)
        v = len(self.vocabulary) + 1
        pairs = []
        for r, ids in enumerate(self.ids):
            code = np.unique(ids[:-1] * v + ids[1:])
            pairs.append(np.column_stack([code, np.full(len(code), r), np.zeros(len(code), np.int64)]).astype(np.uint64))
        self.pairs = self._sorted(pairs)

    @staticmethod
    def _sorted(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.vstack(parts) if parts else np.empty((0, 3), np.uint64)
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def hashed(self, found: list[str]) -> np.ndarray:
        known = self.hashes
        if len(known) > 500_000:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    @staticmethod
    def _hits(rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into wanted, index into rows) of equal keys."""
        left, right = np.searchsorted(rows[:, 0], wanted, "left"), np.searchsorted(rows[:, 0], wanted, "right")
        found = [*ranges(left, right, 1 << 22)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def leaks(self, text: str | None) -> list[int]:
        """Numbers of the items of which the text holds a passage."""
        return sorted(r for _, r in self.leaks_of([text]))

    def leaks_of(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(number of the text, number of the item) of texts that hold a passage of an item."""
        found = [words(t, self.known) for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        if not n.sum():
            return []
        # Each distinct word is looked up and hashed once.
        coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in distinct), np.int64, len(distinct))[codes]
        starts = np.cumsum(n) - n
        leaking = self._spans(ids, self.hashed(distinct)[codes], starts, n)
        known: dict[int, set[int]] = {}
        for d, r in leaking:
            known.setdefault(d, set()).add(r)
        for d, enough in self._enough(ids, n):
            enough[list(known.get(d, ()))] = False
            leaking |= {(d, r) for r in self._reworked(ids[starts[d] : starts[d] + n[d]], enough)}
        return sorted(leaking)

    def _spans(self, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) with a shared span, of texts one after the other."""
        long = np.flatnonzero(n >= self.span)
        if not len(long):
            return set()
        lengths = n[long] - self.k + 1
        grams = gram_hashes(hashes, self.k)
        place = np.repeat(starts[long] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        kept = place[winnow_all(grams[place], lengths, self.window)]
        hit, row = self._hits(self.prints, grams[kept])
        at = kept[hit]
        text = np.searchsorted(starts, at, "right") - 1
        out: set[tuple[int, int]] = set()
        for d, p, r, q in zip(text.tolist(), at.tolist(), self.prints[row, 1].tolist(), self.prints[row, 2].tolist(), strict=True):
            if (d, r) in out:
                continue
            item, first, last = self.ids[r], int(starts[d]), int(starts[d] + n[d])
            lo = 0
            while p - lo > first and q - lo > 0 and ids[p - lo - 1] == item[q - lo - 1]:
                lo += 1
            hi = 0
            while p + hi < last and q + hi < len(item) and ids[p + hi] == item[q + hi]:
                hi += 1
            if lo + hi >= self.span:
                out.add((d, int(r)))
        return out

    def _enough(self, ids: np.ndarray, n: np.ndarray, dense: int = 1 << 24) -> Iterator[tuple[int, np.ndarray]]:
        """(text, mask of the items) of texts that have as many of an item's words at all as they must keep."""
        if not len(self.filled):
            return
        width = len(self.vocabulary) + 1
        text = np.repeat(np.arange(len(n)), n)
        # Counts per word and item as a table if it is small, else texts one by one.
        table = None
        if width * len(self.keys) <= dense:
            if self.table is None:
                self.table = np.zeros((width, len(self.keys)), np.float32)
                np.add.at(self.table, (self.all_words, np.repeat(self.filled, self.length[self.filled])), 1)
            table = self.table
        step = max(1, dense // width) if table is not None else 1
        for at in range(0, len(n), step):
            lo, hi = np.searchsorted(text, at, "left"), np.searchsorted(text, at + step, "left")
            present = np.zeros((min(step, len(n) - at), width), np.float32)
            present[text[lo:hi] - at, ids[lo:hi]] = 1
            present[:, 0] = 0
            if table is not None:
                enough = present @ table >= self.least
            else:
                enough = np.zeros((1, len(self.keys)), bool)
                enough[0, self.filled] = np.add.reduceat(present[0][self.all_words], self.starts) >= self.least[self.filled]
            enough[:, self.length == 0] = False
            for d in np.flatnonzero(enough.any(axis=1)):
                yield at + int(d), enough[d]

    def _reworked(self, ids: np.ndarray, enough: np.ndarray) -> set[int]:
        """Of the items that have ``enough`` words in a text, those that it keeps in order in some stretch."""
        if not enough.any():
            return set()
        loose = np.flatnonzero(enough & (self.pairs_needed <= 0))
        out = {int(r) for r in loose if self._stretches(int(r), ids)}
        enough[loose] = False
        code = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if not len(both) or not enough.any():
            return out
        hit, row = self._hits(self.pairs, code[both].astype(np.uint64))
        item, place = self.pairs[row, 1].astype(np.int64), both[hit]
        item, place = item[enough[item]], place[enough[item]]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        if not len(item):
            return out
        starts = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(item)], strict=True):
            r = int(item[a])
            need, p = int(self.pairs_needed[r]), place[a:b]
            if b - a >= need and (p[need - 1 :] - p[: b - a - need + 1] < int(self.stretch[r])).any() and self._stretches(r, ids):
                out.add(r)
        return out

    def _stretches(self, r: int, ids: np.ndarray) -> bool:
        """Whether a stretch that begins with a word of the item and has enough of its words passes the exact check."""
        stretch, least = int(self.stretch[r]), int(self.least[r])
        if len(ids) < least:
            return False
        member = np.isin(ids, self.ids[r])
        upto = np.concatenate([[0], np.cumsum(member)])
        begin = np.flatnonzero(member)
        inside = upto[np.minimum(begin + stretch, len(ids))] - upto[begin]
        begin = begin[inside >= least]
        return bool(len(begin)) and self._check(r, ids, begin.tolist(), stretch, least)

    def _check(self, r: int, ids: np.ndarray, begin: list[int], stretch: int, least: int) -> bool:
        seq, limit, masks, n = ids.tolist(), self.counts[r], self.masks[r], int(self.length[r])
        for b in begin:
            part = [w for w in seq[b : b + stretch] if w in limit]
            have = Counter(part)
            if sum(min(c, limit[w]) for w, c in have.items()) >= least and common_subsequence(masks, n, part) >= least:
                return True
        return False


def _lookup_leaks(corpus: DataFrame, rows: list[tuple], names: tuple[str, str], schema: str, item_type: pa.DataType, options: dict, together: int = 4 << 20) -> DataFrame:
    """Leaks by a lookup of the items' prints in every task."""
    sent = corpus.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(sent.value, **options)
        for batch in batches:
            # Texts are searched together up to some millions of bytes; a longer one is by itself.
            upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (int(upto[at - 1]) if at else 0) + together, "right")))
                found = index.leaks_of(batch.column(1).slice(at, to - at).to_pylist())
                if found:
                    doc, item = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([at + d for d in doc])), pa.array([index.keys[r] for r in item], item_type)], list(names))
                at = to

    return corpus.mapInArrow(run, schema)


def _known_words(corpus: DataFrame, rows: DataFrame, most_bytes: int) -> frozenset:
    """Words of items that stand broken at a line's end somewhere; they are words of a language, so few."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in words(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

    def of_breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in broken_words(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["w"])

    text = corpus.columns[-1]
    have = rows.select(rows.columns[-1]).mapInArrow(of_texts, "w string").distinct()
    # Only texts with some hyphen before some line's end can have any.
    hyphen = F.col(f"`{text}`").rlike(HYPHEN_AT_END)
    broken = corpus.where(hyphen).select(text).union(rows.select(rows.columns[-1])).mapInArrow(of_breaks, "w string").distinct()
    known = cut(broken.join(have, "w", "left_semi"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"items have {size} bytes of words that stand broken at line ends; {most_bytes} may be sent to all tasks")
    return frozenset(r[0] for r in known.collect())


def _joined_leaks(corpus: DataFrame, rows: DataFrame, names: tuple[str, str], schema: str, item_type: pa.DataType, options: dict, known_bytes: int, hot_rows: int, block: int = 256) -> DataFrame:
    """Leaks by a shuffle: texts and items that share a print or a rare word, then the exact search of each text's candidates."""
    span, k, keep = options.get("span", 12), options.get("k", 5), options.get("keep", 0.8)
    doc, item, text = corpus.columns[0], rows.columns[0], rows.columns[1]
    known = _known_words(corpus, rows, known_bytes)
    sent = corpus.sparkSession.sparkContext.broadcast(known)

    def hashed(found: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))

    def prints_of(winnowed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints, tokens = [], []
                for t in batch.column(batch.num_columns - 1).to_pylist():
                    h = hashed(words(t, sent.value))
                    grams = gram_hashes(h, k) if len(h) >= span else h[:0]
                    prints.append(np.unique(grams[winnow(grams, span - k + 1)] if winnowed else grams).view(np.int64))
                    tokens.append((np.unique(h) if winnowed else np.sort(h)).view(np.int64))
                kept = [batch.column(n) for n in range(batch.num_columns - 1)]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (prints, tokens)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], [*batch.schema.names[:-1], "prints", "tokens"])

        return run

    kinds = dict(corpus.dtypes) | dict(rows.dtypes)
    texts = corpus.withColumn("__t", F.xxhash64(text)).select(doc, "__t", text).distinct()
    broken = cut(texts.mapInArrow(prints_of(True), f"`{doc}` {kinds[doc]}, `__t` bigint, prints array<bigint>, tokens array<bigint>"))
    asked = cut(rows.mapInArrow(prints_of(False), f"`{item}` {kinds[item]}, prints array<bigint>, tokens array<bigint>"))

    # How many texts have a word or print of an item, and the rarest words of each item.
    offered = broken.select(doc, "__t", F.explode(F.array_union("tokens", "prints")).alias("w"))
    wanted = asked.select(F.explode(F.array_union("tokens", "prints")).alias("w")).distinct()
    often = cut(offered.groupBy("w").agg(F.count("*").alias("df")).join(wanted, "w", "left_semi"))
    each = asked.select(item, F.size("tokens").alias("n"), F.explode("tokens").alias("w")).join(often, "w", "left")
    lacking = F.floor(F.col("n") * (1 - keep) + 1e-9)
    rarest = each.withColumn("place", F.row_number().over(Window.partitionBy(item).orderBy(F.coalesce("df", F.lit(0)), "w"))).where((F.col("place") <= lacking + 1) & F.col("df").isNotNull())
    needles = rarest.select(item, "w").union(asked.select(item, F.explode("prints").alias("w"))).distinct()
    # What many texts have is salted; such words are at most one per ``hot_rows`` words of the corpus.
    hot = F.broadcast(often.where(F.col("df") > hot_rows).select("w", F.ceil(F.col("df") / hot_rows).cast("int").alias("ways")))
    needles = needles.join(hot, "w", "left").select(item, "w", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("salt"))
    offered = offered.join(hot, "w", "left").select(doc, "__t", "w", F.pmod(F.xxhash64("__t"), F.coalesce("ways", F.lit(1))).cast("int").alias("salt"))
    candidates = cut(offered.join(needles, ["w", "salt"]).select(doc, "__t", item).distinct())

    # Texts come before their candidates and are read as they stream by.
    have = texts.join(candidates.select(doc, "__t").distinct(), [doc, "__t"], "left_semi").select(doc, "__t", F.lit(None).cast(kinds[item]).alias(item), F.col(f"`{text}`").alias("__text"))
    put = candidates.join(rows.select(item, F.col(f"`{text}`").alias("__text")), item).select(doc, "__t", item, "__text")
    met = have.union(put).repartition(parallelism(corpus.sparkSession), doc, "__t").sortWithinPartitions(doc, "__t", F.col(item).isNotNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def leaks() -> list:
            index = Items(held, known=sent.value, **options)
            return [index.keys[r] for r in index.leaks(current[1])]

        for batch in batches:
            found: list[tuple] = []
            for key, _, name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name is None or len(held) == block:
                    if held:
                        found += [(current[0], x) for x in leaks()]
                    held = []
                if name is None:
                    current = (key, t)
                else:
                    held.append((name, t))
            if batch.num_rows and held:
                found += [(current[0], x) for x in leaks()]
                held = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], batch.schema.field(0).type), pa.array([b for _, b in found], item_type)], list(names))

    return met.mapInArrow(search, schema)


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_bytes: int = 8 << 20, known_bytes: int = 256 << 20, hot_rows: int = 1_000_000, **options) -> DataFrame:
    """Distinct (doc_key, item_key) of documents that hold a passage of an item.

    Null, empty and wordless texts leak nothing and are leaked by nothing; rows with a null key are passed over;
    repeated rows count once; whole texts are read; further columns are ignored. Items of up to ``item_bytes`` in all
    are looked up in every task; more are joined by a shuffle. Both ways find the same.
    """
    require_columns(documents, (doc_key, text))
    require_columns(items, (item_key, text))
    corpus = documents.where(F.col(f"`{doc_key}`").isNotNull() & (F.length(F.col(f"`{text}`")) > 0)).select(F.col(f"`{doc_key}`").alias("__doc"), F.col(f"`{text}`").alias("__text"))
    corpus = spread(corpus)
    rows = items.where(F.col(f"`{item_key}`").isNotNull() & (F.length(F.col(f"`{text}`")) > 0)).select(F.col(f"`{item_key}`").alias("__item"), F.col(f"`{text}`").alias("__text")).distinct()
    rows = cut(rows)
    schema = f"`{doc_key}` {dict(corpus.dtypes)['__doc']}, `{item_key}` {dict(rows.dtypes)['__item']}"
    item_type = rows.select("__item").limit(0).toArrow().schema.field(0).type
    size = rows.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    if size <= item_bytes:
        found = _lookup_leaks(corpus, [tuple(r) for r in rows.collect()], (doc_key, item_key), schema, item_type, options)
    else:
        found = _joined_leaks(corpus, rows, (doc_key, item_key), schema, item_type, options, known_bytes, hot_rows)
    return found.distinct()
