"""Evaluation texts that leak into a corpus.

The corpus is indexed in segments: for each term of a segment the sorted
positions of its occurrences, in one row. A search reads the postings of the
terms of the evaluation items (and of terms that are misreadings of them),
intersects the offset-adjusted lists of the rarest terms, and keeps the
runs in which a document repeats an item word for word. A run may go on over
a short word with a misread letter, over two words run together and over a
word split in two, at the same or at a neighbouring offset.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.damage import NearWords, looks_damaged, repaired, run_together, skeleton
from docweave.session import small_rows, staged

#: Tokens of a segment, and those shared by neighbouring parts of a longer document.
SEGMENT_TOKENS, OVERLAP = 1_000_000, 128
#: Positions between two documents, so that no run crosses them.
_GAP = 8
#: Runs of an item's words that count as a leak. Word runs of a real leak are at least 12 long, chance ones at most 6.
LEAST_WORDS = 10
#: Anchors are the two rarest terms of each window of so many words: a passage of twelve words, one misread or two run together, holds such a window whole.
WINDOW = 5
#: Words that a run may pass over, each between pieces of two words or more.
MOST_BRIDGES = 2

_WORD = re.compile(r"[\w|\ufffd]+(?:\?[\w|\ufffd]+)*")
_TIMES = re.compile(r"(?:(?<=\n)|\A)(?:[^\n]{0,8}\n)?[^\n]{5,20}-{1,2}>[^\n]*")
_TAGS = re.compile(r"<[^<>\n]{0,40}>|\{\\[^{}\n]{0,40}\}")
_SOUNDS = re.compile(r"\[[^\[\]]{1,60}\]|\([^()]{1,60}\)|♪[^♪]{1,60}♪|\*[^*]{1,60}\*|(?<=\n)\? [^?\n]{1,60} \?(?=\r?\n)")
_LABEL = re.compile(r"(?:(?<=\n)|\A)(?:- ?)?[^\W\d_a-z][^\Wa-z:\n]*(?:[ .'-]+[^\Wa-z:\n]+){0,2}:(?= |\r?\n)")
_SCHEMA = "segment string, term string, n long, positions binary"


def words(text: str) -> list[str]:
    """The spoken words of a subtitle text, in order, as written."""
    if looks_damaged(text):
        text = repaired(text)
    if "->" in text:
        text = _TIMES.sub("\n", text)
    if "<" in text or "{" in text:
        text = _TAGS.sub("", text)
    text = _SOUNDS.sub(" ", text)
    text = _LABEL.sub("", text)
    return _WORD.findall(text)


def _packed(positions: np.ndarray) -> bytes:
    return zlib.compress(np.diff(positions, prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def _documents(ids: list[int], starts: list[int]) -> bytes:
    return zlib.compress(np.array([ids, starts], "<i8").tobytes(), 1)


class _Segment:
    """Tokens of some documents, until they are written as postings."""

    def __init__(self, name: str):
        self.name = name
        self.numbers: dict[str, int] = {}
        self.terms: dict[str, int] = {}
        self.ids: list[int] = []
        self.starts: list[int] = []
        self.chunks: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def _number(self, word: str) -> int:
        n = self.numbers[word] = self.terms.setdefault(skeleton(word), len(self.terms))
        return n

    def add(self, doc: int, tokens: list[str]) -> None:
        known = self.numbers
        self.ids.append(doc)
        self.starts.append(self.size)
        self.chunks.append(np.fromiter([known[w] if w in known else self._number(w) for w in tokens], np.int32, len(tokens)))
        self.places.append(np.arange(self.size, self.size + len(tokens), dtype=np.int64))
        self.size += len(tokens) + _GAP

    def rows(self) -> pd.DataFrame:
        terms, places = np.concatenate(self.chunks), np.concatenate(self.places)
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], places[order]
        cuts = np.flatnonzero(np.diff(terms)) + 1
        names = list(self.terms)
        lists = np.split(places, cuts) if len(places) else []
        firsts = terms[np.concatenate([[0], cuts])] if len(places) else []
        out = [(self.name, names[t], len(p), _packed(p)) for t, p in zip(firsts, lists)]
        out.append((self.name, None, self.size, _documents(self.ids, self.starts)))
        return pd.DataFrame(out, columns=["segment", "term", "n", "positions"])


def _index(segment_tokens: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, made = None, 0
        task = TaskContext.get()
        task = task.partitionId() if task else 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if text is None:
                    continue
                tokens = words(text)
                for at in range(0, max(len(tokens) - OVERLAP, 1), segment_tokens - OVERLAP):
                    part = tokens[at : at + segment_tokens]
                    if segment is None:
                        segment, made = _Segment(f"{task}-{made}"), made + 1
                    segment.add(int(doc), part)
                    if segment.size >= segment_tokens:
                        yield segment.rows()
                        segment = None
        if segment is not None:
            yield segment.rows()

    return run


class CorpusIndex:
    """A positional index of all words of all documents.

    ``postings`` has a row for each term of a segment: ``segment, term, n,
    positions`` (sorted, as packed differences); the row without a term
    lists the segment's documents and where they start. Null texts have no
    postings, empty ones none but a place in the list.
    """

    def __init__(self, docs: DataFrame | None, doc: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS, postings: DataFrame | None = None):
        if segment_tokens <= OVERLAP:
            raise ValueError(f"a segment takes more than {OVERLAP} tokens")
        if postings is None:
            picked = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND doc_id IS NOT NULL")
            postings = staged(picked.mapInPandas(_index(segment_tokens), _SCHEMA), "postings")
        self.postings = postings

    def save(self, path: str) -> None:
        """Keep the index at ``path``, for other searches and sessions."""
        self.postings.write.option("compression", "zstd").parquet(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CorpusIndex:
        """An index that was saved; the documents aren't needed."""
        return cls(None, postings=spark.read.schema(_SCHEMA).parquet(path))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Occurrences of ``terms`` in the whole corpus."""
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(t,) for t in terms], "term string")
        counts = self.postings.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
        return {r.term: r.n for r in counts.collect()}


class _Items:
    """The evaluation items as term numbers, with the anchors of their windows."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[str, int] = {}
        self.terms: list[np.ndarray] = []
        self.word_of: list[np.ndarray] = []
        for _, text in rows:
            numbers, word_of = [], []
            for n, chunk in enumerate(text.split()):
                for w in _WORD.findall(chunk):
                    numbers.append(self.vocabulary.setdefault(skeleton(w), len(self.vocabulary)))
                    word_of.append(n)
            self.terms.append(np.array(numbers, np.int64))
            self.word_of.append(np.array(word_of, np.int64))
        self.anchors: list[np.ndarray] = [np.arange(len(t)) for t in self.terms]

    def choose_anchors(self, frequency: dict[str, int], window: int = WINDOW, per_window: int = 2) -> None:
        """The rarest terms of each window of words, by position in the item.

        A run that holds a whole window meets all its anchors.
        """
        counts = np.array([frequency.get(w, 0) for w in self.vocabulary], np.int64)
        for at, terms in enumerate(self.terms):
            n = counts[terms] if len(terms) else np.zeros(0, np.int64)
            chosen: set[int] = set()
            for start in range(max(1, len(terms) - window + 1)):
                chosen.update((start + np.argsort(n[start : start + window], kind="stable")[:per_window]).tolist())
            self.anchors[at] = np.array(sorted(chosen), np.int64)

    def by_term(self) -> dict[int, list[tuple[int, int]]]:
        """The (item, position) of the anchors that each term is."""
        held: dict[int, list[tuple[int, int]]] = {}
        for item, anchors in enumerate(self.anchors):
            for j in anchors.tolist():
                held.setdefault(int(self.terms[item][j]), []).append((item, j))
        return held


class _Broken:
    """Terms that may be broken forms of item words: one letter of a short word misread, words run together or split."""

    def __init__(self, items: _Items):
        names = list(items.vocabulary)
        self.short = {k for w in names if len(w) <= 4 and not _DIGIT.search(w) for k in _wildcards(w)}
        self.joined = {run_together(names[a], names[b]) for terms in items.terms for a, b in zip(terms.tolist(), terms[1:].tolist())}
        self.pieces = {p for w in names if len(w) >= 3 for i in range(1, len(w)) for p in (w[:i], w[i:])}

    def __contains__(self, term: str) -> bool:
        return term in self.pieces or term in self.joined or len(term) <= 4 and any(k in self.short for k in _wildcards(term))


_DIGIT = re.compile(r"[0-9]")


def _wildcards(word: str) -> Iterator[str]:
    for i in range(len(word)):
        yield f"{word[:i]}*{word[i + 1:]}"
        yield f"{word[:i]}*{word[i:]}"
    yield f"{word}*"


def _relevant(items: _Items):
    """Keeps the postings of item terms, of terms near them, and of broken ones (without a match of their own)."""
    words_ = list(items.vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = {w: n for n, w in enumerate(words_)}
        near, broken = NearWords(words_), _Broken(items)
        memo: dict[str, list[int] | None] = {}
        for batch in batches:
            matches = []
            for term in batch["term"]:
                if term is None:
                    matches.append([])
                elif term in numbers:
                    matches.append([numbers[term]])
                else:
                    if term not in memo:
                        if len(memo) > 500_000:
                            memo.clear()
                        memo[term] = near.near(term) or ([] if term in broken else None)
                    matches.append(memo[term])
            yield batch.assign(matches=matches)[[m is not None for m in matches]]

    return run


def _runs(hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of each maximal run of True."""
    padded = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hit
    step = np.diff(padded, axis=1)
    rows, starts = np.nonzero(step == 1)
    _, ends = np.nonzero(step == -1)
    return zip(rows.tolist(), starts.tolist(), ends.tolist())


def _one_edit(a: str, b: str) -> bool:
    """Whether two words without figures are one letter apart."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2 or _DIGIT.search(a + b):
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


#: How a run may go on: words of the item passed over, and by how much the offset moves (one word misread, two run together, one split).
_BRIDGES = ((1, 0), (2, -1), (1, 1))


def _chain(pieces: list[tuple[int, int, int]], passable) -> list[tuple[int, int, int]]:
    """The pieces (start, end, offset) of the longest run with at most ``MOST_BRIDGES`` bridges."""
    pieces = sorted(pieces)
    by_start: dict[tuple[int, int], list[int]] = {}
    for n, (a, _, d) in enumerate(pieces):
        by_start.setdefault((a, d), []).append(n)
    best: tuple[int, list] = (0, [])
    held: dict[tuple[int, int], tuple[int, list]] = {}
    for n, (a, b, d) in enumerate(pieces):
        for bridges in range(MOST_BRIDGES + 1):
            own = held.get((n, bridges)) if bridges else None
            if bridges == 0:
                own = (b - a, [(a, b, d)])
            if own is None:
                continue
            best = max(best, own, key=lambda c: c[0])
            if bridges < MOST_BRIDGES:
                for gap, move in _BRIDGES:
                    for m in by_start.get((b + gap, d + move), ()):
                        if passable(b, gap, d, move):
                            c, e, f = pieces[m]
                            longer = (own[0] + gap + e - c, [*own[1], (c, e, f)])
                            held[m, bridges + 1] = max(held.get((m, bridges + 1), (0, [])), longer, key=lambda c: c[0])
    return best[1]


def _search(items: _Items, least_words: int):
    n_terms, by_term, names = len(items.vocabulary), items.by_term(), list(items.vocabulary)

    def run(segment: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "item_id", "n_words", "item_start"]
        head = segment[segment["term"].isna()].iloc[0]
        ids, starts = np.frombuffer(zlib.decompress(head["positions"]), "<i8").reshape(2, -1)
        size = int(head["n"])
        margin = max((len(t) for t in items.terms), default=0) + 2 * MOST_BRIDGES + 2
        at = np.full(size + 2 * margin, -1, np.int64)  # shifted by ``margin``
        written: list[str | None] = segment["term"].tolist()
        lists: dict[int, list[np.ndarray]] = {}
        allowed = []
        for n, (term, data, matches) in enumerate(zip(written, segment["positions"], segment["matches"])):
            if term is None:
                continue
            places = _unpacked(data)
            at[places + margin] = n
            for m in matches:
                lists.setdefault(int(m), []).append(places)
                allowed.append(n * n_terms + int(m))
        allowed = np.array(sorted(allowed), np.int64)
        shifted: dict[int, list[np.ndarray]] = {}
        for m, own in lists.items():  # from the terms that the segment has to the items
            for item, j in by_term.get(m, ()):
                shifted.setdefault(item, []).extend(p - j for p in own)

        def hits(item: int, diagonals: np.ndarray) -> np.ndarray:
            terms = items.terms[item]
            there = at[(diagonals[:, None] + np.arange(len(terms)) + margin).clip(0, len(at) - 1)]
            keys = there * n_terms + terms
            near = np.searchsorted(allowed, keys)
            return (there >= 0) & (allowed[np.minimum(near, len(allowed) - 1)] == keys)

        found: dict[tuple[int, int], tuple[int, int]] = {}
        for item, own in shifted.items():
            terms, word_of = items.terms[item], items.word_of[item]
            diagonals, meet = np.unique(np.concatenate(own), return_counts=True)
            if len(items.anchors[item]) > 1:  # the lists intersect
                diagonals = diagonals[meet > 1]

            def passable(b: int, gap: int, d: int, move: int) -> bool:
                numbers = [at[min(max(d + b + n + margin, 0), len(at) - 1)] for n in range(gap + move)]
                if min(numbers) < 0:
                    return False
                held, asked = [written[n] for n in numbers], [names[t] for t in terms[b : b + gap]]
                if len(held) == len(asked):
                    return _one_edit(held[0], asked[0])
                return run_together(*held) == asked[0] if len(held) > 1 else held[0] == run_together(*asked)

            def keep(pieces: list[tuple[int, int, int]]) -> None:
                a, _, d = pieces[0]
                count = int(word_of[pieces[-1][1] - 1] - word_of[a] + 1)
                if count >= least_words:
                    key = (int(ids[np.searchsorted(starts, d + a, side="right") - 1]), items.ids[item])
                    found[key] = max(found.get(key, (0, 0)), (count, a))

            for block in range(0, len(diagonals), 20_000):
                part = diagonals[block : block + 20_000]
                seeds = set()
                for row, a, b in _runs(hits(item, part)):
                    if word_of[b - 1] - word_of[a] + 1 >= least_words:
                        keep([(a, b, int(part[row]))])
                    elif b - a >= 3:
                        seeds.add(int(part[row]))
                for seed in seeds:
                    around = seed + np.arange(-MOST_BRIDGES, MOST_BRIDGES + 1)
                    pieces = [(a, b, int(around[row])) for row, a, b in _runs(hits(item, around)) if b - a >= 2]
                    if len(pieces) > 1:
                        keep(_chain(pieces, passable))
        return pd.DataFrame([(d, i, n, a) for (d, i), (n, a) in found.items()], columns=columns)

    return run


def _proximity(items: _Items, least_share: float, spread: float):
    """Windows of a document that hold most of an item's rarest terms, in any order."""

    def run(segment: pd.DataFrame) -> pd.DataFrame:
        head = segment[segment["term"].isna()].iloc[0]
        ids, starts = np.frombuffer(zlib.decompress(head["positions"]), "<i8").reshape(2, -1)
        lists: dict[int, list[np.ndarray]] = {}
        for term, data, matches in zip(segment["term"], segment["positions"], segment["matches"]):
            if term is not None:
                places = _unpacked(data)
                for m in matches:
                    lists.setdefault(int(m), []).append(places)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for item, terms in enumerate(items.terms):
            rare = sorted({int(terms[j]) for j in items.anchors[item].tolist()})
            needed = max(2, int(np.ceil(least_share * len(rare))))
            held = [(p, np.full(len(p), n)) for n, t in enumerate(rare) for p in lists.get(t, ())]
            if len({int(n[0]) for _, n in held if len(n)}) < needed:
                continue
            places, labels = np.concatenate([p for p, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(places, kind="stable")
            places, labels = places[order], labels[order]
            doc_of = np.searchsorted(starts, places, side="right") - 1
            width = int(spread * len(terms))
            # ends of the windows that start at each place, within its document
            ends = np.minimum(np.searchsorted(places, places + width, side="right"), np.searchsorted(doc_of, doc_of, side="right"))
            for a in np.flatnonzero(ends - np.arange(len(places)) >= needed).tolist():
                n = len(set(labels[a : ends[a]].tolist()))
                if n >= needed:
                    key = (int(ids[doc_of[a]]), items.ids[item])
                    found[key] = max(found.get(key, (0, 0)), (n, len(rare)))
        return pd.DataFrame([(d, i, n, m) for (d, i), (n, m) in found.items()], columns=["doc_id", "item_id", "n_terms", "of_terms"])

    return run


def _prepared(index: CorpusIndex, rows: list, window: int, per_window: int) -> _Items:
    held = _Items([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id, r.text))])
    held.choose_anchors(index.frequencies(list(held.vocabulary)), window, per_window)
    return held


def _in_blocks(items: DataFrame, item: str, text: str, block_items: int) -> Iterator[list]:
    """The stated query set in blocks that fit every task."""
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // block_items))
    for n in range(blocks):
        rows = small_rows(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n), 2 * block_items + 1000, "a block of items")
        if rows:
            yield rows


def _searched(index: CorpusIndex, items: DataFrame, item: str, text: str, block_items: int, window: int, per_window: int, search, ddl: str) -> DataFrame:
    """The pairs that ``search`` finds in the segments, of all blocks of items."""
    found = None
    for rows in _in_blocks(items, item, text, block_items):
        held = _prepared(index, rows, window, per_window)
        relevant = index.postings.mapInPandas(_relevant(held), _SCHEMA + ", matches array<int>")
        pairs = relevant.groupBy("segment").applyInPandas(search(held), ddl)
        found = pairs if found is None else found.unionAll(pairs)
    return index.postings.sparkSession.createDataFrame([], ddl) if found is None else found


def near_items(index: CorpusIndex, items: DataFrame, item: str = "item_id", text: str = "text", least_share: float = 0.8, spread: float = 1.5, block_items: int = 50_000) -> DataFrame:
    """``doc_id, item_id, n_terms, of_terms``: documents that reword or reorder an item.

    A window ``spread`` times as long as the item holds at least
    ``least_share`` of the item's rarest terms (one for each window of its
    words), in any order.
    """
    pairs = _searched(index, items, item, text, block_items, LEAST_WORDS, 1, lambda held: _proximity(held, least_share, spread), "doc_id long, item_id long, n_terms int, of_terms int")
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_terms").alias("n_terms"), F.max("of_terms").alias("of_terms"))


def search_items(index: CorpusIndex, items: DataFrame, item: str = "item_id", text: str = "text", least_words: int = LEAST_WORDS, block_items: int = 50_000) -> DataFrame:
    """``doc_id, item_id, n_words, item_start``: the longest run of each pair.

    The items are the stated query set; they go to every task, in blocks of
    about ``block_items`` if there are more. Items without words match
    nothing.
    """
    pairs = _searched(index, items, item, text, block_items, WINDOW, 2, lambda held: _search(held, least_words), "doc_id long, item_id long, n_words int, item_start int")
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"), F.max_by("item_start", "n_words").alias("item_start"))


def leaked_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id``: the documents that hold a passage of an item.

    Words are compared without case, punctuation, accents and line breaks,
    and up to the misreadings of scanners and wrong encodings; up to two
    times a short word may be misread, or words run together or split; cue numbers,
    time lines, tags, speaker labels and sound descriptions are passed over.
    Null and empty texts hold nothing; documents longer than a segment are
    indexed in overlapping parts; a repeated ``doc_id`` is reported once.
    Further columns are ignored; empty tables give an empty result.
    """
    return search_items(CorpusIndex(docs, doc, text), items, item, item_text).select("doc_id", "item_id")
