"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. Streaming a document's
words through it gives, at each word, the longest run of words ending there that some
item contains. Runs of the window's length or more, and whole items shorter than a
window, are hits; spans of hits that are too long, or documents they cover too much
of, are removed.

Items are cut into blocks of a bounded number of words. Tasks build the automaton of
each block, lay it out in flat arrays and write it to the shared folder; tasks that
stream documents read the blocks from there, so that no item passes through the driver.
Before streaming, the words of a batch are looked up by hash in a block's vocabulary;
only stretches of known words long enough to hold a window go through its automaton.
"""

from __future__ import annotations

import io
import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlabel.llm import bytewords
from peerlabel.llm.common import shared_dir, text_or_empty
from peerlabel.llm.warc import store_of

WINDOW = 13
BLOCK_WORDS = 250_000
HELD_BYTES = 128 << 20
SPANS = "array<struct<start:long,end:long,words:long>>"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])


class SuffixAutomaton:
    """All runs of words of some items, while it is built. States are numbers; 0 is the
    empty run. ``ends`` lists (state, item) of every word of every item: the state is that
    of the item up to this word."""

    def __init__(self, items: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.ends: list[tuple[int, int]] = []
        self.last: list[int] = []  # the state of each whole item
        for number, words in enumerate(items):
            state = 0
            for word in words:
                state = self._add(state, word)
                self.ends.append((state, number))
            self.last.append(state)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _add(self, last: int, word: int) -> int:
        """The state of the run of ``last`` and ``word``, made where it is missing."""
        at = self.next[last].get(word)
        if at is not None:
            if self.length[at] == self.length[last] + 1:
                return at
            return self._clone(last, word, at)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            at = self.next[p][word]
            fits = self.length[at] == self.length[p] + 1
            self.link[state] = at if fits else self._clone(p, word, at)
        return state

    def _clone(self, p: int, word: int, at: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[at], dict(self.next[at]))
        self.link[at] = copy
        while p >= 0 and self.next[p].get(word) == at:
            self.next[p][word] = copy
            p = self.link[p]
        return copy


@dataclass
class Block:
    """The automaton of one block of items in flat arrays, its size proportional to the words.

    Moves of state s are ``move_word``/``move_to`` from ``move_first[s]`` on, by word.
    The items that contain a state's runs are ``occurs[begin[s]:stop[s]]``: ends of items,
    in the order of a walk through the tree of links. ``anchor[s]`` is the state of its last
    ``window`` words (0 if shorter); ``short[s]`` the nearest state, by links, in which items
    shorter than a window end. Those are ``short_size``/``short_item`` where ``short_state``
    is that state.
    """

    window: int
    shortest: int  # words of the shortest window
    names: list[str]
    vocabulary: np.ndarray  # sorted word hashes
    arrays: dict[str, np.ndarray]

    def __post_init__(self):
        for name, values in self.arrays.items():
            setattr(self, name, memoryview(values))  # items of these are plain ints

    @property
    def nbytes(self) -> int:
        return self.vocabulary.nbytes + sum(a.nbytes for a in self.arrays.values())

    def stream(self, words: list[int], anchors: set[int], shorts: set[int]) -> Iterator[tuple[int, int]]:
        """(position, words to cover) at each word that ends a hit. ``anchors`` and ``shorts``
        collect what ``items`` needs to name the items."""
        first, word_of, to = self.move_first, self.move_word, self.move_to
        length, link, anchor, short = self.length, self.link, self.anchor, self.short
        short_first, short_size = self.short_first, self.short_size
        state, matched, window = 0, 0, self.window
        for i, word in enumerate(words):
            while True:
                low, high = first[state], first[state + 1]
                if not state:
                    low += word  # every word of the vocabulary leaves state 0
                elif high - low > 1:
                    low = bisect_left(word_of, word, low, high)
                if low < high and word_of[low] == word:
                    state, matched = to[low], matched + 1
                    break
                state = link[state]
                matched = length[state]
            cover = 0
            if matched >= window:
                anchors.add(anchor[state])
                cover = window
            at = short[state]
            while at:
                for k in range(short_first[at], short_first[at + 1]):
                    if short_size[k] <= matched:
                        shorts.add(k)
                        cover = max(cover, short_size[k])
                at = short[link[at]]
            if cover:
                yield i, cover

    def items(self, anchors: set[int], shorts: set[int]) -> set[str]:
        found = [self.arrays["occurs"][self.begin[s] : self.stop[s]] for s in anchors]
        found.append(self.arrays["short_item"][list(shorts)])
        return {self.names[i] for i in np.unique(np.concatenate(found)).tolist()}

    def dump(self) -> bytes:
        names, out = json.dumps(self.names).encode(), io.BytesIO()
        np.savez(
            out, vocabulary=self.vocabulary, names=np.frombuffer(names, np.uint8),
            sizes=np.array([self.window, self.shortest]), **self.arrays,
        )
        return out.getvalue()

    @staticmethod
    def load(content: bytes) -> Block:
        with np.load(io.BytesIO(content)) as stored:
            arrays = {name: stored[name] for name in stored.files}
        names = json.loads(arrays.pop("names").tobytes())
        window, shortest = arrays.pop("sizes").tolist()
        return Block(window, shortest, names, arrays.pop("vocabulary"), arrays)


def build_block(names: list[str], runs: list[np.ndarray], window: int) -> Block:
    """The block of items, given as the hashes of their words (none without words)."""
    vocabulary = np.unique(np.concatenate(runs))
    coded = [np.searchsorted(vocabulary, run).tolist() for run in runs]
    made = SuffixAutomaton(coded)
    n = len(made.length)
    length, link = np.array(made.length, np.int32), np.array(made.link, np.int32)
    link[0] = 0
    up = np.argsort(length, kind="stable").tolist()  # from the empty run to the longest
    ends = np.array(made.ends, np.int32)
    own = np.bincount(ends[:, 0], minlength=n).tolist()
    total = list(own)
    for s in reversed(up[1:]):
        total[made.link[s]] += total[s]
    begin, free, anchor = [0] * n, [0] * n, [0] * n
    free[0] = own[0]
    for s in up[1:]:
        p = made.link[s]
        begin[s] = free[p]
        free[p] += total[s]
        free[s] = begin[s] + own[s]
        if made.length[s] >= window:
            anchor[s] = s if made.length[p] < window else anchor[p]
    begin = np.array(begin, np.int32)
    occurs = ends[np.argsort(begin[ends[:, 0]], kind="stable"), 1]
    arrays = {
        "length": length, "link": link, "anchor": np.array(anchor, np.int32),
        "begin": begin, "stop": begin + np.array(total, np.int32), "occurs": occurs,
    }
    moves = [sorted(m.items()) for m in made.next]
    flat = np.array([pair for some in moves for pair in some], np.int32).reshape(-1, 2)
    arrays["move_first"] = np.concatenate([[0], np.cumsum([len(m) for m in moves])]).astype(np.int32)
    arrays["move_word"], arrays["move_to"] = flat[:, 0].copy(), flat[:, 1].copy()
    small = sorted((made.last[i], len(run), i) for i, run in enumerate(coded) if len(run) < window)
    small = np.array(small, np.int32).reshape(-1, 3)
    per_state = np.bincount(small[:, 0], minlength=n)
    short = [0] * n
    for s in up[1:]:
        short[s] = s if per_state[s] else short[made.link[s]]
    arrays["short"] = np.array(short, np.int32)
    arrays["short_first"] = np.concatenate([[0], np.cumsum(per_state)]).astype(np.int32)
    arrays["short_size"], arrays["short_item"] = small[:, 1].copy(), small[:, 2].copy()
    return Block(window, min(min(map(len, coded)), window), names, vocabulary, arrays)


def _block_writer(folder: str, window: int, block_words: int):
    """Writes the blocks of a task's items: (path, words) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        names, runs, size = [], [], 0
        paths, words_in = [], []

        def close():
            path = f"{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{base}/{path}", compression=None) as out:
                out.write(build_block(names, runs, window).dump())
            paths.append(f"{folder}/{path}")
            words_in.append(size)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for words in bytewords.split(batch.column(1), bytewords.ALNUM, lower=True):
                for t in range(len(words)):
                    name = ids[words.row0 + t]
                    for piece in pieces(words.hash[words.first[t] : words.first[t + 1]], window, block_words):
                        if runs and size + len(piece) > block_words:
                            close()
                            names, runs, size = [], [], 0
                        names.append(name)
                        runs.append(piece.copy())
                        size += len(piece)
        if runs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(words_in, pa.int64())], ["path", "words"])

    return run


def pieces(run: np.ndarray, window: int, most: int) -> Iterator[np.ndarray]:
    """An item in pieces of ``most`` words (or a window); neighbours share all of a window
    but one word, so that each window lies in one piece."""
    most = max(most, window)
    for at in range(0, max(len(run) - window + 1, min(len(run), 1)), most - window + 1):
        yield run[at : at + most]


class _Blocks:
    """The blocks of some files, in order; those that fit in ``held_bytes`` stay in memory,
    the others are read again each time, one at once."""

    def __init__(self, paths: list[str], held_bytes: int):
        self.paths, self.left = paths, held_bytes
        self.held: dict[str, Block] = {}

    def __iter__(self) -> Iterator[Block]:
        for path in self.paths:
            block = self.held.get(path)
            if block is None:
                store, at = store_of(path)
                with store.open_input_stream(at, compression=None) as source:
                    block = Block.load(source.read())
                if block.nbytes <= self.left:
                    self.left -= block.nbytes
                    self.held[path] = block
            yield block


@dataclass(frozen=True)
class Decontaminator:
    """``window`` words make a hit. A document is contaminated when hits cover at least
    ``coverage`` (a share as numerator and denominator) of its words.

    Items are taken in blocks of ``block_words`` words at most (a longer item is cut into
    overlapping pieces). A task holds one block at a time, and up to ``held_bytes`` of blocks
    that it need not read again; documents meet all blocks in one pass without a shuffle.
    """

    window: int = WINDOW
    coverage: tuple[int, int] = (1, 20)
    max_span: int = WINDOW
    block_words: int = BLOCK_WORDS
    held_bytes: int = HELD_BYTES

    def blocks(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[str]:
        """Files of the blocks, in the shared folder. NULL texts and texts without words have
        none; rows without an id are items too, with an empty id; repeated rows count once."""
        named = items.select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
            text_or_empty(text_col).alias("text"),
        )
        # A task gets about a block of common words; it cuts wherever a block is full.
        size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // (4 * self.block_words)))
        folder = shared_dir(items.sparkSession, "benchmark-blocks")
        written = named.distinct().repartition(parts, "id", "text").mapInArrow(
            _block_writer(folder, self.window, self.block_words), "path string, words long"
        )
        return sorted(row["path"] for row in written.collect())

    def hits(
        self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        keep: tuple[str, ...] = (),
    ) -> DataFrame:
        """(id, text, n_words, n_hit, n_items, items, spans, contaminated) per row of ``docs``.

        ``items``: sorted ids of the items that occur; ``spans``: runs of hit words as
        (first byte, end byte, words), in order. A text that is NULL or has no words has
        none and is not contaminated. Repeated rows and NULL ids stay. ``keep`` names more
        columns of ``docs`` to pass on.
        """
        row = F.struct(F.col(id_col).alias("id"), *keep)
        narrowed = docs.select(row.alias("id"), F.col(text_col).alias("text"))
        schema = f"id {dict(narrowed.dtypes)['id']}, text string, n_words long, n_hit long, items array<string>, spans {SPANS}"
        found = narrowed.mapInArrow(_marker(self.blocks(items), self.held_bytes), schema)
        over, of = self.coverage
        return found.select(
            F.col("id.id").alias(id_col),
            *(F.col("id").getField(c).alias(c) for c in keep),
            F.col("text").alias(text_col),
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            "items",
            "spans",
            ((F.col("n_hit") > 0) & (F.col("n_hit") * of >= F.col("n_words") * over)).alias("contaminated"),
        )

    def remove_spans(self, hits: DataFrame, text_col: str = "text") -> DataFrame:
        """``hits`` with its text less the spans of more than ``max_span`` words and, in
        contaminated documents, less all spans."""
        limit = self.max_span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = {name: i for i, name in enumerate(names)}
            for batch in batches:
                columns = batch.columns
                rows = zip(
                    columns[at[text_col]].to_pylist(),
                    columns[at["spans"]].to_pylist(),
                    columns[at["contaminated"]].to_pylist(),
                    strict=True,
                )
                columns[at[text_col]] = pa.array(
                    [cut_spans(t, [s for s in spans if bad or s["words"] > limit]) for t, spans, bad in rows],
                    pa.string(),
                )
                yield pa.RecordBatch.from_arrays(columns, names)

        names = hits.columns
        return hits.mapInArrow(run, hits.schema)


def cut_spans(text: str | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return text
    raw, kept, at = text.encode(), [], 0
    for span in spans:
        kept.append(raw[at : span["start"]])
        at = span["end"]
    return b"".join([*kept, raw[at:]]).decode()


def _marker(paths: list[str], held_bytes: int):
    """Counts and spans of hits, and the ids of the items that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(paths, held_bytes)
        for batch in batches:
            ids, texts = batch.columns
            n_words = np.zeros(batch.num_rows, np.int64)
            n_hit = np.zeros(batch.num_rows, np.int64)
            items: list[list[str]] = [[]] * batch.num_rows
            spans: list[list[dict]] = [[]] * batch.num_rows
            for words in bytewords.split(texts, bytewords.ALNUM, lower=True, hashed=bool(paths)):
                n_words[words.row0 : words.row0 + len(words)] = np.diff(words.first)
                flags = np.zeros(len(words.start), np.uint8)
                names: dict[int, set[str]] = {}
                for block in blocks:
                    _mark(words, block, flags, names)
                for t, found in names.items():
                    hit = flags[words.first[t] : words.first[t + 1]]
                    n_hit[words.row0 + t] = int(hit.sum())
                    items[words.row0 + t] = sorted(found)
                    spans[words.row0 + t] = _runs(words, t, hit)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, texts, pa.array(n_words), pa.array(n_hit),
                    pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(SPAN)),
                ],
                ["id", "text", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _mark(words: bytewords.Words, block: Block, flags: np.ndarray, names: dict[int, set[str]]) -> None:
    """Sets ``flags`` of the words that ``block`` hits and adds the names of its items by text."""
    code = np.searchsorted(block.vocabulary, words.hash)
    code[code == len(block.vocabulary)] = 0
    known = block.vocabulary[code] == words.hash
    edge = np.zeros(len(known) + 1, bool)
    edge[words.first] = True  # no stretch crosses texts
    begins = np.flatnonzero(known & (edge[:-1] | ~np.append(False, known[:-1])))
    ends = np.flatnonzero(known & (edge[1:] | ~np.append(known[1:], False))) + 1
    long = ends - begins >= block.shortest
    found: dict[int, tuple[set[int], set[int]]] = {}
    for begin, end in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
        anchors, shorts = set(), set()
        for i, cover in block.stream(code[begin:end].tolist(), anchors, shorts):
            flags[begin + i + 1 - cover : begin + i + 1] = 1
        if anchors or shorts:
            t = int(np.searchsorted(words.first, begin, "right")) - 1
            have = found.setdefault(t, (set(), set()))
            have[0].update(anchors)
            have[1].update(shorts)
    for t, (anchors, shorts) in found.items():
        names.setdefault(t, set()).update(block.items(anchors, shorts))


def _runs(words: bytewords.Words, t: int, flags: np.ndarray) -> list[dict]:
    """The runs of hit words of text ``t``, with byte positions in that text."""
    on = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first, origin = words.first[t], int(words.bounds[t])
    return [
        {"start": int(words.start[first + a]) - origin, "end": int(words.end[first + b - 1]) - origin, "words": int(b - a)}
        for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True)
    ]
