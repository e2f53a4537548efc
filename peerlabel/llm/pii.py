"""Personal data: fixed rules, and a conditional random field that finds more.

The rules find e-mail and IP addresses, card and phone numbers. Texts of a bounded sample
train a linear-chain CRF over the shapes of words: about half of what the rules find in them
is first rewritten into a form that no rule reads (``rewritten``: other separators, a spelt
@ or dot, a lost plus, a wrong check digit in groups of four), and labelled all the same.
Decoded by Viterbi over whole texts the field adds spans of such forms.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerlabel.llm import bytewords, crf
from peerlabel.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k goes on
WINDOW = 4
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())])
SPANS = "array<struct<kind:string,start:long,end:long,rule:boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address is the run of local characters before an @ and the host after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        if host:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, host.end()
                end = host.end()
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed rules, by kind, then start, in code points."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# -- forms that the rules do not read ------------------------------------------

# Fixed forms, as people write them: an e-mail address by its local part and host, an IP
# address by the text between its parts, a card number by that between groups of four
# digits, a phone number by what stands for its plus and between its groups.
EMAIL_FORMS = (
    "{0} [at] {1}", "{0}[at]{1}", "{0} (at) {1}", "{0}(at){1}", "{0} @ {1}", "{0} @{1}",
    "{0} [at] {2} [dot] {3}", "{0}[at]{2}[dot]{3}", "{0} (at) {2} (dot) {3}", "{0} [AT] {2} dot {3}",
)
IP_FORMS = ("[.]", "(.)", "[dot]", "(dot)", ". ")
CARD_FORMS = (".", "/", "_", "  ", " - ")
PHONE_FORMS = (("+", "/"), ("+ ", " "), ("00", " "), ("00 ", "-"), ("+", " / "))
# Numbers and signs that are nobody's data; # stands for a digit.
ORDINARY = (
    "##/##/####", "####-##-## ##:##:##", "#.#.#", "###,###,###", "$###.##", "ISBN 978-#-##-######-#",
    "pp. ###-###", "### ### ###", "No. ##########", "at ##:##", "[###]", "(####)", "################",
    "@name", "#### - ####", "#-#", "##.## %", "(#.#)", "00:##:##", "a [at#] b", "# / ##",
)


def rewritten(kind: int, found: str, rng: random.Random) -> str | None:
    """``found``, which a rule reads as ``kind``, in a form that none does; None if it has no such form."""
    if kind == 0:
        local, host = found.split("@")
        name, end = host.rsplit(".", 1)
        return rng.choice(EMAIL_FORMS).format(local, host, name, end)
    if kind == 1:
        return rng.choice(IP_FORMS).join(found.split("."))
    digits = re.sub("[^0-9]", "", found)
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, 16, 4)]
        groups[3] += digits[16:]
        if rng.random() < 0.4:  # a wrong digit
            at = rng.randrange(4)
            groups[at] = groups[at][:-1] + str((int(groups[at][-1]) + rng.randint(1, 4)) % 10)
            joint = rng.choice(" -")
            return None if luhn("".join(groups)) else joint.join(groups)
        return rng.choice(CARD_FORMS).join(groups)
    groups = re.findall("[0-9]+", found)
    if len(groups) < 3:
        groups = [digits[:-7] or "1", digits[-7:-4], digits[-4:]]
    plus, joint = rng.choice(PHONE_FORMS)
    return plus + joint.join(groups)


def ordinary(rng: random.Random) -> str:
    while True:
        made = re.sub("#", lambda _: str(rng.randrange(10)), rng.choice(ORDINARY))
        if not rule_spans(made):
            return made


def with_rewritten(
    text: str, spans: list[tuple[int, int, int]], rng: random.Random, share: float = 0.5
) -> tuple[str, list[tuple[int, int, int]]]:
    """``text`` with ``share`` of its ``spans`` rewritten, and where all of them are then.

    Spans that overlap another stay as they are, or go if they begin inside another."""
    out, moved, at = [], [], 0
    length = 0
    ordered = sorted(spans, key=lambda s: (s[1], -s[2]))
    for i, (kind, start, end) in enumerate(ordered):
        if start < at:
            continue
        alone = i + 1 == len(ordered) or ordered[i + 1][1] >= end
        form = rewritten(kind, text[start:end], rng) if alone and rng.random() < share else None
        form = form or text[start:end]
        out += [text[at:start], form]
        length += start - at
        moved.append((kind, length, length + len(form)))
        length, at = length + len(form), end
    return "".join([*out, text[at:]]), sorted(moved)


# -- word shapes --------------------------------------------------------------

GROUPS = (8, 2, 5, 2, 7, 5, 2, 2, 5, 9, 9, 3, 4)
_B = np.arange(256)
DIGIT = (_B >= 48) & (_B <= 57)
LETTER = (_B >= 65) & (_B <= 90) | (_B >= 97) & (_B <= 122) | (_B >= 128)
FIRST = np.select([DIGIT, _B == ord("+"), _B == ord("("), LETTER, _B == ord('"')], [0, 1, 2, 3, 4], 5)
DIGIT_STEPS = np.array([1, 3, 4, 7, 12, 16, 20])
LENGTH_STEPS = np.array([3, 6, 12, 20])


def spelt(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes that open a bracketed "at", and a bracketed "dot" or dot."""
    at, dot = np.zeros(len(data), bool), np.zeros(len(data), bool)
    opens = np.flatnonzero((data == ord("[")) | (data == ord("(")))
    if not len(opens):
        return at, dot
    after = np.append(data, np.zeros(5, np.uint8))
    low = [after[opens + k] | (32 if k < 4 else 0) for k in range(5)]
    shut = [(after[opens + k] == ord("]")) | (after[opens + k] == ord(")")) for k in range(5)]
    at[opens] = (low[1] == ord("a")) & (low[2] == ord("t")) & shut[3]
    dot[opens] = (after[opens + 1] == ord(".")) & shut[2]
    dot[opens] |= (low[1] == ord("d")) & (low[2] == ord("o")) & (low[3] == ord("t")) & shut[4]
    return at, dot


def shapes(words: bytewords.Words) -> np.ndarray:
    """Features (words, groups): of each word's own bytes, its neighbours' classes,
    whether many digits pass the check that card numbers pass, and spelt @ and dots."""
    data, start, end = words.data, words.start, words.end

    def number(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[end] - sums[start]

    out = np.zeros((len(start), len(GROUPS)), np.int64)
    if not len(start):
        return out
    digits, letters = number(DIGIT[data]), number(LETTER[data])
    spelt_at, spelt_dot = (number(flags) for flags in spelt(data))
    at, dots = number(data == ord("@")), number(data == ord("."))
    dashes, closing = number(data == ord("-")), number(data == ord(")"))
    out[:, 0] = np.searchsorted(DIGIT_STEPS, digits, "right")
    out[:, 1] = at + spelt_at > 0
    out[:, 2] = np.minimum(dots, 4)
    out[:, 3] = letters > 0
    length = end - start
    second = data[np.minimum(start + 1, end - 1)]
    zeros = (length > 1) & (data[start] == ord("0")) & (second == ord("0"))
    out[:, 4] = np.where(zeros, 6, FIRST[data[start]])
    out[:, 5] = np.minimum(dashes, 4)
    out[:, 6] = closing > 0
    known = digits + letters + at + dots + dashes + closing
    out[:, 7] = length - known > (FIRST[data[start]] == 1) + (FIRST[data[start]] == 2)
    out[:, 8] = np.searchsorted(LENGTH_STEPS, length, "right")
    low = data | 32
    bare = (length == 3) & (low[start] == ord("d")) & (low[end - 2] == ord("o")) & (low[end - 1] == ord("t"))
    spelt_dot = spelt_dot + bare
    alone = length <= 5
    kind = np.select(
        [
            alone & (spelt_at > 0) | (at > 0) & (length == 1), alone & (spelt_dot > 0),
            at + spelt_at > 0, digits >= 12, digits >= 4, digits >= 1, FIRST[data[start]] == 1,
        ],
        [7, 8, 5, 4, 3, 2, 6], 1,
    )
    out[:, 12] = np.minimum(spelt_at, 1) + 2 * np.minimum(spelt_dot, 1)
    last = np.zeros(len(start) + 1, bool)
    last[words.first] = True  # a text's first word has no neighbour before it
    out[1:, 9] = np.where(last[1:-1], 0, kind[:-1])
    out[:-1, 10] = np.where(last[1:-1], 0, kind[1:])
    for i in np.flatnonzero((digits >= 12) & (digits <= 19)).tolist():
        raw = data[start[i] : end[i]]
        out[i, 11] = 1 + luhn(raw[DIGIT[raw]].tobytes().decode())
    return out


RADIX = np.cumprod((1, *GROUPS[:-1]))


@dataclass(frozen=True)
class PiiFinder:
    """``sample_docs`` bounds the texts that are labelled for training, ``sample_runs`` the
    runs of words taken from them, ``text_runs`` those of each kind (or none) from one text;
    ``margin`` is how much more likely (as a logarithm) a
    reading with personal data must be than one without, to add its spans."""

    sample_docs: int = 600
    sample_runs: int = 1200
    text_runs: int = 8
    margin: float = 4.0

    # -- training

    def labelled_runs(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The training table: (features, labels) of runs of words around numbers and @,
        about half of the personal data in them rewritten and an ordinary number put behind
        each text (by its hash).

        Those first by a hash of text and place, at most ``text_runs`` of a kind from one text
        and ``sample_runs`` in all; a tenth of these is for each kind before the rest. From the ``sample_docs`` texts with a digit or @ that come first by a hash of id and
        text, so the same table gives the same sample.
        """
        text = F.col(text_col)
        hashed = docs.where(text.rlike("[0-9@]")).select(
            text.alias("text"), F.xxhash64(F.col(id_col), text).alias("at")
        )
        # The hashes alone are sorted; the texts stay where they are.
        last = hashed.select("at").orderBy("at").limit(self.sample_docs).agg(F.max("at")).first()[0]
        sample = hashed.where(F.col("at") <= F.lit(last)).limit(self.sample_docs)
        schema = "features array<array<int>>, labels array<int>, at long, place long"
        runs = sample.select("text", "at").mapInArrow(_labelled, schema)
        kind = F.expr("CASE WHEN array_max(labels) > 0 THEN (array_max(labels) + 1) DIV 2 ELSE 0 END")
        runs = runs.withColumns({"kind": kind, "draw": F.xxhash64("at", "place")})
        first = F.row_number().over(Window.partitionBy("at", "kind").orderBy("draw", "place"))
        runs = runs.withColumn("n", first).where(F.col("n") <= self.text_runs)
        runs = runs.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("draw", "at", "place")))
        later = (F.col("kind") == 0) | (10 * F.col("n") > self.sample_runs)
        return runs.orderBy(later, "draw", "at", "place").limit(self.sample_runs).select("features", "labels")

    def train(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> crf.Crf | None:
        """The model; None where no text of the sample has personal data."""
        rows = self.labelled_runs(docs, id_col, text_col).collect()
        rows = sorted((tuple(map(tuple, r["features"])), tuple(r["labels"])) for r in rows)
        if not any(any(labels) for _, labels in rows):
            return None
        length = max(len(labels) for _, labels in rows)
        features = np.zeros((len(rows), length, len(GROUPS)), np.int64)
        labels, mask = np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length), bool)
        for i, (f, y) in enumerate(rows):
            features[i, : len(y)], labels[i, : len(y)], mask[i, : len(y)] = f, y, True
        return crf.train(features, labels, mask, GROUPS, LABELS)

    # -- finding

    def find(
        self, docs: DataFrame, model: crf.Crf | None, id_col: str = "doc_id", text_col: str = "text",
        redact: bool = False, keep: tuple[str, ...] = (),
    ) -> DataFrame:
        """(id, spans) per row of ``docs``, with the text if ``redact``.

        ``spans``: kind, start, end (code points, end exclusive) and whether a rule found it;
        by kind, then start. Added spans overlap no other. With ``redact`` the text has each
        stretch of spans replaced by its first kind in brackets. NULL and empty texts have no
        spans (and a NULL text stays NULL); repeated rows and NULL ids stay. ``keep`` names more
        columns to pass on.
        """
        sent = docs.sparkSession.sparkContext.broadcast(model)
        margin = self.margin
        row = F.struct(F.col(id_col).alias("id"), *keep)
        narrowed = docs.select(row.alias("id"), F.col(text_col).alias("text"))
        schema = f"id {dict(narrowed.dtypes)['id']}, spans {SPANS}" + ", text string" * redact

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1)
                spans = find_spans(texts, sent.value, margin)
                named = [
                    [{"kind": KINDS[k], "start": s, "end": e, "rule": r} for k, s, e, r in found] for found in spans
                ]
                columns = {"id": batch.column(0), "spans": pa.array(named, pa.list_(SPAN))}
                if redact:
                    columns["text"] = pa.array(
                        [redacted(t.as_py(), f) if f else t.as_py() for t, f in zip(texts, spans, strict=True)], pa.string()
                    )
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        others = [F.col("id").getField(c).alias(c) for c in keep]
        text = [F.col("text").alias(text_col)] if redact else []
        return narrowed.mapInArrow(run, schema).select(F.col("id.id").alias(id_col), *others, "spans", *text)


def find_spans(texts: pa.Array, model: crf.Crf | None, margin: float) -> list[list[tuple[int, int, int, bool]]]:
    out: list[list] = [[] for _ in range(len(texts))]
    for words in bytewords.split(texts, bytewords.NOT_SPACE, hashed=False):
        marks = DIGIT[words.data] | (words.data == ord("@")) | spelt(words.data)[0]
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        has = np.flatnonzero(np.diff(sums[words.bounds]))  # no other text can have a span
        added = added_spans(words, model, margin) if model is not None and len(has) else {}
        for t in has.tolist():
            base = rule_spans(texts[words.row0 + t].as_py())
            found = [(k, s, e, True) for k, s, e in base]
            if t in added:
                taken = [(s, e) for _, s, e in base]
                codes = np.cumsum((words.data[words.bounds[t] : words.bounds[t + 1]] & 0xC0) != 0x80)
                for k, s, e in added[t]:
                    s, e = int(codes[s]) - 1, int(codes[e - 1])
                    if all(e <= a or b <= s for a, b in taken):
                        found.append((k, s, e, False))
                found.sort()
            out[words.row0 + t] = found
    return out


def added_spans(words: bytewords.Words, model: crf.Crf, margin: float) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start byte, end byte) of what the model reads as personal data, by text."""
    features = shapes(words)
    codes, which = np.unique(features @ RADIX, return_inverse=True)
    scores = model.emissions(codes[:, None] // RADIX % np.array(GROUPS))
    open_ = ~model.certain(scores)[which]
    n = len(open_)
    edge = np.zeros(n + 1, bool)
    edge[words.first] = True
    begin = np.flatnonzero(open_ & (edge[:-1] | ~np.append(False, open_[:-1])))
    end = np.flatnonzero(open_ & (edge[1:] | ~np.append(open_[1:], False))) + 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    order = np.argsort(end - begin, kind="stable")
    at = 0
    while at < len(order):
        some = order[at : at + 2048]
        lengths = end[some] - begin[some]
        some = some[lengths <= max(2 * int(lengths[0]), 8)]  # runs of like length together
        at += len(some)
        lengths = end[some] - begin[some]
        t = int(lengths.max())
        place = np.minimum(begin[some][:, None] + np.arange(t), n - 1)
        outer = (~edge[begin[some]]).astype(float), (~edge[end[some]]).astype(float)
        paths, gain = crf.viterbi(scores[which[place]], model.moves, lengths, outer)
        for row in np.flatnonzero((gain >= margin) & paths.any(axis=1)).tolist():
            first = int(begin[some[row]])
            text = int(np.searchsorted(words.first, first, "right")) - 1
            for kind, a, b in _runs(paths[row, : lengths[row]].tolist()):
                span = _trimmed(words, first + a, first + b, text)
                if span:
                    found.setdefault(text, []).append((kind, *span))
    return found


def _runs(labels: list[int]) -> Iterator[tuple[int, int, int]]:
    """(kind, begin, end) of runs of labels of one kind; a begin label starts a new one."""
    begin = None
    for i, label in enumerate([*labels, 0]):
        if begin is not None and (label == 0 or label % 2 or (label - 1) // 2 != (labels[begin] - 1) // 2):
            yield (labels[begin] - 1) // 2, begin, i
            begin = None
        if label and begin is None:
            begin = i


def _trimmed(words: bytewords.Words, a: int, b: int, text: int) -> tuple[int, int] | None:
    """Bytes of words a..b-1 less what cannot begin or end personal data."""
    start, end = int(words.start[a]), int(words.end[b - 1])
    raw = words.data[start:end]
    keep = np.flatnonzero(DIGIT[raw] | LETTER[raw])
    if not len(keep) or not (DIGIT[raw] | (raw == ord("@")) | spelt(raw)[0]).any():
        return None
    first, last = int(keep[0]), int(keep[-1])
    if first and raw[first - 1] in b"+(":
        first -= 1
    origin = int(words.bounds[text])
    return start + first - origin, start + last + 1 - origin


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, labels, at, place = [], [], [], []
        made = []
        for text, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rng = random.Random(seed)
            text, spans = with_rewritten(text, rule_spans(text), rng)
            made.append((f"{text} {ordinary(rng)} or so", spans))
        texts = pa.array([text for text, _ in made], pa.string())
        for words in bytewords.split(texts, bytewords.NOT_SPACE, hashed=False):
            shape = shapes(words)
            marked = (shape[:, 0] > 0) | (shape[:, 1] > 0) | (shape[:, 12] > 0)
            for t in range(len(words)):
                a, b = int(words.first[t]), int(words.first[t + 1])
                y = _word_labels(words, t, made[words.row0 + t][1])
                for s, e in _around(np.flatnonzero(marked[a:b]), b - a):
                    features.append(shape[a + s : a + e].tolist())
                    labels.append(y[s:e].tolist())
                    at.append(batch.column(1)[words.row0 + t].as_py())
                    place.append(s)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32())),
                pa.array(at, pa.int64()), pa.array(place, pa.int64()),
            ],
            ["features", "labels", "at", "place"],
        )


def _around(marked: np.ndarray, n: int, longest: int = 40) -> Iterator[tuple[int, int]]:
    """Runs of words around marked ones, none overlapping, of bounded length."""
    done = 0
    for m in marked.tolist():
        if m < done:
            continue
        begin, stop = max(done, m - WINDOW), min(n, m + WINDOW + 1)
        inside = marked[(marked >= m) & (marked < m + longest - 2 * WINDOW)]
        for other in inside.tolist():
            if other <= stop:
                stop = min(n, other + WINDOW + 1)
        yield begin, stop
        done = stop


def _word_labels(words: bytewords.Words, t: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    a, b = int(words.first[t]), int(words.first[t + 1])
    y = np.zeros(b - a, np.int64)
    if spans:
        origin = int(words.bounds[t])
        raw = words.data[origin : int(words.bounds[t + 1])]
        codes = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        start, end = codes[words.start[a:b] - origin], codes[words.end[a:b] - origin]
        for kind, s, e in reversed(spans):
            inside = np.flatnonzero((start < e) & (end > s))
            y[inside] = 2 + 2 * kind
            y[inside[:1]] = 1 + 2 * kind
    return y


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
