"""License scans: fuzzy search for short notices.

A notice may be misspelt by up to ``edits`` characters. Cut into one piece more than that, it leaves
at least one piece untouched in every match (pigeonhole), so exact hits of the pieces locate all
candidates; the regex library's bounded-error matching then verifies every run of whole words around
each whose length can fit. Of spans of one notice that overlap, the one with the fewest edits stays
(ties: the first, then the shortest). Texts are compared as words in lower case joined by single
spaces. Notices that stand exactly are found apart, at every place.

Nulls and odd rows: a null or empty text has no words, no spans, empty label strings and score 0;
repeated rows are scanned alike; a null ``doc_id`` passes through; other columns pass through, those
named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: phrase, label, and how many characters may differ
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("apache license", "apache", 2),
    ("cc by", "cc-by", 0),
    ("mit license", "mit", 1),
]
RESULTS = """n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string,
    score double, spans array<struct<label: string, first_word: bigint, end_word: bigint, edits: int, found: string>>"""
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
BATCH = 256


def pieces(phrase: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece): the phrase cut into ``edits`` + 1 pieces of about equal length."""
    cuts = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:])]


def _places(body: bytes, piece: bytes) -> Iterator[int]:
    at = body.find(piece)
    while at >= 0:
        yield at
        at = body.find(piece, at + 1)


def scan(docs: DataFrame, notices: list[tuple[str, str, int]] = NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with the results; ``score`` is the best match's share of unchanged characters."""
    plain = docs.drop(*NAMES)
    at, names = plain.columns.index(text), [*plain.columns, *NAMES]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    # words are runs of digits, letters and anything beyond ASCII; the rest separates
    letters = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        plans = []
        for phrase, label, edits in notices:
            whole = re.escape(phrase)
            fuzzy = regex.compile(rf"(?:{whole}){{e<={edits}}}", regex.BESTMATCH) if edits else None
            plans.append((phrase, label, edits, pieces(phrase, edits), fuzzy))

        def near(body: bytes, phrase: str, edits: int, seeds: list, fuzzy) -> dict[tuple[int, int], tuple[int, str]]:
            """Verified spans in bytes: (start, end) to (edits, text)."""
            around = []
            for offset, piece in seeds:
                for place in _places(body, piece):
                    # a differing character may be four bytes; spans begin and end at words
                    low = place - offset - 4 * edits - 1
                    high = place - offset + len(phrase) + 4 * edits + 1
                    around.append((max(0, body.rfind(b" ", 0, max(low, 0) + 1)), body.find(b" ", min(high, len(body) - 1))))
            seen: dict[tuple[int, int], tuple[int, str]] = {}
            reach = -1
            for low, high in sorted(around):
                if high <= reach:
                    continue
                reach = high
                # the window begins and ends with a space
                tokens = body[low + 1 : high].split(b" ")
                lengths = [len(t.decode("utf-8")) for t in tokens]
                start = low + 1
                for i in range(len(tokens)):
                    length, end = -1, start - 1
                    for j in range(i, len(tokens)):
                        length, end = length + 1 + lengths[j], end + 1 + len(tokens[j])
                        if length > len(phrase) + edits:
                            break
                        if length >= len(phrase) - edits and (start, end) not in seen:
                            run = body[start:end].decode("utf-8")
                            if match := fuzzy.fullmatch(run):
                                seen[start, end] = (sum(match.fuzzy_counts), run)
                    start += len(tokens[i]) + 1
            found: dict[tuple[int, int], tuple[int, str]] = {}
            for (start, end), (changed, run) in sorted(seen.items(), key=lambda x: (x[1][0], x[0])):
                if all(end <= s or e <= start for s, e in found):
                    found[start, end] = (changed, run)
            return found

        def one(value: str | None) -> tuple:
            tokens = (value or "").encode("utf-8").translate(letters).split()
            body = b" " + b" ".join(tokens) + b" "
            base, spans = [], {}
            for phrase, label, edits, seeds, fuzzy in plans:
                exact = phrase.encode()
                for place in _places(body, b" " + exact + b" "):
                    base.append((place + 1, label))
                    spans[place + 1, place + 1 + len(exact), label] = (0, phrase)
                if fuzzy is not None:
                    for (start, end), seen in near(body, phrase, edits, seeds, fuzzy).items():
                        spans.setdefault((start, end, label), seen)
            # number of the word that starts at each place, counted once along the text
            order = sorted({s for s, _, _ in spans})
            number, last, word = {}, 0, -1
            for place in order:
                word += body.count(b" ", last, place)
                number[place], last = word, place
            best = {label: len(phrase) for phrase, label, _, _, _ in plans}
            rows = [
                {"label": label, "first_word": number[s], "end_word": number[s] + body.count(b" ", s, e) + 1, "edits": edits, "found": seen}
                for (s, e, label), (edits, seen) in sorted(spans.items())
            ]
            exactly = [number[s] for s, _ in base]
            return (
                len(tokens),
                len(base),
                min(exactly, default=None),
                max(exactly, default=None),
                ",".join(sorted({label for _, label in base})),
                ",".join(sorted({r["label"] for r in rows})),
                max((1.0 - r["edits"] / best[r["label"]] for r in rows), default=0.0),
                rows,
            )

        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                rows = [one(x) for x in part.column(at).to_pylist()]
                found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names)

    return plain.mapInArrow(run, f"{fields}, {RESULTS}")
