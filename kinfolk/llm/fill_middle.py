"""Fill-in-middle transformation by a scan for events with one Aho-Corasick automaton.

A text is a sequence of units: a run of ASCII letters is one unit, any other code point is one. The automaton holds, as
two-character patterns, every change of class between ASCII characters (a letter after a non-letter, a non-letter after a
letter), and the three sentinels. It runs once over the text with every code point beyond ASCII shown as a stand-in
non-letter, so positions stay code points. Between two events lies one run: of letters, which is one unit, or of others,
which is as many units as code points. A cumulative sum over the runs therefore ranks every unit, and a cut after k units
is one binary search; units themselves are never listed.

Defined results: a null text is an empty one (plain, no units); a null doc_id is hashed as no digits; repeated rows give
equal rows; surrogates cannot occur in a Spark string; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfolk.llm.words import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: What stands for a code point beyond ASCII: not a letter and in no sentinel.
OTHER = "?"
CHANGE, SENTINEL = 0, 1

SCHEMA = "doc_id {0}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"


@cache
def automaton() -> ahocorasick.Automaton:
    """Class changes between ASCII characters, and sentinels."""
    letters = string.ascii_letters
    others = [chr(c) for c in range(128) if chr(c) not in letters]
    out = ahocorasick.Automaton()
    for a in letters:
        for b in others:
            out.add_word(a + b, CHANGE)
            out.add_word(b + a, CHANGE)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(sentinel, SENTINEL)
    out.make_automaton()
    return out


def scan(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of a text that is not empty: where its runs start (with its length at the end), how many units end before each,
    and whether it holds a sentinel."""
    shown = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
    events = np.fromiter(chain.from_iterable(automaton().iter(shown)), dtype=np.int64).reshape(-1, 2)
    changes = events[events[:, 1] == CHANGE, 0]
    starts = np.concatenate(([0], changes, [len(shown)]))
    units = np.diff(starts)
    first = 0 if shown[0] in string.ascii_letters else 1
    units[first::2] = 1  # runs take turns: letters, others
    return starts, np.concatenate(([0], np.cumsum(units))), len(changes) < len(events)


def cut(starts: np.ndarray, ranks: np.ndarray, k: int) -> int:
    """The code point at which unit k starts (the text's length, if k units are all)."""
    run = int(np.searchsorted(ranks, k, side="right")) - 1
    return int(starts[run]) + k - int(ranks[run])  # inside a run only where it has a unit per code point


def hashes(doc: str) -> list[int]:
    """h1 to h4 of a decimal doc_id."""
    digest = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(doc: str, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output."""
    if not text:
        return 0, "plain", None, None, text
    starts, ranks, sentinel = scan(text)
    n = int(ranks[-1])
    h1, h2, h3, h4 = hashes(doc)
    if sentinel or h3 % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    a, b = (cut(starts, ranks, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: str, form: str) -> str:
    """The text, from output and form alone. No part holds a sentinel, and none can arise where a part meets one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(first) :].split(MIDDLE)
    one, two = head.split(second)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output of all documents: doc_id, text."""

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = []
            for name, text in zip(part.column("_name").to_pylist(), part.column("text").to_pylist()):
                n, form, prefix, middle, out = transform(name, text)
                rows.append((n, form, prefix, middle, digest(out), digest(restored(out, form)), out))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])

    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))
