"""Repetition rules on the suffix array of a document's words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The shortest repeat in words that counts as repetition.
MIN_REPEAT = 10
#: A document is rejected when repeats cover more than this share of its words, all copies counted, ...
MAX_COVERED = 0.3
#: ... or when its longest repeat has more words than this. Two copies of it are under the share from 400 words on.
MAX_LONGEST = 60
#: The base rule: fewest words, and the highest percentage of words in repeated 3-word windows.
#: Longer repeats lie inside these windows, so MAX_COVERED only decides below this percentage.
MIN_WORDS, MAX_WINDOW_PERCENT, BASE_WINDOW = 50, 50, 3
#: Characters of short documents that are split and sorted together.
CHUNK = 600_000
#: Words compared at once between neighbouring suffixes.
STEP = 1 << 18
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"

COUNTS = (
    "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat",
)


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array of the words of some documents.

    ``words`` are word numbers, ``doc`` the (non-falling) number of each word's
    document. Suffixes end with their document, and those of different documents
    have no common prefix. ``lcp[j]`` belongs to the suffixes at j - 1 and j.
    Prefix doubling; only suffixes that are not yet told apart are sorted again.
    """
    n = len(words)
    order = np.lexsort((words, doc))
    fresh = np.r_[True, (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    width = 1
    group = np.r_[fresh, True]
    open_at = np.flatnonzero(~(group[:-1] & group[1:]))
    while len(open_at):
        at = order[open_at]
        after = at + width
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[at[inside]]
        # A suffix that ends here comes first in its group.
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[at]
        sort = np.argsort(first * (n + 1) + second)
        at, first, second = at[sort], first[sort], second[sort]
        order[open_at] = at
        fresh = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[at] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        width *= 2
        group = np.r_[fresh, True]
        open_at = open_at[~(group[:-1] & group[1:])]
    return order, common_prefixes(words, doc, order)


def common_prefixes(words: np.ndarray, doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The LCP array of a suffix array, in memory that follows the number of words.

    Where the words before two neighbouring suffixes are equal, these suffixes are
    neighbours too and have one word more in common. So only suffixes whose
    neighbour comes after another word are compared, word by word; such lengths add
    up to n log n at most.
    """
    n = len(words)
    near = np.full(n, -1, dtype=np.int64)
    near[order[1:]] = np.where(doc[order[1:]] == doc[order[:-1]], order[:-1], -1)
    ends = np.searchsorted(doc, doc, side="right")
    first = np.r_[True, doc[1:] != doc[:-1]]
    led = (near > 0) & ~first
    at = np.flatnonzero(led)
    led[at] = ~first[near[at]] & (words[at - 1] == words[near[at] - 1])
    own = np.flatnonzero(~led)
    length = np.zeros(len(own), dtype=np.int64)
    other = near[own]
    # The suffix that begins later ends first.
    most = np.where(other >= 0, ends[own] - np.maximum(own, other), 0)
    live = np.flatnonzero(most)
    while len(live):
        step = np.arange(max(1, STEP // len(live)))
        step = step[:int((most[live] - length[live]).max())]
        begin, rest = length[live], most[live] - length[live]
        left, right = (np.minimum((x[live] + begin)[:, None] + step, n - 1) for x in (own, other))
        same = (words[left] == words[right]) & (step < rest[:, None])
        more = np.where(same.all(axis=1), len(step), same.argmin(axis=1))
        length[live] += more
        live = live[(more == len(step)) & (rest > more)]
    # The others have a word less than the suffix that begins a word before.
    back = np.maximum.accumulate(np.where(led, 0, np.arange(n)))
    shared = np.zeros(n, dtype=np.int64)
    shared[own] = length
    return (shared[back] - (np.arange(n) - back))[order]


def _spans(order: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """For every word whether one of the spans of ``length`` words at ``order`` covers it; shorter ones than ``least`` don't count."""
    long = length >= least
    edge = np.zeros(len(order) + 1, dtype=np.int64)
    np.add.at(edge, order[long], 1)
    np.add.at(edge, order[long] + length[long], -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(split: list[list[bytes]], min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated base windows, words under repeats of ``min_repeat`` and more, longest repeat."""
    sizes = np.array([len(x) for x in split], dtype=np.int64)
    out = [np.zeros(len(split), dtype=np.int64) for _ in range(3)]
    if not sizes.sum():
        return out[0], out[1], out[2]
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    words = np.fromiter((numbers[w] for x in split for w in x), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(split)), sizes)
    order, lcp = suffix_array(words, doc)
    # Every LCP interval that a suffix is in begins with its longest one.
    longest = np.maximum(lcp, np.r_[lcp[1:], 0])
    base = _spans(order, np.where(longest >= BASE_WINDOW, BASE_WINDOW, 0), BASE_WINDOW)
    covered = _spans(order, longest, min_repeat)
    out[0] = np.bincount(doc, weights=base, minlength=len(split)).astype(np.int64)
    out[1] = np.bincount(doc, weights=covered, minlength=len(split)).astype(np.int64)
    np.maximum.at(out[2], doc[order], longest)
    return out[0], out[1], out[2]


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """n_words and the COUNTS of every text; null counts as empty. Only CHUNK bytes of texts are split at once."""
    parts, group, size = [], [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= CHUNK:
            parts.append(_measured(group, min_repeat))
            group, size = [], 0
    parts.append(_measured(group, min_repeat))
    return {c: np.concatenate([p[c] for p in parts]) for c in ("n_words", *COUNTS)}


def _measured(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    split, chars, symbols, lines = [], [], [], []
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        split.append(raw.split())
        chars.append(len(text or "") - len(raw) + len(raw.translate(None, _SPACES)))
        symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
        filled = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
        lines.append(len(filled) - len(set(filled)))
    counts = [np.array(x, dtype=np.int64) for x in ([len(x) for x in split], chars, symbols, lines)]
    return dict(zip(("n_words", *COUNTS), [*counts, *repetition(split, min_repeat)]))


def verdicts(m: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the measures."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_WINDOW_PERCENT * m["n_words"])
    repeats = (m["n_covered_words"] > max_covered * m["n_words"]) | (m["longest_repeat"] > max_longest)
    return failed, ~failed & ~repeats


def judged(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, COUNTS, base_failed, kept) for every row of ``docs``.

    Null, empty and blank texts have zero words and fail the base rule. Repeated
    rows are judged each time, a null doc_id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measure(batch.column(1).to_pylist(), min_repeat)
            failed, kept = verdicts(m, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(m[c]) for c in ("n_words", *COUNTS)], pa.array(failed), pa.array(kept)],
                ["doc_id", "n_words", *COUNTS, "base_failed", "kept"],
            )

    kind = ", ".join(f"{c} long" for c in ("doc_id", "n_words", *COUNTS)) + ", base_failed boolean, kept boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, kind)


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are."""

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        return pa.array(verdicts(measure(texts.to_pylist()), MAX_COVERED, MAX_LONGEST)[1])

    return docs.filter(keeps(F.col(text_col)))
