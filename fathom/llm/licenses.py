"""License scans by patience alignment.

A text is aligned with each license template: words that occur once in both are
anchors, their longest increasing subsequence is taken, and the gaps between them
are aligned in the same way.  The share of the template's words that are aligned is
its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns
from .license_texts import TEMPLATES

#: The share of a template's words that must be aligned.
LEAST_COVERAGE = 0.85

WORD = re.compile("[A-Za-z0-9]+")
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).decode("ascii").split()


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of indices: for gaps without anchors."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment: pairs (i, j), increasing in both, with a[i] == b[j]."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        once_a = {w: i for i, w in enumerate(a[a0:a1], a0)}
        once_b = {w: j for j, w in enumerate(b[b0:b1], b0)}
        many_a, many_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        both = [(j, once_a[w]) for w, j in once_b.items() if many_b[w] == 1 and many_a.get(w) == 1]
        both.sort()
        anchors = [both[k] for k in increasing([i for _, i in both])]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        i0, j0 = a0, b0
        for j, i in [*anchors, (b1, a1)]:
            if i0 < i and j0 < j:
                todo.append((i0, i, j0, j))
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def common_length(a: list[str], masks: dict[str, int], size: int) -> int:
    """The length of a longest common subsequence with a template of so many words, by bits.

    masks: a bit for each place that a word has in the template (Hyyro, 2004).
    """
    whole = (1 << size) - 1
    row = whole
    for word in a:
        if mask := masks.get(word):
            both = row & mask
            row = (row + both | row - both) & whole
    return size - row.bit_count()


class Template:
    def __init__(self, name: str, words: list[str], least: float):
        self.name, self.words, self.many = name, words, Counter(words)
        self.need, self.span = int(-(-len(words) * least // 1)), 2 * len(words) + 16
        self.masks: dict[str, int] = {}
        for i, w in enumerate(words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def aligned(self, window: list[str]) -> list[tuple[int, int]] | None:
        """The alignment of the first occurrence in a window that may hold two, or None."""
        pairs = align(window, self.words)
        if len(pairs) < self.need:
            return None
        near = len(self.words) + 16
        # A copy with words changed must not take them from the next one.
        if pairs[-1][0] >= near and len(first := align(window[:near], self.words)) >= self.need:
            rest = first[-1][0] + 1
            if len(align(window[rest : rest + self.span], self.words)) >= self.need:
                return first
        return pairs


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.templates = [Template(name, words, least) for name, t in templates.items() if (words := words_of(t))]
        self.known = {w for t in self.templates for w in t.words}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each occurrence, by place.

        An occurrence lies within twice the template's words and 16 more: one with
        more words in between is none.
        """
        words = words_of(text or "")
        at = [i for i, w in enumerate(words) if w in self.known]
        held, found = Counter(words[i] for i in at), []
        for t in self.templates:
            if sum(min(k, held.get(w, 0)) for w, k in t.many.items()) >= t.need:
                found += self._occurrences(t, words, [i for i in at if words[i] in t.many])
        return sorted(found, key=lambda x: (x[2], x[3], x[0]))

    def _occurrences(self, t: Template, words: list[str], hits: list[int]) -> list[tuple[str, float, int, int]]:
        """The template's occurrences, from left to right; hits: where words of it are.

        Windows begin at hits.  Two bounds tell, cheaply, that a window can't be
        aligned to the coverage asked for: its words of the template, counted with
        their repeats, and the longest common subsequence.  A hit that leaves a window
        and one that enters it change the latter by one each, so as many hits as are
        lacking can be passed over at once.
        """
        out, left, right, have = [], 0, 0, 0
        inside: Counter[str] = Counter()
        while left < len(hits):
            while right < len(hits) and hits[right] < hits[left] + t.span:
                word = words[hits[right]]
                inside[word] += 1
                have += inside[word] <= t.many[word]
                right += 1
            to = left + 1
            if have >= t.need:
                lacking = t.need - common_length([words[i] for i in hits[left:right]], t.masks, len(t.words))
                pairs = None if lacking > 0 else t.aligned(words[hits[left] : hits[left] + t.span])
                if pairs:
                    first, last = hits[left] + pairs[0][0], hits[left] + pairs[-1][0]
                    out.append((t.name, len(pairs) / len(t.words), first, last))
                    to = bisect_left(hits, last + 1, left)
                elif lacking > 0:
                    # Until `lacking` more hits have entered, no window is long enough.
                    enter = right + lacking - 1
                    to = bisect_left(hits, hits[enter] - t.span + 1, left + 1) if enter < len(hits) else len(hits)
            for i in range(left, min(to, right)):
                word = words[hits[i]]
                have -= inside[word] <= t.many[word]
                inside[word] -= 1
            left, right = to, max(to, right)
        return out


SCANNED = "doc_id long, n_licenses int, license string, coverage double, start int, end int, licenses string"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """The license texts and notices in each row of docs(doc_id, text).

    Result: doc_id; n_licenses, how many occurrences; license, coverage, start and end
    (characters) of the one with most aligned words, the first on a tie; licenses, the
    names of all by place, comma-joined.  Without one: 0, nulls and ''.

    An occurrence spans at most twice its template's words and 16 more.  Nulls and
    empty texts have none; repeated rows and null ids are passed through;
    whole texts are scanned; an empty table gives no rows.
    """
    templates = TEMPLATES if templates is None else templates

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        size = {t.name: len(t.words) for t in scanner.templates}
        for b in batches:
            out = []
            for text in b.column("text"):
                text = text.as_py()
                found = scanner.scan(text)
                if not found:
                    out.append((0, None, None, None, None, ""))
                    continue
                name, coverage, first, last = max(found, key=lambda x: (round(x[1] * size[x[0]]), -x[2]))
                places = list(WORD.finditer(text))
                out.append((len(found), name, coverage, places[first].start(), places[last].end(), ",".join(x[0] for x in found)))
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_licenses", "license", "coverage", "start", "end", "licenses"])

    return columns(docs, doc_id="long", text="string").mapInArrow(each, SCANNED)
