"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tapewright.llm import license_texts
from tapewright.llm import textnum as tn
from tapewright.llm.store import fresh

SHINGLE, CONTAINMENT = 5, 0.8
#: Bands of one MinHash. A window that holds CONTAINMENT of a template's shingles has a Jaccard similarity of 0.36 or
#: more with it (windows are twice a template long): at least 1 - 0.64**16 = 0.999 of them share a band.
BANDS = 16
#: License id: a notice as it is commonly written. Public wording.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0 International.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0 International.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
}
#: Shingles of a piece of a whole license text; a piece that shares more than SHARED of them with another license goes.
PIECE, SHARED = 24, 0.5
_TAG = b"SPDX-License-Identifier:"
_ID = rb"\(*[A-Za-z0-9]+(?:[.:-][A-Za-z0-9]+)*\+?\)*"
_SPDX = re.compile(_TAG + rb"[ \t]*(" + _ID + rb"(?:[ \t]+(?:AND|OR|WITH)[ \t]+" + _ID + rb")*)")
#: ASCII letters, in lower case, digits and all other bytes of UTF-8 make words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Index:
    """Templates by their number of shingles: sets, and for each band a filter and the sorted minima."""

    def __init__(self, templates: Mapping[str, str | Sequence[str]], k: int, bands: int, bodies: Mapping[str, str]):
        self.k = k
        pairs = [(n, t) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]
        self.names = [n for n, _ in pairs]
        words = tn.Words(pa.array([t for _, t in pairs], pa.large_string()), _BLANK, _FOLD)
        if (words.count < k).any():
            raise ValueError(f"templates need {k} words")
        g, lo, hi = words.grams(k)
        self.sets = [np.unique(g[a:b]) for a, b in zip(lo, hi, strict=True)]
        self._add_bodies(bodies)
        self.a = np.random.default_rng(13).integers(1, 2**63, bands, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.by_size: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            self.by_size.setdefault(len(s), []).append(t)
        # One shingle is its own window, which is equal in every band or in none.
        of = {n: self.a[: 1 if n == 1 else bands] for n in self.by_size}
        self.minima = {n: [np.array([(self.sets[t] * a).min() for t in ts]) for a in of[n]] for n, ts in self.by_size.items()}
        self.holders: dict[int, list[dict[int, list[int]]]] = {}
        for n, ts in self.by_size.items():
            self.holders[n] = [{} for _ in of[n]]
            for held, row in zip(self.holders[n], self.minima[n], strict=True):
                for t, m in zip(ts, row.tolist(), strict=True):
                    held.setdefault(m, []).append(t)
        self.filters = {}
        for n, rows in self.minima.items():
            self.filters[n] = []
            for row in rows:
                f = np.zeros(1 << 16, bool)
                f[row >> np.uint64(48)] = True
                self.filters[n].append(f)

    def _add_bodies(self, bodies: Mapping[str, str]) -> None:
        """Whole texts, cut into pieces of PIECE shingles that tell their license from the other ones."""
        if not bodies:
            return
        g, lo, hi = tn.Words(pa.array(list(bodies.values()), pa.large_string()), _BLANK, _FOLD).grams(self.k)
        own = {n: g[a:b] for n, a, b in zip(bodies, lo, hi, strict=True)}
        for name, grams in own.items():
            others = np.concatenate([np.zeros(0, g.dtype), *(x for n, x in own.items() if n != name)])
            for at in range(0, len(grams) - PIECE + 1, PIECE + self.k - 1):
                piece = np.unique(grams[at : at + PIECE])
                if len(piece) == PIECE and np.isin(piece, others).mean() <= SHARED:
                    self.names.append(name)
                    self.sets.append(piece)


def _spdx(text: bytes) -> set[tuple[int, int, str, float]]:
    """Licenses of SPDX tags: a tag's expression without exceptions; "only", "or later" and + are left out of ids."""
    out = set()
    for m in _SPDX.finditer(text):
        skip = False
        for x in m[1].split():
            x = x.strip(b"()")
            if x in (b"AND", b"OR", b"WITH"):
                skip = x == b"WITH"
            elif not skip and x not in (b"NONE", b"NOASSERTION"):
                out.add((m.start(), m.end(1), re.sub(r"(-only|-or-later|\+)$", "", x.decode()), 1.0))
    return out


def _blocks(lo: np.ndarray, hi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of n grams of all documents, and each block's document."""
    count = -((lo - hi) // n)
    doc = np.repeat(np.arange(len(lo)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return lo[doc] + within * n, doc


def _best(spans: set[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Sorted, without matches that a match with more of its template overlaps."""
    out: list[tuple[int, int, str, float]] = []
    group: list[tuple[int, int, str, float]] = []
    end = -1
    for s in [*sorted(spans), None]:
        if s is None or s[0] >= end:
            out += [x for x in group if not any(y[3] > x[3] and y[0] < x[1] and x[0] < y[1] for y in group)]
            group = []
        if s is not None:
            group.append(s)
            end = max(end, s[1])
    return out


def _scan(index_of, containment: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            for part in tn.slices(batch, batch.schema.names[-1]):
                words = tn.Words(part.column(part.num_columns - 1), _BLANK, _FOLD)
                g, lo, hi = words.grams(index.k)
                found: list[set] = [set() for _ in range(part.num_rows)]
                if len(g):
                    hashed = [g * a for a in index.a]
                for n in index.by_size if len(g) else ():
                    start, doc = _blocks(lo, hi, n)
                    pair = np.zeros(len(start), bool)
                    pair[:-1] = (doc[1:] == doc[:-1]) & (n > 1)
                    hits: set[tuple[int, int]] = set()
                    for h, held, f in zip(hashed, index.holders[n], index.filters[n]):  # fewer bands for n = 1
                        low = np.minimum.reduceat(h, start) if n > 1 else h
                        window = np.where(pair, np.minimum(low, np.append(low[1:], low[-1:])), low)
                        maybe = np.flatnonzero(f[window >> np.uint64(48)])
                        for w, m in zip(maybe.tolist(), window[maybe].tolist(), strict=True):
                            hits.update((w, t) for t in held.get(m, ()))
                    for w, t in hits:
                        d, at = int(doc[w]), int(start[w])
                        end = min(at + 2 * n, int(hi[d]))
                        inside = np.flatnonzero(np.isin(g[at:end], index.sets[t]))
                        share = len(np.unique(g[at:end][inside])) / len(index.sets[t])
                        if share >= containment:
                            first = int(words.lo[d]) + at + int(inside[0]) - int(lo[d])
                            last = min(int(words.lo[d]) + at + int(inside[-1]) - int(lo[d]) + index.k - 1, int(words.hi[d]) - 1)
                            found[d].add((int(words.starts[first] - words.off[d]), int(words.ends[last] - words.off[d]), index.names[t], share))
                out = []
                for d in range(part.num_rows):
                    text = words.data[words.off[d] : words.off[d + 1]].tobytes()
                    if _TAG.lower() in text:  # the words' text is case folded
                        found[d] |= _spdx(part.column(part.num_columns - 1)[d].as_py().encode())
                for d, spans in enumerate(found):
                    if spans:
                        text = words.data[words.off[d] : words.off[d + 1]]
                        point = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                        out.append([{"license": name, "start": int(point[a]), "end": int(point[b])} for a, b, name, _ in _best(spans)])
                    else:
                        out.append([])
                kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.record_batch([*part.columns[:-1], pa.array(out, kind)], names=[*part.schema.names[:-1], "matches"])

    return run


def _known() -> dict[str, list[str]]:
    names = {**license_texts.NOTICES, **TEMPLATES}
    return {n: [*([TEMPLATES[n]] if n in TEMPLATES else []), *license_texts.NOTICES.get(n, [])] for n in names}


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Mapping[str, str | Sequence[str]] | None = None, k: int = SHINGLE,
                  containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """``docs`` with ``matches`` (license, start, end; code points, end exclusive) instead of its text.

    Without ``templates``: TEMPLATES, the notices and whole texts of ``license_texts``, the latter in pieces. SPDX tags
    are read in any case, whatever their license.

    Words are runs of ASCII letters (case folded), digits and other characters outside ASCII; shingles are of k
    words. For each template length, the shingles of a text are cut into blocks of that length, and every two
    neighbouring blocks are a window, so that a whole occurrence lies in one. Windows that share a MinHash with a
    template are verified: a match holds ``containment`` or more of the template's shingles. Whole texts are scanned,
    batches of rows at a time; only the templates are sent to the tasks.

    Of overlapping matches, those with a smaller share of their template go (a version's notice is close to another
    version's). A match found by two windows is listed once if its span is the same. Null and empty texts and texts under k words
    have no matches (a template has at least k words). Rows are independent: repeated rows get the same matches, an empty table gives
    an empty result; a column named ``matches``, in any case, is replaced."""
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), "matches")]
    index_of = docs.sparkSession.sparkContext.broadcast(_Index(_known() if templates is None else templates, k, bands, license_texts.bodies() if templates is None else {}))
    (t,) = fresh(docs, "text")
    schema = docs.select(*rest).schema.add("matches", DataType.fromDDL("array<struct<license:string,start:long,end:long>>"))
    return docs.select(*rest, F.col(text_col).alias(t)).mapInArrow(_scan(index_of, containment), schema)
