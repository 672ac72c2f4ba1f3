"""License scans: phrases in place, and an exact containment join of text blocks with notices."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import text_slices, word_hashes, words

#: Fixed value: a word is a run of ASCII letters and digits and of characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base rule.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences of public license notices.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
             "License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
            "MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software"),
]
CONTAINMENT = 0.8
#: Words of all templates together; they are held by every task.
MOST_WORDS = 1_000_000

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return re.findall(WORD.encode(), text.encode("utf-8", "replace").lower())


def _hashes(vocabulary: list[bytes]) -> np.ndarray:
    data, starts, ends, _ = words(pa.array([w.decode() for w in vocabulary], pa.string()), _BETWEEN)
    return word_hashes(data, starts, ends, lower=True)


class Templates:
    """Word sets of templates; blocks of text have twice the words of the longest one, at steps of its size."""

    def __init__(self, templates: list[tuple[str, str]], containment: float):
        self.containment = Fraction(str(containment))
        self.labels, self.sets = [], []
        self.step = 1
        for label, text in templates:
            own = tokens(text)
            if own:
                self.labels.append(label)
                self.sets.append(frozenset(own))
                self.step = max(self.step, len(own))
        if sum(map(len, self.sets)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        self.vocabulary = sorted(frozenset().union(*self.sets)) if self.sets else []
        self.need = [-int(-len(s) * self.containment // 1) for s in self.sets]
        #: templates whose words are part of another's
        self.nested = {(a, b) for a in range(len(self.sets)) for b in range(len(self.sets))
                       if a != b and self.sets[a] < self.sets[b]}

    def best(self, hits: dict[int, int]) -> list[int]:
        """Of templates found in a block (with common words), those not beaten by a nested one."""
        def rank(t: int) -> tuple:
            return Fraction(hits[t], len(self.sets[t])), len(self.sets[t])
        return [t for t in hits if not any(
            ((t, o) in self.nested or (o, t) in self.nested) and rank(o) > rank(t) for o in hits)]


def _block_words(column: pa.Array, known: np.ndarray, place: np.ndarray, step: int):
    """Slices' words, and (block, place) of the distinct known words of each block, by block and place.

    ``known`` are sorted hashes, ``place`` their places in the global order. Block b
    of the slice's row r has the number ``base[r] + b``.
    """
    data, starts, ends, first = words(column, _BETWEEN)
    h = word_hashes(data, starts, ends, lower=True)
    blocks = -(-np.diff(first) // step)
    base = np.cumsum(blocks) - blocks
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    row = np.searchsorted(first, hit, side="right") - 1
    block = (hit - first[row]) // step
    own = (base[row] + block) * len(known) + place[at[hit]]
    back = block > 0
    keys = np.unique(np.concatenate([own, own[back] - len(known)]))
    return (data, starts, ends, first, base, h), keys // len(known), keys % len(known)


def word_order(docs: DataFrame, text: str, templates: Templates) -> np.ndarray:
    """The place of each template word in the global order: by the number of blocks that have it, rarest first.

    Counted over all blocks of all documents; words of no template cannot
    add to an overlap, so they stay out of the order and of the sets.
    """
    vocabulary = templates.vocabulary
    if not vocabulary:
        return np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = _hashes(vocabulary)
        by = np.argsort(h)
        counts = np.zeros(len(h), np.int64)
        for part in text_slices(batches, "text"):
            _, _, word = _block_words(part.column("text"), h[by], by, templates.step)
            counts += np.bincount(word, minlength=len(h))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])

    found = (docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, n long")
             .groupBy("word").agg(F.sum("n").alias("n")).collect())
    n = np.zeros(len(vocabulary), np.int64)
    for r in found:
        n[r.word] = r.n
    place = np.empty(len(n), np.int64)
    place[np.argsort(n, kind="stable")] = np.arange(len(n))
    return place


class _Join:
    """Index of template prefixes in the global order, for the blocks of a slice at a time."""

    def __init__(self, templates: Templates, place: np.ndarray):
        self.t = templates
        self.hashes = _hashes(templates.vocabulary)
        self.by = np.argsort(self.hashes)
        self.place = place[self.by]
        number = {w: i for i, w in enumerate(templates.vocabulary)}
        posts = []
        for t, own in enumerate(templates.sets):
            order = sorted(place[number[w]] for w in own)
            for i in range(len(order) - templates.need[t] + 1):
                posts.append((order[i], t, len(order) - i, templates.need[t]))
        posts.sort()
        self.posts = np.array(posts, np.int64).reshape(-1, 4)

    def candidates(self, block: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Keys (block, template) that may reach the containment, from sorted (block, place) pairs.

        The first common word of a block and a template, in the global order,
        lies in the template's prefix, and from it on both must have as many words as
        the template needs; a block with fewer known words is out by its length.
        """
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(np.append(begin, len(block)))
        left = np.repeat(begin + size, size) - np.arange(len(block))
        first = np.searchsorted(self.posts[:, 0], word)
        n = np.searchsorted(self.posts[:, 0], word, side="right") - first
        n[left < min(self.t.need)] = 0
        at = np.flatnonzero(n)
        n = n[at]
        post = np.arange(int(n.sum())) + np.repeat(first[at] - (np.cumsum(n) - n), n)
        at = np.repeat(at, n)
        rest = np.minimum(self.posts[post, 2], left[at])
        fits = rest >= self.posts[post, 3]
        return np.unique(block[at[fits]] * len(self.t.sets) + self.posts[post[fits], 1])

    def rows(self, column: pa.Array):
        """Words of the slice, and found blocks: (row, block, {template: common words})."""
        slice_, block, word = _block_words(column, self.hashes[self.by], self.place, self.t.step)
        data, starts, ends, first, base, _ = slice_
        found: dict[tuple[int, int], dict[int, int]] = {}
        seen: tuple[int, frozenset] = -1, frozenset()
        for key in self.candidates(block, word).tolist():
            b, t = divmod(key, len(self.t.sets))
            row = int(np.searchsorted(base, b, side="right")) - 1
            if seen[0] != b:
                low = int(first[row]) + (b - int(base[row])) * self.t.step
                high = min(low + 2 * self.t.step, int(first[row + 1]))
                seen = b, frozenset(data[starts[i]:ends[i]].tobytes().lower() for i in range(low, high))
            common = len(self.t.sets[t] & seen[1])
            if common >= self.t.need[t]:
                found.setdefault((row, b - int(base[row])), {})[t] = common
        return slice_, found


def _places(slice_, phrases: list[tuple[list[bytes], np.ndarray]]) -> list[list[tuple[int, int]]]:
    """Per row the places (word, phrase) where a phrase's words stand one after another."""
    data, starts, ends, first, _, h = slice_
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(first) - 1)]
    for k, (own, hashes) in enumerate(phrases):
        n = len(h) - len(own) + 1
        if n <= 0:
            continue
        hit = h[:n] == hashes[0]
        for j in range(1, len(own)):
            hit &= h[j:n + j] == hashes[j]
        for at in np.flatnonzero(hit).tolist():
            row = int(np.searchsorted(first, at, side="right")) - 1
            if at + len(own) <= first[row + 1] and all(
                    data[starts[at + j]:ends[at + j]].tobytes().lower() == w for j, w in enumerate(own)):
                out[row].append((at - int(first[row]), k))
    return out


def find_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, template, start, n_words, containment): every block that has enough of a template's words.

    A block is twice as many consecutive words as the longest template has, at
    steps of that size (the last ones of a text are shorter), so any stretch as long as a
    template lies whole in some block. Containment is the share of the template's
    distinct words that the block has. Templates are a parameter that every task holds (bounded; more raise
    ``ValueError``), so documents are not shuffled. A null text has no words; repeated ids give rows each; other columns are
    ignored; an empty table, or no templates, gives no rows.
    """
    held = Templates(templates, containment)
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    place = word_order(docs, text, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held.sets:
            return
        join = _Join(held, place)
        for part in text_slices(batches, "text"):
            (_, _, _, first, _, _), found = join.rows(part.column("text"))
            rows = [(r, held.labels[t], t, b * held.step,
                     min(2 * held.step, int(first[r + 1] - first[r]) - b * held.step), n / len(held.sets[t]))
                    for (r, b), hits in found.items() for t, n in hits.items()]
            kept = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(kept[0], pa.int64())), pa.array(kept[1], pa.string()),
                 pa.array(kept[2], pa.int32()), pa.array(kept[3], pa.int64()), pa.array(kept[4], pa.int64()),
                 pa.array(kept[5], pa.float64())],
                names=["doc_id", "label", "template", "start", "n_words", "containment"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, label string, template int, start long, n_words long, containment double")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
         containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its places of phrases, and its labels by phrases and by notices.

    ``n_words``, ``n_base`` (places of all phrases), ``first_word`` and ``last_word`` (smallest and largest start
    of a place, else null), ``base_labels``, ``labels`` (with those of ``find_blocks``; of two templates
    in a block of which one's words are part of the other's, the one with the higher containment
    counts, of equal ones the larger), ``score``: 1 where a phrase stands, else the best containment
    of a block, else 0. Nulls, repeats and empty tables are as in ``find_blocks``; each document has its row.
    """
    held = Templates(templates, containment)
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    place = word_order(docs, text, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _Join(held, place) if held.sets else None
        own = [(tokens(p), _hashes(tokens(p))) for p in phrases]
        names = list(phrases.values())
        for part in text_slices(batches, "text"):
            if join:
                slice_, found = join.rows(part.column("text"))
            else:
                slice_ = _block_words(part.column("text"), np.zeros(1, np.uint64), np.zeros(1, np.int64), 1)[0]
                found = {}
            at = _places(slice_, own)
            by_row: list[tuple[set, float]] = [(set(), 0.0) for _ in at]
            for (r, _), hits in found.items():
                labels, score = by_row[r]
                labels.update(held.labels[t] for t in held.best(hits))
                by_row[r] = labels, max(score, *(n / len(held.sets[t]) for t, n in hits.items()))
            base = [{names[k] for _, k in row} for row in at]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(slice_[3]).astype(np.int64)),
                 pa.array([len(row) for row in at], pa.int64()),
                 pa.array([min(row)[0] if row else None for row in at], pa.int64()),
                 pa.array([max(row)[0] if row else None for row in at], pa.int64()),
                 pa.array([",".join(sorted(b)) for b in base], pa.string()),
                 pa.array([",".join(sorted(b | m)) for b, (m, _) in zip(base, by_row, strict=True)], pa.string()),
                 pa.array([1.0 if b else s for b, (_, s) in zip(base, by_row, strict=True)], pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
             "base_labels string, labels string, score double")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
             containment: float = CONTAINMENT) -> str:
    """The rows of ``scan`` over ``documents`` in DuckDB's SQL, without filters of the join."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    notices = ", ".join(f"({i}, {_quoted(a)}, {_quoted(t)})" for i, (a, t) in enumerate(templates))
    spans = ", ".join(f"({_quoted(p)}, {_quoted(a)})" for p, a in phrases.items())
    cut = f"regexp_extract_all(translate(coalesce({{}}, ''), '{upper}', '{lower}'), '{WORD}')"
    need = Fraction(str(containment))
    return f"""
WITH notice AS (SELECT i, label, {cut.format('body')} AS w FROM (VALUES {notices}) AS v(i, label, body)),
notice_word AS (SELECT DISTINCT i, label, unnest(w) AS word FROM notice),
size AS (SELECT i, label, count(*) AS n FROM notice_word GROUP BY ALL),
step AS (SELECT max(len(w)) AS k FROM notice),
nested AS (SELECT a.i AS small, b.i AS large FROM size a JOIN size b ON a.i <> b.i AND a.n < b.n
  JOIN (SELECT x.i AS i, y.i AS j, count(*) AS n FROM notice_word x JOIN notice_word y ON x.word = y.word
        GROUP BY ALL) c ON c.i = a.i AND c.j = b.i AND c.n = a.n),
doc AS (SELECT row_number() OVER () AS r, doc_id, {cut.format('text')} AS w FROM documents),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM doc),
known AS (SELECT r, word, p // k AS b FROM word, step WHERE word IN (SELECT word FROM notice_word)),
block AS (SELECT r, word, b FROM known UNION SELECT r, word, b - 1 FROM known WHERE b > 0),
hit AS (SELECT r, b, i, n, count(*) AS c FROM block JOIN notice_word USING (word) JOIN size USING (i, label)
  GROUP BY ALL HAVING count(*) * {need.denominator} >= n * {need.numerator}),
beaten AS (SELECT x.r, x.b, x.i FROM hit x JOIN hit y ON x.r = y.r AND x.b = y.b
  JOIN nested ON (small = x.i AND large = y.i) OR (small = y.i AND large = x.i)
  WHERE y.c * x.n > x.c * y.n OR (y.c * x.n = x.c * y.n AND y.n > x.n)),
noticed AS (SELECT r, label FROM hit JOIN size USING (i) WHERE (r, b, i) NOT IN (SELECT (r, b, i) FROM beaten)),
best AS (SELECT r, max(c / n) AS s FROM hit GROUP BY r),
phrase AS (SELECT string_split(p, ' ') AS pw, label FROM (VALUES {spans}) AS v(p, label)),
place AS (SELECT r, p, label FROM word JOIN phrase ON word = pw[1] JOIN doc USING (r)
  WHERE w[p + 1:p + len(pw)] = pw),
base AS (SELECT r, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM place GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l
  FROM (SELECT r, label FROM place UNION ALL SELECT r, label FROM noticed) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word,
  z::BIGINT AS last_word, coalesce(base.l, '') AS base_labels, coalesce(named.l, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(s, 0) END::DOUBLE AS score
FROM doc LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""
