"""Licence scans: texts stream through a suffix automaton of licence templates, and long matches chain into covered spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, released
from .words import ALNUM, words_of

#: Phrases that name a licence wherever they stand, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices in common use, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)

#: Bytes of text that a worker takes at a time, but for a longer text.
SLICE = 1 << 23


@dataclass(frozen=True)
class Automaton:
    """A generalised suffix automaton of templates, as sequences of word numbers from 1.

    Each state is a class of factors that end at the same places of the templates; link leads to
    the longest factor's longest suffix of another class.
    """

    words: dict[bytes, int]
    following: list[dict[int, int]]
    link: list[int]
    length: list[int]
    #: Of each state: the first place after it in each template that has it, by template.
    ends: list[dict[int, int]]
    #: Of each state: the templates that end in it or in a state it links to, which are whole suffixes of its factors.
    whole: list[tuple[int, ...]]
    sizes: tuple[int, ...]
    #: Pairs of consecutive words of the templates, first * (len(words) + 1) + second, in order.
    pairs: np.ndarray


def build_automaton(templates: list[list[bytes]]) -> Automaton:
    """The automaton of some templates, which should be few: it is sent to each worker."""
    numbers = {w: k + 1 for k, w in enumerate(sorted({w for t in templates for w in t}))}
    following, link, length = [{}], [-1], [0]

    def state(copy_of: int | None, size: int) -> int:
        following.append(dict(following[copy_of]) if copy_of is not None else {})
        link.append(link[copy_of] if copy_of is not None else 0)
        length.append(size)
        return len(length) - 1

    def extend(last: int, word: int) -> int:
        if word in following[last] and length[following[last][word]] == length[last] + 1:
            return following[last][word]
        new = None if word in following[last] else state(None, length[last] + 1)
        p = last
        while new is not None and p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p < 0:
            return new
        q = following[p][word]
        if length[q] > length[p] + 1:
            clone = state(q, length[p] + 1)
            link[q] = clone
            while p >= 0 and following[p].get(word) == q:
                following[p][word] = clone
                p = link[p]
            q = clone
        if new is None:
            return q
        link[new] = q
        return new

    coded = [[numbers[w] for w in t] for t in templates]
    for t in coded:
        last = 0
        for word in t:
            last = extend(last, word)
    ends: list[dict[int, int]] = [{} for _ in length]
    last_of: list[list[int]] = [[] for _ in length]
    for k, t in enumerate(coded):
        s = 0
        for at, word in enumerate(t):
            s = following[s][word]
            p = s
            while p > 0 and k not in ends[p]:
                ends[p][k] = at + 1
                p = link[p]
        if t:
            last_of[s].append(k)
    whole: list[tuple[int, ...]] = [()] * len(length)
    for s in sorted(range(1, len(length)), key=length.__getitem__):
        whole[s] = (*whole[link[s]], *last_of[s])
    base = len(numbers) + 1
    pairs = np.array(sorted({a * base + b for t in coded for a, b in zip(t, t[1:])}), np.int64)
    return Automaton(numbers, following, link, length, ends, whole, tuple(map(len, coded)), pairs)


def matching_statistics(automaton: Automaton, stretch: list[int]) -> Iterator[tuple[int, int]]:
    """(state, length) of the longest factor of the templates that ends at each word of a stretch."""
    following, link, length = automaton.following, automaton.link, automaton.length
    state = size = 0
    for word in stretch:
        while state and word not in following[state]:
            state = link[state]
            size = length[state]
        if word in following[state]:
            state = following[state][word]
            size += 1
        yield state, size


Match = tuple[int, int, int]
Span = tuple[int, int, int, int]


def chains(matches: list[Match], gap: int) -> list[Span]:
    """(first word, last word, words covered, matches) of chains of matches (first word, place in the template, words) of one template.

    A match joins the chain that ends nearest before it, in the text and in the template, with at
    most gap words between them in either; what overlaps counts once.
    """
    open_: list[list[int]] = []
    for first, place, n in sorted(matches):
        best = None
        for k in range(len(open_) - 1, -1, -1):
            c = open_[k]
            if first - c[1] > gap + 1:
                break
            overlap = max(0, c[1] + 1 - first, c[4] - place)
            if overlap < n and -overlap <= place - c[4] <= gap:
                best = k, overlap
                break
        if best:
            c, overlap = open_.pop(best[0]), best[1]
            c[1], c[2], c[3], c[4] = max(c[1], first + n - 1), c[2] + n - overlap, c[3] + 1, place + n
            open_.append(c)
        else:
            open_.append([first, first + n - 1, n, 1, place + n])
    return [(a, b, covered, k) for a, b, covered, k, _ in open_]


def scan_words(automaton: Automaton, numbers: np.ndarray, bounds: np.ndarray, least: int, gap: int) -> dict[int, tuple[list[tuple[int, int]], list[tuple[int, Span]]]]:
    """By text: (template, first word) of each whole template, and (template, span) of each chain of matches of at least `least` words.

    numbers are words' numbers, 0 for those that no template has, and bounds the texts' places in
    them.  Where two consecutive words aren't a pair of any template, no match of two words goes
    over them, so the automaton only reads stretches of such pairs.
    """
    base = len(automaton.words) + 1
    pair = numbers[:-1] * base + numbers[1:]
    k = np.minimum(np.searchsorted(automaton.pairs, pair), len(automaton.pairs) - 1)
    held = (automaton.pairs[k] == pair) if len(automaton.pairs) else np.zeros(len(pair), bool)
    inner = bounds[1:-1]
    held[inner[(inner > 0) & (inner < len(numbers))] - 1] = False
    singles = {t for t, size in enumerate(automaton.sizes) if size == 1}
    edge = np.diff(np.concatenate([[0], held.view(np.int8), [0]]))
    found: dict[int, tuple[list, dict[int, list[Match]]]] = {}
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    if singles:
        lone = np.flatnonzero((numbers > 0) & ~np.concatenate([held, [False]]) & ~np.concatenate([[False], held]))
        begins, ends = np.concatenate([begins, lone]), np.concatenate([ends, lone + 1])
    texts = np.searchsorted(bounds, begins, "right") - 1
    for begin, end, text in zip(begins.tolist(), ends.tolist(), texts.tolist()):
        whole, by_template = found.setdefault(text, ([], {}))
        at = begin - int(bounds[text])
        seen = list(matching_statistics(automaton, numbers[begin:end].tolist()))
        for i, (state, size) in enumerate(seen):
            for t in automaton.whole[state]:
                if automaton.sizes[t] <= size:
                    whole.append((t, at + i + 1 - automaton.sizes[t]))
            if size >= least and (i + 1 == len(seen) or seen[i + 1][1] != size + 1):
                for t, place in automaton.ends[state].items():
                    by_template.setdefault(t, []).append((at + i + 1 - size, place - size, size))
    return {text: (whole, [(t, c) for t, m in sorted(by_template.items()) for c in chains(m, gap)]) for text, (whole, by_template) in found.items()}


SPAN = "struct<label:string,first_word:long,last_word:long,covered:long,share:double>"


def scan_licenses(
    docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: int = 4, gap: int = 8, min_share: float = 0.6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, phrases, spans): the licence phrases and notices of each text.

    Terms are letters and digits of ASCII, A-Z lower-cased, and whatever is beyond ASCII.  phrases
    has (label, first_word) of each place where a phrase stands, by place; spans has each chain of
    matches of at least `least` terms with a notice, gap terms apart at most, with the share of the
    notice that it covers; from min_share on it is that notice.  All numbers of terms are from 0.

    Null and empty texts have no terms and nothing is found; repeated rows and null ids stay, each
    judged alone; other columns are left out; an empty table gives no rows.  Rows don't move; texts
    are streamed whole.  Templates are parameters, small enough to be sent to each worker.
    """
    mapped = lambda t: words_of(pa.array([t]), ALNUM).flat.to_pylist()
    labels = [label for _, label in phrases] + [label for label, _ in templates]
    automaton = build_automaton([mapped(p) for p, _ in phrases] + [mapped(t) for _, t in templates])
    shared, n_phrases = docs.sparkSession.sparkContext.broadcast(automaton), len(phrases)
    place_kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    span_kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in byte_slices(batches, 1, SLICE):
            words = words_of(batch.column(1), ALNUM)
            codes, distinct = words.coded()
            known = np.fromiter((automaton.words.get(w, 0) for w in distinct.to_pylist()), np.int64, len(distinct))
            found = scan_words(automaton, known[codes] if len(codes) else np.zeros(0, np.int64), words.bounds, least, gap)
            places, spans = [], []
            for k in range(batch.num_rows):
                whole, covered = found.get(k, ((), ()))
                places.append([{"label": labels[t], "first_word": at} for t, at in sorted(whole, key=lambda x: (x[1], x[0])) if t < n_phrases])
                new = [(labels[t], a, b, n, min(1.0, n / automaton.sizes[t])) for t, (a, b, n, _) in covered if t >= n_phrases]
                spans.append([dict(zip(("label", "first_word", "last_word", "covered", "share"), s)) for s in sorted(new, key=lambda s: s[1:3]) if s[4] >= min_share])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.bounds)), pa.array(places, place_kind), pa.array(spans, span_kind)], names=["doc_id", "n_words", "phrases", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(scan), f"doc_id long, n_words long, phrases array<struct<label:string,first_word:long>>, spans array<{SPAN}>")


def license_rows(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    score is 1 with a phrase, else the largest share of a notice that is covered, else 0; without a
    phrase first_word and last_word are null and base_labels is empty; cases are scan_licenses's.
    """
    found = scan_licenses(docs, **options)
    base, notices = F.col("phrases.label"), F.col("spans.label")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.first_word").alias("first_word"), F.array_max("phrases.first_word").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, notices)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))).alias("score"),
    )
