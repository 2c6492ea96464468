"""License notices by exact set similarity: every text block that holds enough of a template's words.

Words of all templates get one global order, rarest in the corpus first. A block which holds the fraction t of a
template's n words holds one of its first n - ceil(t n) + 1 words in that order (prefix filter), has ceil(t n) distinct
words at least (length filter), and from its first shared word on both sides still have as many (positional filter).
What is left is counted exactly. Phrases are templates of which all words must be there, and in a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordcodes as wc
from glyphmill.llm.scratch import small_batches

CONTAINMENT = 0.85
#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices of public licenses and their labels. Those of more than LONG distinct words are sought in paragraphs, others in
#: lines and in runs of neighbouring lines.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
LONG = 16
#: In a run of lines a template's words stand within so many times its own length: scattered over a page they are no notice.
STRETCH = 2


class _Words:
    """The words of all templates and phrases."""

    def __init__(self, phrases, templates):
        own = sorted({w for text, _ in (*phrases, *templates) for w in text.split()})
        codes, bounds = wc.word_codes(pa.array(own), wc.LETTERS_DIGITS)
        assert len(codes) == len(own), "templates are lower-case words of letters and digits"
        order = np.argsort(codes)
        self.codes, self.words = codes[order], [own[i] for i in order]
        self.at = {w: i for i, w in enumerate(self.words)}
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.codes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words of ours stand, and which."""
        at = np.flatnonzero(self.mask[(codes & np.uint64(0xFFFF)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[i] == codes[at]
        return at[hit], i[hit]


def _count(words: _Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words.words), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                codes, bounds = wc.word_codes(batch["text"].slice(at, 2048), wc.LETTERS_DIGITS)
                place, which = words.find(codes)
                doc = np.searchsorted(bounds, place, "right")
                total += np.bincount(np.unique(doc * len(words.words) + which) % len(words.words), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["word", "n"])

    return run


class _Matcher:
    def __init__(self, words: _Words, counts: np.ndarray, phrases, templates, containment: float):
        self.words = words
        order = np.lexsort((np.arange(len(counts)), counts))
        self.rank = np.empty(len(counts), np.int64)
        self.rank[order] = np.arange(len(counts))
        self.phrases = []
        for text, label in phrases:
            seq = np.array([words.at[w] for w in text.split()])
            first = int(np.argmin(self.rank[seq]))
            self.phrases.append((seq, first, label))
        self.templates = []
        for text, label in templates:
            ranks = np.unique(self.rank[[words.at[w] for w in text.split()]])
            need = math.ceil(containment * len(ranks) - 1e-9)
            self.templates.append((ranks, need, label))
        self.lengths = [len(text.split()) for text, _ in templates]

    def places(self, codes: np.ndarray, bounds: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of phrases, and which: the rarest word's places, then the words around them."""
        ends = bounds[1:]
        starts, names = [], []
        for p, (seq, first, _) in enumerate(self.phrases):
            s = at[which == seq[first]] - first
            if not len(s):
                continue
            doc = np.searchsorted(bounds, s + first, "right") - 1
            s = s[(s >= bounds[doc]) & (s + len(seq) <= ends[doc])]
            for k, w in enumerate(seq):
                s = s[codes[s + k] == self.words.codes[w]]
            starts.append(s)
            names.append(np.full(len(s), p))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(names)

    def blocks(self, edges: np.ndarray, at: np.ndarray, which: np.ndarray, distinct: np.ndarray, long: bool) -> Iterator[tuple[int, int, float]]:
        """(block, template, containment) of all blocks that hold enough; edges: where each block's words begin."""
        block = np.searchsorted(edges, at, "right") - 1
        key = np.unique(block * len(self.rank) + self.rank[which])
        block, rank = key // len(self.rank), key % len(self.rank)  # by block, rarest first
        for t, (ranks, need, _) in enumerate(self.templates):
            if (len(ranks) > LONG) != long:
                continue
            prefix = ranks[: len(ranks) - need + 1]
            hit = np.flatnonzero(np.isin(rank, prefix))
            hit = hit[np.concatenate([[True], block[hit][1:] != block[hit][:-1]])] if len(hit) else hit
            end = np.searchsorted(block, block[hit], "right")
            left = np.minimum(len(ranks) - np.searchsorted(ranks, rank[hit]), end - hit)
            for h, e in zip(hit[(left >= need) & (distinct[block[hit]] >= need)].tolist(), end[(left >= need) & (distinct[block[hit]] >= need)].tolist()):
                both = int(np.isin(rank[h:e], ranks).sum())
                if both >= need:
                    yield int(block[h]), t, both / len(ranks)

    def runs(self, lines: np.ndarray, paragraphs: np.ndarray, end: int, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(first word, end, template, containment) of all shortest runs of two neighbouring lines or more of a paragraph that hold enough.

        lines, paragraphs: where the words of each begin; end: where those of the last end. Runs that hold a line
        or a shorter run which holds enough are left out. Enough words stand within STRETCH times the template's length.
        """
        of_line, of_paragraph = np.searchsorted(lines, at, "right") - 1, np.searchsorted(paragraphs, at, "right") - 1
        edges = np.append(lines, end)
        rank_at = self.rank[which]
        for t, (ranks, need, _) in enumerate(self.templates):
            if len(ranks) > LONG:
                continue
            own = np.flatnonzero(np.isin(rank_at, ranks))
            place, rank, line, paragraph = at[own], rank_at[own], of_line[own], of_paragraph[own]
            reach = STRETCH * self.lengths[t]
            # the prefix filter, and the length filter on what is near
            hit = np.flatnonzero(np.isin(rank, ranks[: len(ranks) - need + 1]))
            low = np.maximum(np.searchsorted(place, place[hit] - reach, "right"), np.searchsorted(paragraph, paragraph[hit]))
            high = np.minimum(np.searchsorted(place, place[hit] + reach), np.searchsorted(paragraph, paragraph[hit], "right"))
            near = (high - low >= need) & (line[low] != line[high - 1]) if len(hit) else np.zeros(0, bool)
            found: set[tuple[int, int]] = set()
            stretches: list[list[int]] = []
            for l, h in zip(low[near].tolist(), high[near].tolist()):
                if stretches and l < stretches[-1][1]:
                    stretches[-1][1] = max(h, stretches[-1][1])
                else:
                    stretches.append([l, h])
            for l, h in stretches:
                seen: dict[int, int] = {}
                i = l
                for j, k in enumerate(rank[l:h].tolist(), l):
                    seen[k] = seen.get(k, 0) + 1
                    while place[j] - place[i] >= reach or seen[rank[i]] > 1 or len(seen) > need:
                        seen[rank[i]] -= 1
                        if not seen[rank[i]]:
                            del seen[rank[i]]
                        i += 1
                    if len(seen) >= need:
                        found.add((int(line[i]), int(line[j])))
            if not found:
                continue
            full, n = np.unique(np.unique(line * len(self.rank) + rank) // len(self.rank), return_counts=True)
            found |= {(a, a) for a in full[n >= need].tolist()}
            least: list[tuple[int, int]] = []
            for a, b in sorted(found, key=lambda r: (r[1], -r[0])):  # by their ends, the shorter first
                if not least or a > least[-1][0]:
                    least.append((a, b))
            for a, b in least:
                if a < b:
                    inside = rank[np.searchsorted(line, a) : np.searchsorted(line, b, "right")]
                    yield int(edges[a]), int(edges[b + 1]), t, len(np.unique(inside)) / len(ranks)


def _line_edges(texts: pa.Array, starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the lines, and of the paragraphs, of all texts."""
    data, off = wc.text_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    lines = np.unique(np.concatenate([bounds[:-1], np.searchsorted(starts, breaks)]))
    # a break is blank if there is only space between it and the one before
    dark = np.concatenate([[0], np.cumsum(wc.NOT_SPACE[data])])
    blank = breaks[1:][dark[breaks[1:]] == dark[breaks[:-1]]]
    return lines, np.unique(np.concatenate([bounds[:-1], np.searchsorted(starts, blank)]))


def _scan(matcher: _Matcher):
    span = [pa.field("start", pa.int64()), pa.field("end", pa.int64()), pa.field("label", pa.string()), pa.field("containment", pa.float64()), pa.field("phrase", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut_at in range(0, batch.num_rows, 2048):
                part = batch.slice(cut_at, 2048)
                codes, bounds, starts, _ = wc.word_codes(part["text"], wc.LETTERS_DIGITS, places=True)
                at, which = matcher.words.find(codes)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                s, names = matcher.places(codes, bounds, at, which)
                for place, p in sorted(zip(s.tolist(), names.tolist())):
                    d = int(np.searchsorted(bounds, place, "right")) - 1
                    seq, _, label = matcher.phrases[p]
                    found[d].append({"start": place - int(bounds[d]), "end": place - int(bounds[d]) + len(seq), "label": label, "containment": 1.0, "phrase": True})
                if len(at):
                    lines, paragraphs = _line_edges(part["text"], starts, bounds)
                    for begin, stop, t, c in matcher.runs(lines, paragraphs, len(codes), at, which):
                        d = int(np.searchsorted(bounds, begin, "right")) - 1
                        found[d].append({"start": int(begin - bounds[d]), "end": int(stop - bounds[d]), "label": matcher.templates[t][2], "containment": c, "phrase": False})
                    for edges, long in ((lines, False), (paragraphs, True)):
                        ends = np.append(edges[1:], len(codes))
                        for b, t, c in matcher.blocks(edges, at, which, ends - edges, long):
                            d = int(np.searchsorted(bounds, edges[b], "right")) - 1
                            found[d].append({"start": int(edges[b] - bounds[d]), "end": int(ends[b] - bounds[d]), "label": matcher.templates[t][2], "containment": c, "phrase": False})
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(bounds)), pa.array(found, pa.list_(pa.struct(span)))], ["id", "n_words", "found"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(id, n_words, found) for every row of docs; found lists the places of phrases and the blocks that hold a template.

    A place or block has its first and end word, a label, the containment reached and whether it is a phrase. Blocks
    are lines and shortest runs of neighbouring lines, for templates of more than LONG words paragraphs. Lines that say the same are each listed. Null and
    empty texts have no words and nothing found; repeated rows are scanned each; other columns are not read.
    """
    small_batches(docs.sparkSession)
    words = _Words(phrases, templates)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    counted = own.select("text").mapInArrow(_count(words), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per template word
    counts = np.zeros(len(words.words), np.int64)
    for r in counted:
        counts[r["word"]] = r["n"]
    matcher = _Matcher(words, counts, phrases, templates, containment)
    schema = f"id {id_type}, n_words bigint, found array<struct<start: bigint, end: bigint, label: string, containment: double, phrase: boolean>>"
    return own.mapInArrow(_scan(matcher), schema).withColumnRenamed("id", id_col)


def op10(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda x: x["phrase"])
    start = F.transform(base, lambda x: x["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)).alias("score"),
    )
