"""License scans: an exact set-similarity join of text blocks with license templates.

A block (a line, and each run of lines between blank ones) matches a template when it contains at
least `threshold` of the template's distinct words. Tokens are ordered by their frequency over all
documents, rarest first. A block that shares none of a template's first |T| - need + 1 tokens
(its prefix) cannot reach need = ceil(threshold * |T|) and is never looked at; a block with fewer
than need distinct words goes by length; and while the tokens are merged in order, a pair whose
matched count plus what remains on either side falls short of need is dropped by position. The
filters lose nothing: what is left is verified by the merge itself.

The templates are a fixed, small set, so their prefix index travels to the rows; texts move nowhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import documents, release

#: Phrases whose every occurrence is listed, whatever the blocks.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices that projects put on their texts, and paragraphs of the licenses; (label, words). The licenses' own public wording.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("artistic", "This is free software; you can redistribute it under the terms of the Artistic License"),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without prior written permission"),
)
THRESHOLD = 0.9

#: Upper to lower case for A-Z; every ASCII byte that is no letter or digit becomes a space, but the line feed stays.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() or i == 10 else 32 for i in range(256))


def fold(text: str) -> bytes:
    """The text's words, parted by white space; lines stay lines."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def blocks(folded: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of each line, then of each run of two lines or more."""
    at, run, began, many = 0, [], 0, 0
    for line in folded.split(b"\n"):
        words = line.split()
        if words:
            yield at, words
            if not run:
                began = at
            run += words
            many += 1
            at += len(words)
        else:
            if many > 1:
                yield began, run
            run, many = [], 0
    if many > 1:
        yield began, run


class Index:
    """Templates by the tokens of their prefixes, under one global token order."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        sets = [(label, set(fold(text).split())) for label, text in templates]
        tokens = sorted(set().union(*(s for _, s in sets)), key=lambda t: (frequency.get(t, 0), t)) if sets else []
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.templates, self.prefix = [], {}
        for k, (label, s) in enumerate(sets):
            ranks = sorted(self.rank[t] for t in s)
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.templates.append((label, ranks, need))
            for t in ranks[: len(ranks) - need + 1]:
                self.prefix.setdefault(t, []).append(k)
        self.first = frozenset(t for t, i in self.rank.items() if i in self.prefix)

    def match(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of each template that the block contains."""
        distinct = set(words)
        own = sorted(self.rank[w] for w in distinct if w in self.rank)
        found = []
        for k in dict.fromkeys(k for r in own if r in self.prefix for k in self.prefix[r]):
            _, ranks, need = self.templates[k]
            if len(distinct) < need:  # length
                continue
            i = j = hits = 0
            while i < len(ranks) and j < len(own):
                if hits + min(len(ranks) - i, len(own) - j) < need:  # position
                    break
                if ranks[i] == own[j]:
                    hits, i, j = hits + 1, i + 1, j + 1
                elif ranks[i] < own[j]:
                    i += 1
                else:
                    j += 1
            if hits >= need:
                found.append((k, hits / len(ranks)))
        return found


def places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start in words, label) wherever a phrase's words stand consecutively, overlaps included."""
    found = []
    for phrase, label in phrases.items():
        p = phrase.encode().split()
        last, at = p[-1], -1
        if last not in words:
            continue
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            if at + 1 >= len(p) and words[at + 1 - len(p) : at + 1] == p:
                found.append((at + 1 - len(p), label))
    return sorted(found)


_FOUND = "places array<struct<start:long,label:string>>, matches array<struct<start:long,n_words:long,template:int,label:string,containment:double>>"


def token_frequency(df: DataFrame, text_col: str, templates) -> dict[bytes, int]:
    """In how many rows each template token stands, over all rows: as many entries as tokens."""
    wanted = frozenset().union(*(fold(t).split() for _, t in templates)) if templates else frozenset()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    n.update(wanted.intersection(fold(t).split()))
        yield pa.RecordBatch.from_arrays([pa.array([*n], type=pa.binary()), pa.array([*n.values()], type=pa.int64())], names=["token", "n"])

    rows = df.select(text_col).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, places, matches), one row per row; a null text counts as empty. Rows that share an id
    keep their own places; other columns play no part.

    places: every occurrence of a phrase, from its first word. matches: every (block, template) at
    or over the threshold, a block being its first word's place and its length in words.
    """
    index = Index(templates, token_frequency(df, text_col, templates), threshold)
    heads = {p.encode().split()[-1] for p in phrases}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, at, matched = [], [], []
            for t in b.column(1).to_pylist():
                f = fold(t or "")
                words = f.split()
                seen = set(words)
                n_words.append(len(words))
                at.append([{"start": s, "label": x} for s, x in places(words, phrases)] if heads & seen else [])
                rows = []
                if not index.first.isdisjoint(seen):
                    for start, block in blocks(f):
                        if not index.first.isdisjoint(block):
                            rows += [{"start": start, "n_words": len(block), "template": k, "label": index.templates[k][0], "containment": c} for k, c in index.match(block)]
                matched.append(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n_words, type=pa.int64()), pa.array(at, type=pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                    pa.array(matched, type=pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))),
                ],
                names=["id", "n_words", "places", "matches"],
            )
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_words long, {_FOUND}")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """score: the largest containment of a matched template; 1 where a phrase stands; else 0."""
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, more = F.transform("places", lambda p: p["label"]), F.transform("matches", lambda m: m["label"])
    starts = F.transform("places", lambda p: p["start"])
    return scan(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
