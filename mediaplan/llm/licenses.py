"""License scans by an exact set-similarity join of text blocks with templates.

Blocks are sentences of a document, however they are wrapped over lines, and single lines; templates are
the sentences of license texts. Tokens
are ordered by how many documents of the whole corpus have them, the rarest first. A
template's prefix are its rarest tokens such that a block without any of them cannot contain enough
of the template; only blocks with a prefix token are looked at. Length and positional filters
follow, then the sets are compared in full, so every block that meets the threshold is found."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import free_name, utf8, with_fields, words

THRESHOLD = 0.8
#: Templates are broadcast to tasks; more text than this is refused.
MOST_TEMPLATE_CHARS = 16_000_000
_BREAK = rb"(?:\r\n|\n|\r(?!\n))"
_LINE_END = re.compile(_BREAK)
#: The end of a sentence, or a blank line; a single line break may stand inside a sentence.
_BLOCK_END = re.compile(rb"[.!?;](?=[ \t\r\n\x0b\x0c])|" + _BREAK + rb"[ \t\x0b\x0c]*" + _BREAK)

# fixed values: phrases with their labels
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# fixed values: sentences of public licenses and usual notices, with their labels
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    ("apache-2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def token_frequencies(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given tokens occurs."""

    def count(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column("_body").to_pylist():
                for token in tokens.intersection(words(text)):
                    seen[token] = seen.get(token, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    sums = docs.select(utf8().alias("_body")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in sums.collect()}  # a row a template token


class Templates:
    """Templates as ordered token sets with an index over their prefixes."""

    def __init__(self, texts: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float):
        tokens = {w for _, text in texts for w in words(text.encode())}
        self.rank = {w: i for i, w in enumerate(sorted(tokens, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for label, _ in texts]
        self.sets = [sorted({self.rank[w] for w in words(text.encode())}) for _, text in texts]
        self.least = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (own, least) in enumerate(zip(self.sets, self.least)):
            for at, token in enumerate(own[:len(own) - least + 1]):
                self.prefix.setdefault(token, []).append((t, at))
        self.prefix_words = {w for w, i in self.rank.items() if i in self.prefix}

    def covered(self, block: list[bytes], found: dict[int, float]) -> set[int]:
        """Templates of which a better one holds all the words that the block has of them."""
        have = {self.rank[w] for w in block if w in self.rank}
        held = {t: have.intersection(self.sets[t]) for t in found}
        return {t for t in found if any(found[o] > found[t] and held[t] <= held[o] for o in found)}

    def matches(self, block: list[bytes]) -> dict[int, float]:
        """Templates that the block contains, and how much of each."""
        own = sorted({self.rank[w] for w in block if w in self.rank})
        tried, found, have = set(), {}, set(own)
        for place, token in enumerate(own):
            for t, at in self.prefix.get(token, ()):
                if t in tried or len(own) < self.least[t]:  # length filter
                    continue
                tried.add(t)
                # positional filter: the first common token leaves this much at most
                if 1 + min(len(self.sets[t]) - at - 1, len(own) - place - 1) < self.least[t]:
                    continue
                common = sum(x in have for x in self.sets[t])
                if common >= self.least[t]:
                    found[t] = common / len(self.sets[t])
        return found


def phrase_places(found: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    places = []
    for own, label in phrases:
        at = -1
        while True:
            try:
                at = found.index(own[0], at + 1)
            except ValueError:
                break
            if found[at:at + len(own)] == own:
                places.append((at, label))
    return places


def block_matches(text: bytes, index: Templates):
    """(first word, words, matches, the largest of them) of every block that matches."""
    for word, size, found, _ in judged_blocks(text, index):
        yield word, size, found, max(found.values())


def judged_blocks(text: bytes, index: Templates):
    """(first word, words, matches, those of them that a better one covers) of every block that matches.

    A sentence holds what its lines hold. Templates that a line holds are given with that line, the others
    with the whole sentence."""
    before = 0
    for sentence in _BLOCK_END.split(text):
        inside = words(sentence)
        found = index.matches(inside)
        if found:
            lines = [own for own in map(words, _LINE_END.split(sentence)) if own]
            rest, at = dict(found), before
            for own in lines if len(lines) > 1 else ():
                alone = index.matches(own)
                if alone:
                    yield at, len(own), alone, index.covered(own, alone)
                    for t in alone:
                        rest.pop(t, None)
                at += len(own)
            if rest:
                yield before, len(inside), rest, index.covered(inside, found)
        before += len(inside)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None,
                  threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``), then n_words, places (first word and label
    of each phrase) and blocks (first word, words, label and containment of each template that a block matches; ``best``
    unless another template, matched better, holds all the words that the block has of this one).

    Null and empty texts have no words and nothing found; repeated rows are scanned one by one; ties
    of containment give all labels; own columns with the new names are replaced."""
    texts = TEMPLATES if templates is None else templates
    texts = [(label, text) for label, text in texts if words(text.encode())]
    if sum(len(t) for _, t in texts) > MOST_TEMPLATE_CHARS:
        raise ValueError("templates are too large to hand to every task")
    frequency = token_frequencies(docs, {w for _, t in texts for w in words(t.encode())})
    shared = docs.sparkSession.sparkContext.broadcast(Templates(texts, frequency, threshold))
    wanted = [(words(p.encode()), label) for p, label in (PHRASES if phrases is None else phrases)]
    added = ("n_words long, places array<struct<word:long,label:string>>, "
             "blocks array<struct<word:long,words:long,label:string,containment:double,best:boolean>>")
    out = docs.drop("n_words", "places", "blocks")
    plain = [c for c in out.columns if c != "text" or keep_text]
    body = free_name(out, "_body")
    out = out.select(*[F.col(f"`{c}`") for c in plain], utf8().alias(body))

    def scan(batches):
        index = shared.value
        openers = {p[0] for p, _ in wanted}
        for batch in batches:
            n, places, blocks = [], [], []
            for text in batch.column(body).to_pylist():
                found = words(text)
                n.append(len(found))
                have = set(found)
                hits = phrase_places(found, wanted) if not openers.isdisjoint(have) else []
                places.append([{"word": w, "label": label} for w, label in sorted(hits)])
                own = []
                if not index.prefix_words.isdisjoint(have):
                    for word, size, found_here, covered in judged_blocks(text, index):
                        for t, part in found_here.items():
                            own.append({"word": word, "words": size, "label": index.labels[t], "containment": part, "best": t not in covered})
                blocks.append(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(plain)], pa.array(n, pa.int64()),
                 pa.array(places, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                 pa.array(blocks, pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("containment", pa.float64()), ("best", pa.bool_())])))],
                [*plain, "n_words", "places", "blocks"])

    return out.mapInArrow(scan, with_fields(out.drop(body), added))
