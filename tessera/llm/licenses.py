"""License scans with a generalised suffix automaton of licence words.

The words of all templates go into one automaton. A text is streamed through it once: at each word it gives the length
of the longest match that ends there (the matching statistics). Where a match cannot go on and is long enough, it is
laid on the templates that hold it; matches that stand in order in text and template, with small gaps, are chained, and
a template of which a chain covers enough words is found in the span of the chain. Short fixed phrases are templates
too, and count at every place where they stand.

Inputs: null and empty texts have no words and no labels; repeated rows are scanned each; an empty table gives an empty
one; only the key and the text column are read, so further columns never clash. Long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.llm import common
from tessera.llm.decontaminate import words_of

#: Words that a match needs, words that may stand between two chained matches, and the part of a template to be covered.
LEAST, GAP, COVERED = 3, 6, 0.75
#: Phrase -> label: fixed values of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label -> notices by which the licences ask to be named: fixed values, from their public texts.
NOTICES = {
    "agpl": ["gnu affero general public license version 3"],
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


class Automaton:
    """A generalised suffix automaton over word sequences; each state knows where its strings end in the templates."""

    def __init__(self, templates: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((t, at + 1))
        # A state's strings also end wherever those of the states that link to it do.
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]].extend(self.ends[v])
        self.ends = [sorted(set(e)) for e in self.ends]
        self.words = frozenset(w for words in templates for w in words)

    def _state(self, size: int, following: dict[bytes, int], link: int) -> int:
        self.size.append(size)
        self.next.append(following)
        self.link.append(link)
        self.ends.append([])
        return len(self.size) - 1

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, word, q)
        cur = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy


class Scanner:
    """Scans texts in one worker."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES, least: int = LEAST, gap: int = GAP, covered: float = COVERED):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.notices = [(n.encode().split(), label) for label, ns in notices.items() for n in ns]
        self.least, self.gap, self.covered = least, gap, covered
        self.automaton = a = Automaton([w for w, _ in self.phrases + self.notices])
        # Phrases that end wherever a state's match does, if the match is as long.
        n = len(self.phrases)
        whole = [sorted({(t, len(self.phrases[t][0])) for t, end in ends if t < n and end == len(self.phrases[t][0])}) for ends in a.ends]
        self.ended: list[list[tuple[int, int]]] = []
        for v in range(len(a.size)):
            found, u = set(), v
            while u > 0:
                shortest = a.size[a.link[u]]
                found.update((t, size) for t, size in whole[u] if shortest < size <= a.size[u])
                u = a.link[u]
            self.ended.append(sorted(found))

    def statistics(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(place, state, length of the longest match that ends there), where there is one."""
        a = self.automaton
        following, link, size = a.next, a.link, a.size
        out, v, length, last = [], 0, 0, -2
        known = a.words
        for i in [i for i, w in enumerate(words) if w in known]:
            if i != last + 1:
                v = length = 0
            last, w = i, words[i]
            while v and w not in following[v]:
                v = link[v]
                length = size[v]
            v = following[v].get(w, 0)
            length = length + 1 if v else 0
            out.append((i, v, length))
        return out

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """How many words; (start, phrase) of each phrase; (label, start, end, part covered) of each template found."""
        words = words_of(text)
        stats = self.statistics(words)
        base: list[tuple[int, int]] = []
        hits: dict[int, list[tuple[int, int, int]]] = {}  # template -> (start, end, end in the template)
        first = len(self.phrases)
        for k, (i, v, length) in enumerate(stats):
            for t, size in self.ended[v]:
                if size <= length:
                    base.append((i - size + 1, t))
            if length >= self.least and not (k + 1 < len(stats) and stats[k + 1][0] == i + 1 and stats[k + 1][2] == length + 1):
                for t, end in self.automaton.ends[v]:
                    if t >= first:
                        hits.setdefault(t - first, []).append((i + 1 - length, i + 1, end))
        found = [x for t, own in hits.items() for x in self._chains(t, own)]
        return len(words), base, sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def _chains(self, t: int, hits: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        words, label = self.notices[t]
        out, chain, held = [], None, 0

        def close():
            if chain is not None and held / len(words) >= self.covered:
                out.append((label, chain[0], chain[1], held / len(words)))

        for start, end, place in sorted(hits):
            size = end - start
            if chain is not None and start <= chain[1] + self.gap and place > chain[2] and end > chain[1]:
                new = min(size, end - chain[1], place - chain[2])  # words that neither text nor template had in the chain
                chain, held = (chain[0], end, place), held + new
            elif chain is None or size >= held:
                close()
                chain, held = (start, end, place), size
            elif start > chain[1] + self.gap:
                close()
                chain, held = (start, end, place), size
        close()
        return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", whole: bool = False, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score) of each row; with `whole`, `row` instead of doc_id.

    spans: label:start:end in words, with commas, of the templates found; score: the largest part of a template that is
    covered, 1 for a phrase.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(**options))

    def work():
        scanner = shared.value

        def each(texts: list[bytes | None]) -> list[list]:
            out: list[list] = [[] for _ in range(8)]
            for t in texts:
                n, base, found = scanner.scan(t)
                own = {scanner.phrases[p][1] for _, p in base}
                starts = [s for s, _ in base]
                row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in found})), ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found), 1.0 if base else max((x[3] for x in found), default=0.0))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return each

    return common.annotate(docs, text, key, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans string, score double", work, whole, as_bytes=True)
