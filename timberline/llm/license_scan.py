"""License scans: an exact set-similarity join of text blocks against licence templates, in native functions only.

Blocks are runs of BLOCK words that start at every STEP-th word of a text, across line ends, so any stretch of
BLOCK - STEP + 1 words, longer than any template, lies in one block whole. Tokens are ordered by how many texts of the
corpus hold them, rarest first. A block contains a template when at least ceil(threshold * |template|) of the
template's distinct tokens stand in it (the overlap o) and, for templates that differ in a word or two, the phrase that
tells them apart. Such a pair must share a token within the first |template| - o + 1 tokens of the template and the
first |block| - o + 1 of the block. The first are an inverted index from token to (template, place, tokens behind it);
each block looks up its own first tokens there. A pair found passes the length filter if |block| >= o, and the
positional filter if the shared token and what stands behind it on either side can reach o. Only pairs that pass are
intersected. The filters lose nothing; frequencies change only how many pairs are intersected, never the result.

The templates are a fixed small list, so the inverted index travels inside the plan as a literal and no text is
shuffled. Defined cases: null or empty text has no words, no labels and score 0; very long texts are handled whole;
repeated rows each give a row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEPARATORS, UPPER

#: Base phrases and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates and the labels that this method adds. Fixed values.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

#: What a block must hold word by word, too, for templates that are near to another. Fixed values.
TELLING = {"cc-by-4.0": "by 4", "cc-by-nc-4.0": "by nc", "cc-by-sa-4.0": "by sa"}

THRESHOLD, BLOCK, STEP = 0.8, 64, 32


def spaced(text: Column) -> Column:
    """Words of a text, lower-cased, with two spaces on either side of each: places of a phrase never share a space."""
    core = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, "  "))
    return F.concat(F.lit("  "), core, F.lit("  "))


def _pairs_of_spaces(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit("  "), F.lit("")))) / 2).cast("long")


def token_frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> dict[str, int]:
    """Texts that hold each template token; at most one row per token of the templates reaches the driver."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    words = F.split(F.trim(spaced(F.col("text"))), "  ")
    held = F.array_intersect(words, F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["token"]: r["count"] for r in rows}


def _index(templates: dict[str, str], order: dict[str, int], threshold: float) -> tuple[Column, Column, list[str]]:
    """The templates; from each token of their prefixes, the numbers (from 1) of templates and how many of their tokens
    stand from there on; and those tokens."""
    entries, lists = [], {}
    for name, text in sorted(templates.items()):
        tokens = sorted(set(text.split()), key=lambda w: order[w])
        need = math.ceil(threshold * len(tokens) - 1e-9)
        entries.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(need).alias("need"),
                F.array(*map(F.lit, tokens)).alias("tokens"),
                F.lit(f" {TELLING[name]} " if name in TELLING else "").alias("telling"),
            )
        )
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            lists.setdefault(token, []).append((len(entries), len(tokens) - place, need))
    found = [F.struct(F.lit(w).alias("token"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(left).alias("left"), F.lit(need).alias("need")) for t, left, need in rows]).alias("in")) for w, rows in sorted(lists.items())]
    return F.array(*entries), F.map_from_entries(F.array(*found)), sorted(lists)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, frequencies: dict[str, int] | None = None
) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, places of base phrases, labels, score and matches (name, containment)."""
    frequencies = token_frequencies(docs, templates) if frequencies is None else frequencies
    ranked = sorted(frequencies, key=lambda w: (frequencies[w], w))
    order = {w: i for i, w in enumerate(ranked)}
    entries, index, rare = _index(templates, order, threshold)
    vocabulary, first_tokens = F.array(*map(F.lit, ranked)), F.array(*map(F.lit, rare))

    base = docs.select("doc_id", spaced(F.col("text")).alias("s"))
    core = F.trim("s")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        p = " " + phrase.replace(" ", "  ") + " "
        here = F.contains("s", F.lit(p))
        before = lambda at: _pairs_of_spaces(F.substring("s", F.lit(1), at - 1))
        counts.append(F.when(here, ((F.length("s") - F.length(F.replace(F.col("s"), F.lit(p), F.lit("")))) / len(p)).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(here, before(F.locate(p, F.col("s")))))
        lasts.append(F.when(here, before(F.length("s") - F.locate(p[::-1], F.reverse("s")) + 2 - len(p))))
        labels.append(F.when(here, F.lit(label)))

    def candidates(b: Column) -> Column:
        looked_up = F.transform(F.array_intersect(b, first_tokens), lambda w: F.struct((F.array_position(b, w)).cast("int").alias("at"), F.element_at(index, w).alias("in")))
        fit = lambda at, e: (
            (F.size(b) >= e["need"])  # length
            & (at <= F.size(b) - e["need"] + 1)  # the block's prefix
            & (F.least(F.size(b) - at + 1, e["left"]) >= e["need"])  # position
        )
        return F.array_distinct(F.flatten(F.transform(looked_up, lambda x: F.transform(F.filter(x["in"], lambda e: fit(x["at"], e)), lambda e: e["t"]))))

    def found(x: Column) -> Column:
        pairs = F.transform(candidates(x["b"]), lambda t: F.element_at(entries, t))
        whole = F.filter(pairs, lambda t: (F.size(F.array_intersect(x["b"], t["tokens"])) >= t["need"]) & F.contains(x["says"], t["telling"]))
        return F.transform(whole, lambda t: F.struct(t["name"].alias("name"), (F.size(F.array_intersect(x["b"], t["tokens"])) / F.size(t["tokens"])).alias("containment")))

    def matches_in(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / STEP).cast("int"))
        # A block's tokens in the order of all, and its words as a phrase.
        one = lambda w: F.struct(F.array_intersect(vocabulary, w).alias("b"), F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")).alias("says"))
        blocks = F.filter(F.transform(starts, lambda i: F.slice(words, i * STEP + 1, F.lit(BLOCK))), lambda w: F.arrays_overlap(w, first_tokens))
        all_found = F.array_distinct(F.flatten(F.transform(F.transform(blocks, one), found)))
        return F.when(F.arrays_overlap(words, first_tokens), all_found).otherwise(F.array().cast("array<struct<name:string,containment:double>>"))

    # Bound by a lambda, the words are split once, not for every use.
    matches = F.transform(F.array(F.split(core, "  ")), matches_in)[0]
    n_words = F.when(core == "", F.lit(0).cast("long")).otherwise(_pairs_of_spaces(core) + 1)
    own = base.select(
        "doc_id",
        n_words.alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        matches.alias("matches"),
    )
    return own.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.col("matches")["name"]))), ",").alias("labels"),
        F.when(F.size("matches") > 0, F.array_max(F.col("matches")["containment"])).otherwise(F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
        "matches",
    )
