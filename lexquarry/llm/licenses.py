"""License scans, in DataFrame expressions alone.

Fixed phrases are counted in whole texts. Beyond them, an exact set-similarity join finds every line that holds at
least CONTAINED of the distinct words of a template. The templates' words are ordered by how many documents hold
them, rarest first; a line that holds `need` words of a template of n holds one of its n - need + 1 rarest (prefix
filter), has at least `need` words of the vocabulary (length filter), and from a common word on can't have more common
words than either list has left (positional filter). What passes is counted exactly.

The templates are parameters of this module, so their words and prefixes, a few hundred at most, may be broadcast.

Cases: null counts as empty: no words, no labels, score 0. Rows of the same doc_id and text fare alike.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
CONTAINED = 0.8
#: (label, template). Templates are lines as they are used in notices.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
)


def words_of(text: str) -> list[str]:
    """Words as the Spark expression `_plain` gives them."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _plain(text: str) -> str:
    """SQL for the words of a text, lower case, each with a blank before it, and a blank at the end; '' if none."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_replace(concat(' ', {low}, ' '), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', ' ')"


def _blanks(s: str) -> str:
    return f"(length({s}) - length(replace({s}, ' ', '')))"


def phrases(docs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """docs(doc_id, text) as (doc_id, hash, n_words, n_base, first_word, last_word, base)."""
    d = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as hash", f"{_plain('text')} as plain")
    # '(?= )' leaves the blank for the next place, so places that touch all count
    count = lambda p: f"if(contains(plain, ' {p} '), regexp_count(plain, ' {re.escape(p).replace(chr(92), chr(92) * 2)}(?= )'), 0)"
    first = lambda p: f"if(contains(plain, ' {p} '), {_blanks(f'substr(plain, 1, locate(' + chr(39) + f' {p} ' + chr(39) + ', plain))')} - 1, null)"
    last = lambda p: f"if(contains(plain, ' {p} '), {_blanks('plain')} - {_blanks(f'substr(reverse(plain), 1, locate(reverse(' + chr(39) + f' {p} ' + chr(39) + f'), reverse(plain)) + {len(p) + 1})')}, null)"
    some = list(wanted)
    over = lambda f, fold: f"cast({fold}({', '.join(map(f, some))}) as bigint)" if len(some) > 1 else f"cast({f(some[0])} as bigint)"
    return d.selectExpr(
        "doc_id", "hash", f"cast(greatest({_blanks('plain')} - 1, 0) as bigint) as n_words",
        "cast(" + " + ".join(map(count, some)) + " as bigint) as n_base", f"{over(first, 'least')} as first_word", f"{over(last, 'greatest')} as last_word",
        "array_compact(array(" + ", ".join(f"if(contains(plain, ' {p} '), '{label}', null)" for p, label in wanted.items()) + ")) as base",
    )


def _literal(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the vocabulary: at most as many rows as it has words."""
    held = docs.selectExpr(f"explode(array_intersect({_literal(vocabulary)}, split({_plain('text')}, ' '))) as word")
    return {w: 0 for w in vocabulary} | {r[0]: r[1] for r in held.groupBy("word").count().collect()}


def matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, hash, line, label, containment) for every line and template that reach the threshold."""
    sets = [(label, sorted(set(words_of(t)))) for label, t in templates]
    vocabulary = sorted({w for _, t in sets for w in t})
    many = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (many[w], w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, (label, t) in enumerate(sets):
        t = sorted(t, key=rank.get)
        need = ceil(contained * len(t) - 1e-9)
        rows += [(k, label, w, i, len(t), need, [rank[x] for x in t]) for i, w in enumerate(t[: len(t) - need + 1])]
    prefix = docs.sparkSession.createDataFrame(rows, "template int, label string, word string, at int, n int, need int, ranks array<int>")
    rare = sorted({r[2] for r in rows})
    least = min(r[5] for r in rows)
    # split(...) of a line's words, then those of the vocabulary by rank: their order is the global one
    ranks = "map(" + ", ".join(f"'{w}', {i}" for w, i in rank.items()) + ")"
    docs = docs.selectExpr("doc_id", "coalesce(text, '') as text").withColumn("hash", F.expr("xxhash64(text)"))
    some = docs.where(F.expr(_plain("text")).rlike(" (" + "|".join(map(re.escape, rare)) + ") "))
    lines = some.select("doc_id", "hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    lines = lines.withColumn("plain", F.expr(_plain("text"))).where(F.col("plain").rlike(" (" + "|".join(map(re.escape, rare)) + ") "))
    held = lines.select("doc_id", "hash", "line", F.expr(f"array_sort(transform(array_intersect(split(plain, ' '), {_literal(vocabulary)}), w -> {ranks}[w]))").alias("held")).where(f"size(held) >= {least}")
    words = held.select("doc_id", "hash", "line", "held", F.posexplode("held").alias("pos", "rank"))
    prefix = prefix.withColumn("rank", F.expr(f"{ranks}[word]")).drop("word")
    met = words.join(F.broadcast(prefix), "rank").where("size(held) >= need and 1 + least(n - at - 1, size(held) - pos - 1) >= need")
    found = met.select("doc_id", "hash", "line", "label", "template", "need", (F.size(F.array_intersect("held", "ranks")) / F.col("n")).alias("containment"), F.size(F.array_intersect("held", "ranks")).alias("common")).where("common >= need")
    return found.select("doc_id", "hash", "line", "template", "label", "containment").distinct()


def scanned(docs: DataFrame, wanted: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs."""
    docs = docs.select("doc_id", "text")
    found = matches(docs, templates, contained).groupBy("doc_id", "hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "more", "score")
    d = phrases(docs, wanted).join(found, F.expr("doc_id <=> __id and hash = __hash"), "left")
    listed = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    labels: Column = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"), listed(labels).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
