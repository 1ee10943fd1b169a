"""Licence scans by a positional index of rare words, with built-in functions only.

Templates are licence notices. The index maps each of their words to its postings: templates and
positions in them. A file's licence words are ranked by IDF, counted over all documents. A notice of
which ``m`` words must stand at their places at least has ``n`` words in the file; of these the
``n - m + 2`` of the highest IDF are looked up, as two of them must then be among those at their
places. Each place of such a word votes, through its postings, for where a template would begin.
Beginnings with two votes, so where two postings agree in relative position, are verified: the
template's key phrase must stand there word by word. Its label is given if at least ``SHARE`` of its
words stand at their places. So no place is lost, whichever words the file lacks.

The templates are a constant of this module or a parameter, so expressions, index and the
counts that reach the driver are as large as these templates. Texts are read twice, never
moved, and every step is an expression of the row.

A null is an empty text, which has no word and no label. Rows that share an id, or repeat, are scanned
each for itself. Among words of the same IDF the lesser comes first; that changes no result. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = 0.6


@dataclass(frozen=True)
class Template:
    """A label, a notice and the phrase in it that must be there, all as lower-case words."""

    label: str
    notice: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def phrase(self) -> list[str]:
        return self.key.split()

    @property
    def at(self) -> int:
        """The phrase's first word in the notice."""
        words, phrase = self.words, self.phrase
        return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


# The phrases and labels of the base.
BASE = (
    Template("cc-by", "cc by", "cc by"),
    Template("gpl", "general public license", "general public license"),
    Template("reserved", "all rights reserved", "all rights reserved"),
)
NOTICES = (
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
             "with the license you may obtain a copy of the license at", "apache license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
             "disclaimer in the documentation and or other materials provided with the distribution", "reproduce the above copyright notice"),
    Template("bsl-1.0", "boost software license version 1 0", "boost software license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "to the extent possible under law the author has waived all copyright under cc0", "waived all copyright"),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
             "eclipse public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation", "terms of the gnu general public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
             "files the software to deal in the software without restriction", "to deal in the software without restriction"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
             "for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
VOTES = 2
"""Postings that must agree on where a template begins; one in templates that may match by a single word."""
_NUMBER = 1 << 40
"""Candidates are one number: the template's times this, and the beginning moved to be no less than 0."""


def _words(text: str) -> Column:
    """Lower-cased words; the first and the last entry may be empty, no other."""
    return F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS)


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the templates' words stands."""
    found = docs.select(F.explode(F.array_intersect(_words(text_col), F.array(*map(F.lit, words)))).alias("word"))
    counts = dict(found.groupBy("word").count().collect())
    return {w: counts.get(w, 0) for w in words}


def least_right(t: Template, share: float) -> int:
    """How many words of a template stand at their places at least where it is found."""
    n = len(t.words)
    return next(m for m in range(len(t.phrase), n + 1) if m / float(n) >= min(share, 1.0))


def postings(templates: tuple[Template, ...]) -> dict[str, list[tuple[int, int]]]:
    """The index: for each word of the templates where it stands, as (template, position)."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for position, word in enumerate(t.words):
            out.setdefault(word, []).append((k, position))
    return out


def _literals(values: list) -> Column:
    return F.array(*map(F.lit, values))


def _has(word: Column) -> Column:
    return F.array_contains("own", word)


def _looked_up(t: Template, least: int, rank: dict[str, int]) -> Column:
    """The template's words that the file has, but for the ``least - VOTES`` of the lowest IDF; none if
    the file lacks a word of the key phrase."""
    here = F.filter(_literals(sorted(t.words, key=rank.__getitem__)), _has)
    whole = F.forall(_literals(sorted(set(t.phrase), key=rank.__getitem__)), _has)
    return F.when(whole, F.slice(here, F.lit(1), F.greatest(F.size(here) - max(least - VOTES, 0), F.lit(0)))).otherwise(
        F.array().cast("array<string>"))


def _candidates(index: dict[str, list[tuple[int, int]]], most: int) -> Column:
    """Votes of all places of words that are looked up, sorted."""
    moved = F.create_map(*[c for w, found in sorted(index.items()) for c in (
        F.lit(w), _literals([k * _NUMBER + most - position for k, position in found]))])
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("looked", w), i)), lambda i: i.isNotNull())
    votes = F.transform(at, lambda i: F.transform(F.element_at(moved, F.get("words", i)), lambda p: p + i))
    return F.when(F.size("looked") > 0, F.sort_array(F.flatten(votes))).otherwise(F.array().cast("array<bigint>"))


def _agreed(single: list[int]) -> Column:
    """Candidates that ``VOTES`` postings agree on, or one of a template in ``single``."""
    def enough(v: Column, i: Column) -> Column:
        twice = F.coalesce(F.get("votes", i + (VOTES - 1)) == v, F.lit(False))
        return twice | F.shiftright(v, 40).isin(single) if single else twice

    return F.array_distinct(F.filter("votes", enough))


def _places(k: int, t: Template, most: int) -> Column:
    """Where the notice begins, in array positions, for each candidate with its phrase."""
    def begin(c: Column) -> Column:
        return (c - (k * _NUMBER + most)).cast("int")

    def stands(c: Column) -> Column:
        test = c.between(F.lit(k * _NUMBER), F.lit((k + 1) * _NUMBER - 1))
        for position, word in enumerate(t.phrase, t.at):
            test = test & (F.get("words", begin(c) + position) == word)
        return F.coalesce(test, F.lit(False))

    return F.transform(F.filter("agreed", stands), begin)


def _share(t: Template, places: str) -> Column:
    """The best share of the template's words that stand at their places, or 0."""
    def share(begin: Column) -> Column:
        right = F.filter(_literals(t.words), lambda w, i: F.coalesce(F.get("words", begin + i) == w, F.lit(False)))
        return F.size(right) / F.lit(float(len(t.words)))

    return F.coalesce(F.array_max(F.transform(places, share)), F.lit(0.0))


def _plus(n: int) -> Callable[[Column], Column]:
    return lambda i: i + n


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple[Template, ...] = BASE,
         notices: tuple[Template, ...] = NOTICES, share: float = SHARE) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_base`` (places of base phrases), ``first_word``
    and ``last_word`` (their least and greatest start), ``base_labels``, ``labels``, ``score`` (the best
    share of a template with a label; a base phrase is whole) and ``rest``, a struct of its columns."""
    every = base + notices
    least = [least_right(t, 0.0 if k < len(base) else share) for k, t in enumerate(every)]
    index, most = postings(every), max(len(t.words) for t in every)
    frequency = document_frequencies(docs, sorted(index), text_col)
    rank = {w: r for r, w in enumerate(sorted(index, key=lambda w: (frequency[w], w)))}
    rows = frames.packed(docs, id_col, text_col).select("doc_id", _words("text").alias("words"), "rest")
    rows = rows.withColumn("own", F.array_intersect(_literals(sorted(rank, key=rank.__getitem__)), F.col("words")))
    rows = rows.withColumn("looked", F.array_distinct(F.flatten(F.array(*[_looked_up(t, m, rank) for t, m in zip(every, least)]))))
    rows = rows.withColumn("votes", _candidates(index, most))
    rows = rows.withColumn("agreed", _agreed([k for k, m in enumerate(least) if m < VOTES]))
    rows = rows.withColumns({f"place_{k}": _places(k, t, most) for k, t in enumerate(every)})
    rows = rows.withColumns({f"share_{k}": _share(t, f"place_{k}") for k, t in enumerate(every)})
    leading = (F.get("words", F.lit(0)) == "").cast("int")
    trailing = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    starts = F.concat(*[F.transform(f"place_{k}", _plus(t.at)) for k, t in enumerate(base)])
    rows = rows.withColumns({"starts": starts, "leading": leading, "n_words": (F.size("words") - leading - trailing).cast("long")})
    found = [(t.label, F.col(f"share_{k}"), 0.0 if k < len(base) else share) for k, t in enumerate(every)]
    label = lambda few: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[
        F.when((s > 0) & (s >= least), F.lit(name)) for name, s, least in few]), lambda x: x.isNotNull()))), ",")
    score = F.greatest(F.lit(0.0), *[F.when((s > 0) & (s >= least), s).otherwise(0.0) for _, s, least in found])
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        (F.array_min("starts") - F.col("leading")).cast("long").alias("first_word"),
        (F.array_max("starts") - F.col("leading")).cast("long").alias("last_word"),
        label(found[:len(base)]).alias("base_labels"), label(found).alias("labels"), score.alias("score"), "rest")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(frames.documents(spark, folder).select("doc_id", "text")).drop("rest")


def oracle() -> str:
    """The same rows in DuckDB's SQL: every start of every phrase is tried."""
    def places(t: Template) -> str:
        tests = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(t.phrase))
        return f"list_filter(range(len(w)), lambda i: {tests})"

    def share(k: int, t: Template) -> str:
        right = " + ".join(f"coalesce((i + {j - t.at + 1} > 0 and w[greatest(i + {j - t.at + 1}, 1)] = '{x}')::int, 0)" for j, x in enumerate(t.words))
        return f"coalesce(list_max(list_transform(p{k}, lambda i: ({right}) / {float(len(t.words))}::double)), 0.0::double)"

    every = BASE + NOTICES
    n = len(BASE)
    least = lambda k: f"s{k} > 0 and s{k} >= {0.0 if k < n else SHARE}"
    label = lambda ks: ("list_aggregate(list_sort(list_distinct(list_filter([" + ", ".join(
        f"case when {least(k)} then '{every[k].label}' end" for k in ks) + "], lambda x: x is not null))), 'string_agg', ',')")
    return f"""
with a as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select *, {", ".join(f"{places(t)} as p{k}" for k, t in enumerate(every))} from a),
c as (select *, {", ".join(f"{share(k, t)} as s{k}" for k, t in enumerate(every))}, list_concat(list_concat(p0, p1), p2) as starts from b)
select doc_id, len(w)::bigint as n_words, len(starts)::bigint as n_base, list_min(starts)::bigint as first_word, list_max(starts)::bigint as last_word,
  coalesce({label(range(n))}, '') as base_labels, coalesce({label(range(len(every)))}, '') as labels,
  greatest(0.0::double, {", ".join(f"case when {least(k)} then s{k} else 0.0 end" for k in range(len(every)))}) as score
from c"""
