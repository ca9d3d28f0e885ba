"""License scan by diagonal voting, made of DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"          # after lower-casing

# fixed values: phrase, label; every place of these counts
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# notices the method looks for beyond the phrases
NOTICES = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files to deal in the software without restriction",
        "mit-grant",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
        "apache-notice",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        "gpl-notice",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

ACCEPT = 80      # percent of a notice's word pairs that a verified span must have, in order


def _pairs(base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> list[tuple]:
    """(template, label, base, pairs, drift, at, first, second) for every word pair of every template.

    drift: words that may be added or missing, so that a span of that width can still be accepted.
    """
    rows = []
    for number, (phrase, label) in enumerate([*base, *notices]):
        words = phrase.split()
        pairs = len(words) - 1
        rows += [
            (number, label, number < len(base), pairs, pairs * (100 - ACCEPT) // 100, at, first, second)
            for at, (first, second) in enumerate(zip(words, words[1:], strict=False))
        ]
    return rows


def _longest_chains(hits: Column) -> Column:
    """For every hit (place, at) the longest chain that ends there: place, at, length, start.

    A chain rises in the text and in the template with every step; of chains equally
    long the one that starts last counts.
    """
    place, at, length, start = (F.lit(0).cast("long") for _ in range(4))
    none = F.slice(F.array(F.struct(place.alias("place"), at.alias("at"), length.alias("length"), start.alias("start"))), 1, 0)

    def step(chains: Column, hit: Column) -> Column:
        before = F.filter(chains, lambda c: (c["place"] < hit["place"]) & (c["at"] < hit["at"]))
        best = F.array_max(F.transform(before, lambda c: F.struct(c["length"].alias("length"), c["start"].alias("start"))))
        here = F.struct(
            hit["place"].alias("place"), hit["at"].alias("at"),
            (F.coalesce(best["length"], F.lit(0)) + 1).cast("long").alias("length"),
            F.coalesce(best["start"], hit["place"]).alias("start"),
        )
        return F.concat(chains, F.array(here))

    return F.aggregate(F.array_sort(hits), none, step)


def _alignments(docs: DataFrame, base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """A row per text row, template and diagonal with votes, and one per text row without template.

    ``span`` is the verified span of the diagonals from this one to ``drift`` further:
    first and last word and share. The row without template has ``copies`` and ``n_words``.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(
        _pairs(base, notices),
        "template int, label string, base boolean, pairs long, drift long, at long, t_first string, t_second string",
    ).withColumn("t_gram", F.xxhash64("t_first", "t_second"))
    widest = max((row[4] for row in _pairs(base, notices)), default=0)
    row = ["doc_id", "key", "bytes"]
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("key"), F.octet_length("text").alias("bytes"),
        F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), 0).alias("words"),
    )
    # the last word has no second one: its row, or the null row of a text without words, stands for the text
    grams = words.select(
        *row,
        F.posexplode_outer(
            F.transform("words", lambda word, i: F.struct(word.alias("first"), F.get(F.col("words"), i + 1).alias("second")))
        ).alias("place", "pair"),
    ).select(*row, F.col("place").cast("long").alias("place"), "pair.first", "pair.second", F.xxhash64("pair.first", "pair.second").alias("gram"))
    hits = grams.join(
        F.broadcast(known),
        (F.col("gram") == F.col("t_gram")) & (F.col("first") == F.col("t_first")) & (F.col("second") == F.col("t_second")),
        "left",
    ).where("template is not null or second is null")
    votes = hits.groupBy(*row, "template", "label", "base", "pairs", "drift", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("found"),
        F.count_if(F.col("second").isNull()).alias("copies"),
        F.max(F.when(F.col("second").isNull(), F.coalesce(F.col("place") + 1, F.lit(0)))).alias("n_words"),
    ).repartition(*row)
    near = Window.partitionBy(*row, "template").orderBy("diagonal").rangeBetween(0, widest)
    band = F.filter(F.col("band"), lambda d: d["diagonal"] <= F.col("diagonal") + F.col("drift"))
    band_hits = F.flatten(
        F.transform(band, lambda d: F.transform(d["found"], lambda at: F.struct((d["diagonal"] + at).alias("place"), at.alias("at"))))
    )
    share = lambda c: c["length"] / F.greatest(F.col("pairs"), c["place"] - c["start"] + 1)
    spans = F.transform(
        _longest_chains(band_hits),
        lambda c: F.struct(share(c).alias("share"), (-c["start"]).alias("back"), (c["place"] + 1).alias("last")),
    )
    return (
        votes.withColumn("band", F.collect_list(F.struct("diagonal", "found")).over(near))
        .withColumn("span", F.when(F.col("template").isNotNull(), F.array_max(spans)))
        .withColumn("full", F.col("base") & (F.size("found") == F.col("pairs")))
        .drop("band", "found")
    )


def scan(
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = BASE,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """License findings of every row of ``docs`` (doc_id, text).

    Hashes of all rolling word pairs meet the pairs of the templates in a broadcast
    join (the table is as large as the templates), the words are compared, and votes
    are counted by diagonal: place in the text less place in the template. A phrase
    stands where a diagonal has all its pairs. Each diagonal is merged with those up to
    a fifth of the template's pairs further, so a notice with words added or missing
    keeps its votes. The merged votes are verified: the longest chain of pairs that rise
    in text and template gives the span from its first to its last pair, and the span's
    share is the chain's pairs by those of the template or of the span, whichever are
    more. A notice counts where a share is ``ACCEPT`` percent; score is the best share
    of any template.

    Null or empty text has no words, no labels (empty strings) and score 0. Rows are
    keyed by doc_id and text, so repeated and null ids are fine; equal rows are scanned
    together and each returned. Other columns are not read.
    """
    row = ["doc_id", "key", "bytes"]
    found = _alignments(docs, base, notices)
    stands = F.col("full") | (~F.col("base") & (F.col("span.share") >= ACCEPT / 100))
    each = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    return (
        found.groupBy(*row)
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count_if("full").cast("long").alias("n_base"),
            F.min(F.when(F.col("full"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("full"), F.col("diagonal"))).alias("last_word"),
            each(F.col("full")).alias("base_labels"),
            each(stands).alias("labels"),
            F.coalesce(F.max("span.share"), F.lit(0.0)).alias("score"),
            F.explode(F.array_repeat(F.lit(1), F.sum("copies").cast("int"))).alias("_copy"),
        )
        .drop("key", "bytes", "_copy")
    )


def spans(
    docs: DataFrame,
    base: Sequence[tuple[str, str]] = BASE,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """(doc_id, label, first_word, last_word, share): the verified spans that ``scan`` accepts.

    Phrases stand whole; of a notice, spans of neighbouring diagonals that are equal are one.
    """
    found = _alignments(docs, base, notices)
    return (
        found.where(F.col("full") | (~F.col("base") & (F.col("span.share") >= ACCEPT / 100)))
        .select(
            "doc_id", "key", "bytes", "label", (-F.col("span.back")).alias("first_word"),
            F.col("span.last").alias("last_word"), "span.share",
        )
        .distinct()
        .drop("key", "bytes")
    )


def sql(base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES) -> str:
    """The rule of ``scan`` as DuckDB SQL.

    c: chains by length k within a band that starts at ``low``; each step goes up in place and
    in the template. The longest chain of a hit counts, and of equal ones the latest start.
    """
    values = ", ".join(
        f"({number},'{label}',{str(is_base).lower()},{pairs},{drift},{at},'{a}','{b}')"
        for number, label, is_base, pairs, drift, at, a, b in _pairs(base, notices)
    )
    return f"""
with recursive t(template, label, base, pairs, drift, place, a, b) as (values {values}),
d as materialized (select row_number() over () as row_id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
g as (select row_id, unnest(range(1, len(w))) as i, unnest(w[:-2]) as x, unnest(w[2:]) as y from d where len(w) > 1),
h as materialized (select row_id, template, label, base, pairs, drift, place as u, i - 1 as p, i - 1 - place as diagonal
      from g join t on x = a and y = b),
o as (select distinct row_id, template, diagonal as low from h),
v as materialized (select row_id, template, low, pairs, p, u from o join h using (row_id, template)
      where diagonal between low and low + drift),
c as (select row_id, template, low, pairs, p, u, p as start, 1 as k from v
      union all
      select v.row_id, v.template, v.low, v.pairs, v.p, v.u, max(c.start) as start, max(c.k) + 1 as k
      from c join v on c.row_id = v.row_id and c.template = v.template and c.low = v.low and c.p < v.p and c.u < v.u
      group by v.row_id, v.template, v.low, v.pairs, v.p, v.u),
l as (select row_id, template, low, pairs, p, max(k) as k, arg_max(start, k) as start
      from c group by row_id, template, low, pairs, p, u),
s as (select row_id, template, max(k::double / greatest(pairs, p - start + 1)) as share from l group by row_id, template),
n as (select row_id, template, diagonal from h where base group by row_id, template, diagonal, pairs having count(*) = pairs),
f as (select row_id, count(*) as n_base, min(diagonal) as first_word, max(diagonal) as last_word from n group by row_id),
z as (select distinct template, label, base from t),
b as (select row_id, string_agg(distinct label, ',' order by label) as base_labels from n join z using (template) group by row_id),
y as (select row_id, template from n union select row_id, template from s join z using (template)
      where not base and share >= {ACCEPT} / 100.0),
m as (select row_id, string_agg(distinct label, ',' order by label) as labels from y join z using (template) group by row_id),
q as (select row_id, max(share) as score from s group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
       cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0)::double as score
from d left join f using (row_id) left join b using (row_id) left join m using (row_id) left join q using (row_id)
"""
