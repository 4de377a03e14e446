"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a window of words at a fixed stride, as wide as twice the longest template, so that every passage as
long as a template lies whole in a block. A template T is found where a block holds at least a share ``CONTAINED``
of its words. Words are put in the order of their number of documents, rarest first. A block that holds ``need`` of the
words of T holds one of the |T| - need + 1 rarest, so blocks are joined on those prefix words alone; the number
of template words in the block (length) and the places of the shared word on both sides (position) bound the overlap
before it is counted on the whole sets. The scan then looks at each template so found through windows of about its own
length, where no word that tells one license from another may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.llm.common import broadcast_if_small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {  # fixed values: a phrase and the label it proves
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_NOTICE = ("free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation "
           "either version {} of the license or at your option any later version")
TEMPLATES = (  # statements and notices of public licenses
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", _NOTICE.format("general public license", "2")),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", _NOTICE.format("general public license", "3")),
    ("lgpl-2.1", _NOTICE.format("lesser general public license", "2 1")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-3", _NOTICE.format("lesser general public license", "3")),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("agpl-3", _NOTICE.format("affero general public license", "3")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
              "from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
)
CONTAINED = 0.8
WHOLE_BELOW = 13  # of templates with fewer words than this none may be missing
NEAR = 0.25  # a template is near another that holds all but this share of its words


def telling_words(templates=TEMPLATES, whole_below: int = WHOLE_BELOW, near: float = NEAR) -> list[tuple[list[str], list[list[str]]]]:
    """What tells each template from its near ones of other labels: the words that may not be missing, and groups of words that may not
    all be there. A near template that lacks words of this one makes them necessary; one that holds all of them
    refutes by the words it adds ("lesser", say). Of a short template every word is necessary."""
    sets = [(label, set(text.split())) for label, text in templates]
    told = []
    for (label, words), (_, text) in zip(sets, templates):
        others = [other for name, other in sets if name != label and len(words - other) <= near * len(words)]
        must = words if len(text.split()) < whole_below else set().union(*(words - other for other in others))
        told.append((sorted(must), [sorted(other - words) for other in others if words < other]))
    return told


def _array(words) -> str:
    return "array(" + ", ".join(f"'{word}'" for word in words) + ")"


def _need(n: int, contained: float) -> int:
    return max(1, -int(-round(contained * n, 9) // 1))


def _template_words(spark: SparkSession, templates, contained: float) -> DataFrame:
    rows = []
    for number, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        rows += [(number, label, word, len(words), _need(len(words), contained)) for word in words]
    return spark.createDataFrame(rows, "template int, label string, word string, size int, need int")


def _own_width(text: str) -> int:
    return len(text.split()) + -(-len(text.split()) // 4)


def _in_own_windows(rows: DataFrame, candidates: DataFrame, templates, contained: float) -> DataFrame:
    """Labels and best share of each row over its candidate templates. A window starts at a template word and is a quarter
    longer than the template; it proves the label if it holds enough of the words, all of those that may not be missing, and no
    group of words that speaks for a near template instead."""
    told, specs = telling_words(templates), []
    for number, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        near = sorted({word for group in told[number][1] for word in group})
        specs.append((number, label, words, *told[number], words + near, _need(len(words), contained), _own_width(text)))
    specs = candidates.sparkSession.createDataFrame(
        specs, "template int, label string, words array<string>, must array<string>, refuted array<array<string>>, seen array<string>, need int, width int")
    held = "array_distinct(transform(filter(slice(mine, i + 1, width), y -> y.at < x.at + width), y -> y.word))"
    return (
        candidates.join(rows.filter("places IS NOT NULL").select("row", "places"), "row").join(F.broadcast(specs), "template")
        .withColumn("mine", F.expr("filter(places, x -> array_contains(seen, x.word))")).drop("places")
        .withColumn("windows", F.expr(f"transform(mine, (x, i) -> {held})"))
        .withColumn("proved", F.expr("exists(windows, w -> size(array_intersect(w, words)) >= need AND size(array_except(must, w)) = 0 "
                                     "AND NOT exists(refuted, g -> size(array_except(g, w)) = 0))"))
        .withColumn("share", F.expr("array_max(transform(windows, w -> size(array_intersect(w, words)))) / double(size(words))"))
        .groupBy("row").agg(F.collect_set(F.expr("if(proved, label, null)")).alias("labels"), F.max("share").alias("share"))
    )


def license_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=None,
                    contained: float = CONTAINED, own_windows: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, starts (array of (at, label) of the phrases), labels (array of all
    labels), score (best share of a template found in a block; 0 where no block holds enough of any).

    With ``own_windows`` the blocks only name candidates. Labels then come from windows of a template's own length
    that miss no word which tells the template from its near ones (:func:`telling_words`, for any ``templates``), and score is the best
    share of a candidate in such a window, proved or not, and 1 where a phrase stands.

    Null and empty texts have no words. Rows are numbered, so repeated rows and keys stay apart; ties between
    words of equal frequency go by the word. The text is read once. Only rows that hold enough template words anywhere
    keep the places of those words; everything after works on these places."""
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    in_templates = sorted({word for _, t in templates for word in t.split()})
    known = _array(sorted({*in_templates, *(word for phrase in phrases for word in phrase.split())}))
    enough = [f"size(array_intersect(present, {_array(sorted(set(t.split())))})) >= {_need(len(set(t.split())), contained)}" for _, t in templates]
    enough += [f"size(array_intersect(present, {_array(sorted(set(p.split())))})) = {len(set(p.split()))}" for p in phrases]

    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("row", "key", "words", F.expr(f"array_intersect(words, {known})").alias("present"))
    places = f"filter(transform(words, (w, i) -> named_struct('at', bigint(i), 'word', w)), x -> array_contains({known}, x.word))"
    rows = stored(rows.select("row", "key", F.expr("bigint(size(words))").alias("n_words"), "present",
                              F.expr(f"if({' OR '.join(enough)}, {places}, null)").alias("places")), "licenses")

    # the order of words: number of documents over the whole table, one row per template word
    order = rows.select(F.explode("present").alias("word")).groupBy("word").count()
    spelled = _template_words(spark, templates, contained)
    ranked = spelled.select("word").distinct().join(F.broadcast(order.filter(F.col("word").isin(in_templates))), "word", "left").selectExpr(
        "word", "coalesce(count, 0) AS found")
    ranks = ranked.agg(F.array_sort(F.collect_list(F.struct("found", "word"))).alias("all")).selectExpr("transform(all, x -> x.word) AS ranks")
    ranks = stored(ranks, "license-order").first()["ranks"]  # the template words, rarest first
    place = {word: at for at, word in enumerate(ranks)}
    sets = [sorted({place[word] for word in t.split()}) for _, t in templates]
    prefixes = spark.createDataFrame(
        [(n, label, word, at, len(words), _need(len(words), contained), words)
         for n, ((label, _), words) in enumerate(zip(templates, sets))
         for at, word in enumerate(words[:len(words) - _need(len(words), contained) + 1])],
        "template int, label string, word int, at_template int, size int, need int, whole array<int>")

    stride = max(_own_width(t) if own_windows else len(t.split()) for _, t in templates)
    blocks = (
        rows.filter("places IS NOT NULL").select("row", F.explode("places").alias("x"))
        .select("row", "x.at", F.expr(f"array_position({_array(ranks)}, x.word) - 1").cast("int").alias("word")).filter("word >= 0")
        .select("row", "word", F.explode(F.expr(f"array(at div {stride}, at div {stride} - 1)")).alias("block"))
        .groupBy("row", "block").agg(F.array_sort(F.collect_set("word")).alias("held"))
    )
    found = (
        blocks.select("row", "block", "held", F.posexplode("held").alias("at_block", "word"))
        .join(F.broadcast(prefixes), "word")
        .filter("size(held) >= need AND 1 + least(size(held) - at_block - 1, size - at_template - 1) + least(at_block, at_template) >= need")
        .withColumn("share", F.expr("size(array_intersect(held, whole)) / double(size)")).filter("share * size >= need")
    )
    if own_windows:
        found = _in_own_windows(rows, found.select("row", "template").distinct(), templates, contained)
    else:
        found = found.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("share").alias("share"))
    starts = []
    for phrase, label in phrases.items():
        words = phrase.split()
        fits = " AND ".join([f"places[j + {k}].word = '{word}' AND places[j + {k}].at = x.at + {k}" for k, word in enumerate(words)])
        starts.append(f"transform(filter(transform(places, (x, j) -> named_struct('at', x.at, 'fits', j + {len(words)} <= size(places) AND {fits})), "
                      f"x -> x.fits), x -> named_struct('at', x.at, 'label', '{label}'))")
    starts = f"if(places IS NULL, cast(array() AS array<struct<at:bigint,label:string>>), array_sort(concat({', '.join(starts)})))"
    rows = rows.select("row", "key", "n_words", F.expr(starts).alias("starts"))
    return rows.join(found, "row", "left").select(
        F.col("key").alias(key), "n_words", "starts",
        F.expr("array_sort(array_union(transform(starts, s -> s.label), coalesce(labels, array())))").alias("labels"),
        F.expr("if(size(starts) > 0, 1D, coalesce(share, 0D))" if own_windows else "coalesce(share, 0D)").alias("score"))


def license_scan(docs: DataFrame) -> DataFrame:
    return license_matches(docs, own_windows=True).select(
        "doc_id", "n_words", F.expr("bigint(size(starts))").alias("n_base"),
        F.expr("array_min(transform(starts, s -> s.at))").alias("first_word"), F.expr("array_max(transform(starts, s -> s.at))").alias("last_word"),
        F.expr("concat_ws(',', array_sort(array_distinct(transform(starts, s -> s.label))))").alias("base_labels"),
        F.expr("concat_ws(',', labels)").alias("labels"), "score")
