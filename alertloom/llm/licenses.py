"""License scans by diagonal voting, in DataFrame operations only.

Every rolling run of ``gram`` words of a text is hashed; runs whose hash is one of the templates' are joined with the
template positions they equal, word for word.  A match of text place p with template place q votes for diagonal p - q.
A whole phrase is one diagonal with a vote from every place of its template, and always counts.  An edited one spreads
over neighbouring diagonals, which are merged when they lie at most ``slack`` words apart; the merged span is verified
by the share of the template's grams it covers and by its length.  As one edit breaks several grams, the words around a
diagonal are also aligned with the template's, and the share of words in common decides.  Words that tell a license
from its siblings (lesser, affero, noncommercial) decide over both.

A text's grams never leave its row unless a template has them; the exchange carries votes, and the words of texts that
have any.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    phrase: str
    base: bool = False   # a phrase whose whole occurrences are counted as places
    needs: tuple[str, ...] = ()  # words that an edited occurrence still has
    bars: tuple[str, ...] = ()   # runs of words that make an edited occurrence another license's

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


# Wording of common license notices (fixed values)
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
_NOT_GPL = ("gnu lesser", "gnu affero", "gnu library", "lesser general", "affero general", "library general")
_NC, _SA, _ND = ("noncommercial", "non commercial"), ("sharealike", "share alike"), (
    "noderivatives", "noderivs", "no derivatives", "no derivs")
_NOT_CC_BY = _NC + _SA + _ND
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files", bars=("person or organization", "accompanying documentation")),
    Template("mit", "released under the mit license", needs=("mit",)),
    Template("mit", "licensed under the mit license", needs=("mit",)),
    Template("apache-2", "you may not use this file except in compliance with the license", needs=("not", "except"),
             bars=("only in compliance",)),
    Template("apache-2", "licensed under the apache license version 2 0", needs=("apache", "2")),
    Template("apache-2", "licensed under the apache license 2 0", needs=("apache", "2")),
    Template("gpl", "licensed under the gnu general public license", needs=("gnu",), bars=_NOT_GPL),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license", needs=("gnu",), bars=_NOT_GPL),
    Template("gpl", "under the terms of the gnu general public license version 2", needs=("gnu",), bars=_NOT_GPL),
    Template("gpl", "under the terms of the gnu general public license version 3", needs=("gnu",), bars=_NOT_GPL),
    Template("gpl", "released under the gnu gpl v3", needs=("gpl",)),
    Template("gpl", "licensed under the gnu gpl v2", needs=("gpl",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", needs=("lesser",)),
    Template("lgpl", "licensed under the gnu lesser general public license", needs=("lesser",)),
    Template("lgpl", "under the terms of the gnu library general public license", needs=("library",), bars=("gnu lesser", "gnu affero")),
    Template("agpl", "under the terms of the gnu affero general public license", needs=("affero",)),
    Template("agpl", "licensed under the gnu affero general public license", needs=("affero",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("bsd", "use of this source code is governed by a bsd style license", needs=("bsd",)),
    Template("bsd", "licensed under the 3 clause bsd license", needs=("bsd",)),
    Template("bsd", "licensed under the 2 clause bsd license", needs=("bsd",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                    "hereby granted provided that", bars=("without fee is hereby granted the",)),
    Template("isc", "licensed under the isc license", needs=("isc",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", needs=("mozilla", "2")),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", needs=("mozilla", "2")),
    Template("epl", "made available under the terms of the eclipse public license", needs=("eclipse",)),
    Template("cddl", "subject to the terms of the common development and distribution license", needs=("development",)),
    Template("eupl", "licensed under the european union public licence", needs=("european",)),
    Template("artistic", "distributed under the terms of the artistic license", needs=("artistic",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", needs=("unencumbered",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be "
                     "held liable", needs=("authors",)),
    Template("boost", "distributed under the boost software license version 1 0", needs=("boost",)),
    Template("wtfpl", "do what the fuck you want to public license"),
    Template("openssl", "this product includes software developed by the openssl project", needs=("openssl",)),
    Template("ofl", "licensed under the sil open font license version 1 1", needs=("font",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related rights", needs=("waived",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", needs=("attribution",),
             bars=_NOT_CC_BY),
    Template("cc-by", "licensed under the creative commons attribution 3 0 unported license", needs=("attribution",), bars=_NOT_CC_BY),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", needs=("sharealike",),
             bars=_NC + _ND),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license",
             needs=("noncommercial",), bars=_SA + _ND),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license", needs=("noderivatives",),
             bars=_NC + _SA),
    Template("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
             needs=("noncommercial", "sharealike")),
    Template("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
             needs=("noncommercial", "noderivatives")),
    Template("all-rights-reserved", "all rights reserved"),
)


def _folded(text: Column) -> Column:
    """A-Z lower-cased.  ``lower`` also folds other letters, which makes an ASCII letter of two characters only."""
    return F.when(text.rlike("[\u0130\u212A]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def template_grams(spark: SparkSession, templates: tuple[Template, ...], gram: int) -> DataFrame:
    """One row per place of a template; as many as the given templates have, whatever the data."""
    if any(len(t.words) < gram for t in templates):
        raise ValueError(f"a template needs at least {gram} words")
    rows = [(n, t.label, t.base, len(t.words) - gram + 1, len(t.words), q, " ".join(t.words[q:q + gram]))
            for n, t in enumerate(templates) for q in range(len(t.words) - gram + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, places int, m int, q int, words string")


def template_words(templates: tuple[Template, ...], gram: int) -> Column:
    """An array of structs by template: for each word the bits of its places, the words it needs and the runs that bar it.

    The bits are null where only grams are compared: for templates that one edit may leave without a gram, and for those
    with more places than a number has bits.
    """
    def texts(values) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    def masks(words: list[str]) -> Column:
        if not 2 * gram <= len(words) < 63:
            return F.lit(None).cast("map<string,bigint>")
        return F.create_map(*(x for w in dict.fromkeys(words) for x in (
            F.lit(w), F.lit(sum(1 << q for q, y in enumerate(words) if y == w)).cast("long"))))

    return F.array(*(F.struct(masks(t.words).alias("masks"), texts(t.needs).alias("needs"), texts(t.bars).alias("bars")) for t in templates))


def _aligned(words: Column, masks: Column, m: Column) -> Column:
    """Length of the longest common subsequence of the words and a template, a bit for each place of the latter."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), m) - 1

    def step(open_: Column, word: Column) -> Column:
        met = open_.bitwiseAND(F.coalesce(F.try_element_at(masks, word), F.lit(0).cast("long")))
        return (open_ + met).bitwiseOR(open_ - met).bitwiseAND(full)

    return m - F.bit_count(F.aggregate(words, full, step))


def gram_hits(docs: DataFrame, templates: DataFrame, gram: int, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _key, n_words, hits, text_words)`` per row: places and words of the grams whose hash a template has.

    ``text_words`` are all words of a text with hits, null for others.
    """
    hashes = [r[0] for r in templates.select(F.xxhash64(*(F.split("words", " ")[i] for i in range(gram)))).distinct().collect()]
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[id_col], docs[text_col]).alias("_key"),
                       F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    split = rows.select("_id", "_key", F.split(_folded(F.col("_text")), _SEPARATORS).alias("w"))
    # An empty first or last entry stands for a separator at the text's end.
    placed = split.select(
        "_id", "_key", "w", (F.get("w", F.lit(0)) == "").cast("int").alias("head"),
        F.greatest(F.size("w") - (F.get("w", F.lit(0)) == "").cast("int")
                   - (F.get("w", F.size("w") - 1) == "").cast("int"), F.lit(0)).alias("n"))
    found = F.when(F.col("n") >= gram, F.filter(
        F.sequence(F.col("head"), F.col("head") + F.col("n") - gram),
        lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(gram))).isin(hashes))).otherwise(F.array().cast("array<int>"))
    return placed.withColumn("at", found).select(
        "_id", "_key", F.col("n").cast("long").alias("n_words"), F.transform("at", lambda i: F.struct(
            (i - F.col("head")).alias("p"), F.array_join(F.slice("w", i + 1, gram), " ").alias("words"))).alias("hits"),
        F.when(F.size("at") > 0, F.slice("w", F.col("head") + 1, F.col("n"))).alias("text_words"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text",
         gram: int = 3, slack: int = 3, cover: float = 0.75, stretch: float = 1.5) -> DataFrame:
    """``(<id>, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row.

    A place is a text position from which all words of a base phrase stand in a row; overlapping and nested places
    all count.  ``labels`` adds those of templates that stand there whole, or whose merged span covers at least ``cover``
    of the template's grams, or its surroundings that share of its words in order, within ``stretch`` times its length;
    the latter two need the template's ``needs`` and none of its ``bars``.  Templates under two grams long are compared
    by grams alone: one edit may leave them without any.  ``score`` is the largest share of grams of any template.  Both
    label lists are distinct, sorted and joined by commas (empty if none).  Null and empty texts have no words; repeated rows
    repeat; rows with a null id are kept.  An empty table gives an empty result.
    """
    spots = template_grams(docs.sparkSession, templates, gram)
    rows = stage(gram_hits(docs, spots, gram, id_col, text_col), "gram-hits")
    hits = rows.where(F.size("hits") > 0).select("_id", "_key", F.explode("hits").alias("h")).select("_id", "_key", "h.p", "h.words")
    kind = ["_id", "_key", "template", "label", "base", "places", "m"]
    votes = hits.join(F.broadcast(spots), "words").select(*kind, "q", "p", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    diagonals = votes.groupBy(*kind, "diagonal").agg(
        F.collect_list("q").alias("qs"), F.min("p").alias("start"), (F.max("p") + gram).alias("end"))
    in_order = Window.partitionBy("_id", "_key", "template").orderBy("diagonal")
    at_whole = F.size("qs") == F.col("places")
    pad = F.least(F.lit(slack), F.floor(F.col("m") * ((stretch - 1) / 2)).cast("int"))
    # where to look for the template's words, if not all of its grams are there
    around = F.when(~at_whole & (F.col("m") >= 2 * gram), F.struct(
        F.lit(False).alias("by_grams"), (F.col("diagonal") - pad).alias("start"),
        (F.col("diagonal") + F.col("m") + pad).alias("end")))
    merged = diagonals.withColumn(
        "apart", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_order) > slack).cast("int"), F.lit(0))).withColumn(
        "span", F.sum("apart").over(in_order)).groupBy(*kind, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("covered"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.max(at_whole).alias("exact"),
        F.collect_list(around).alias("around"),
        F.sum(F.when(F.col("base") & at_whole, 1).otherwise(0)).alias("whole"),
        F.min(F.when(at_whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(at_whole, F.col("diagonal"))).alias("last"))
    share = F.col("covered") / F.col("places")
    is_base = F.col("whole") > 0
    by_grams = (share >= cover) & (F.col("end") - F.col("start") <= F.col("m") * stretch)
    edited = F.when(~F.col("exact"), F.struct("template", "label", "m", F.concat("around", F.when(by_grams, F.array(
        F.struct(F.lit(True).alias("by_grams"), "start", "end"))).otherwise(F.slice("around", 1, 0))).alias("places")))
    per_row = merged.groupBy("_id", "_key").agg(
        F.sum("whole").alias("n_base"), F.min(F.when(is_base, F.col("first"))).alias("first_word"),
        F.max(F.when(is_base, F.col("last"))).alias("last_word"),
        _labels(F.when(is_base, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("exact_labels"),
        F.collect_list(edited).alias("edited"), F.max(share).alias("score"))
    found = per_row.select(F.col("_id").alias("_sid"), F.col("_key").alias("_skey"), *per_row.columns[2:])
    both = rows.select("_id", "_key", "n_words", "text_words").join(
        found, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_key") == F.col("_skey")), "left")
    forms = template_words(templates, gram)

    def verified(span: Column) -> Column:
        form = F.get(forms, span["template"])

        def at(place: Column) -> Column:
            low = F.greatest(place["start"], F.lit(0))
            words = F.slice("text_words", low + 1, F.greatest(place["end"] - low, F.lit(0)))
            run = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
            own = F.forall(form["needs"], lambda x: F.array_contains(words, x)) & ~F.exists(
                form["bars"], lambda x: F.contains(run, F.concat(F.lit(" "), x, F.lit(" "))))
            enough = F.coalesce(_aligned(words, form["masks"], span["m"]) >= span["m"] * cover, F.lit(False))
            return own & (place["by_grams"] | enough)
        return F.exists(span["places"], at)

    both = both.withColumn("labels", F.array_join(F.array_sort(F.array_union("exact_labels", F.transform(
        F.filter("edited", verified), lambda span: span["label"]))), ","))
    return both.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _labels(label: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(label)), ",")


def scan_sql(templates: tuple[Template, ...], words: str, gram: int = 3, slack: int = 3, cover: float = 0.75,
             stretch: float = 1.5) -> str:
    """The result of :func:`scan` over ``documents`` in SQL; ``words`` is the SQL of a text's word list.

    It verifies by grams alone: labels are the same where each template stands whole and apart, or not at all.
    """
    values = ", ".join(f"({n}, '{t.label}', {t.base}, '{t.phrase}')" for n, t in enumerate(templates))
    return f"""
with d as (select doc_id, coalesce({words}, []) as w from documents),
 t as (select n as template, label, base, string_split(phrase, ' ') as w from (values {values}) v(n, label, base, phrase)),
 tg as (select template, label, base, len(w) as m, len(w) - {gram} + 1 as places, q,
   array_to_string(w[q + 1:q + {gram}], ' ') as g from (select *, unnest(range(len(w) - {gram} + 1)) as q from t)),
 dg as (select doc_id, p, array_to_string(w[p + 1:p + {gram}], ' ') as g
   from (select *, unnest(range(len(w) - {gram} + 1)) as p from d where len(w) >= {gram})),
 votes as (select distinct doc_id, template, label, base, places, m, q, p, p - q as diagonal from dg join tg using (g)),
 diagonals as (select doc_id, template, label, base, places, m, diagonal, list(q) as qs, min(p) as s, max(p) + {gram} as e
   from votes group by all),
 steps as (select *, coalesce((diagonal - lag(diagonal) over x > {slack})::int, 0) as apart from diagonals
   window x as (partition by doc_id, template order by diagonal)),
 spans as (select *, sum(apart) over (partition by doc_id, template order by diagonal) as span from steps),
 merged as (select doc_id, template, label, base, places, m, span, len(list_distinct(flatten(list(qs)))) as covered,
   max(e) - min(s) as length, count(*) filter (base and len(qs) = places) as whole,
   min(diagonal) filter (len(qs) = places) as f, max(diagonal) filter (len(qs) = places) as l from spans group by all),
 rated as (select *, covered / places as share,
   whole > 0 or (covered / places >= {cover} and length <= m * {stretch}) as good from merged),
 per_row as (select doc_id, sum(whole) as n_base, min(f) filter (whole > 0) as first_word, max(l) filter (whole > 0) as last_word,
   array_to_string(list_sort(list(distinct label) filter (whole > 0)), ',') as base_labels,
   array_to_string(list_sort(list(distinct label) filter (good)), ',') as labels, max(share) as score from rated group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join per_row using (doc_id)"""
