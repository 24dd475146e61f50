"""Licence scans by diagonal voting: word pairs are joined to template positions, counted by their offset, and each span is verified."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from plumbline.llm.common import ASCII_LOWER, ASCII_UPPER, lower_ascii, read, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of each hashed gram; how far diagonals may lie apart to be one span; share of a template's grams that a span must hold.
GRAM = 2
NEIGHBOURS = 3
COVERAGE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False  # every place counts, and only where all words stand one after another
    telling: tuple[str, ...] = ()  # words that must stand one after another, or it is another licence
    version: int | None = None  # the place of its version number; a number that follows must be 0


#: The phrases with their labels, and wordings of licences in common use.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("mit", "released under the mit license", telling=("the mit",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("apache-2.0", "licensed under the apache license version 2 0", telling=("apache license",), version=6),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", telling=("gnu general public license",), version=8),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", telling=("cc by nc 4",), version=5),
    Template("cc-by-4.0", "licensed under cc by 4 0", telling=("cc by 4",), version=4),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", telling=("mozilla public license",), version=10),
)


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """Each template's rolling word grams: (gram_hash, gram, template, place). A fixed list, so its size is known."""
    from plumbline.functions.frames import small_frame

    rows = []
    for number, t in enumerate(templates):
        words = t.words.split(" ")
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {t.words}")
        rows += [(" ".join(words[i : i + GRAM]), number, i) for i in range(len(words) - GRAM + 1)]
    return small_frame(spark, rows, "gram string, template int, place int").withColumn("gram_hash", F.xxhash64("gram"))


def longest_chain(matches: Column, grams: int) -> Column:
    """(n, first, last) of the longest run of matches (at, back) whose places and positions both grow; ``back`` is the place negated."""
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def step(best: Column, match: Column) -> Column:
        place = -match["back"]
        before = F.coalesce(F.array_max(F.slice(best, 1, place)), none)
        longer = F.struct((before["n"] + 1).alias("n"), F.coalesce(before["first"], match["at"]).alias("first"), (match["at"] + GRAM - 1).alias("last"))
        return F.transform(best, lambda old, i: F.when((i == place) & (longer["n"] > old["n"]), longer).otherwise(old))

    # of one position the last place comes first, so that it cannot follow an earlier one of the same position
    return F.array_max(F.aggregate(F.sort_array(matches), F.array_repeat(none, grams), step))


def tells(template: Template, matches: Column) -> Column:
    """Whether the words that tell a template from other licences stand in a span, none put in or replaced."""
    words, checks = template.words.split(" "), [F.lit(True)]
    for phrase in template.telling:
        wanted = phrase.split(" ")
        at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        own = lambda i, at=at: F.transform(F.filter(matches, lambda m: m["back"] == -(at + i)), lambda m: m["at"] - i)
        starts = own(0)
        for i in range(1, len(wanted) - GRAM + 1):
            starts = F.array_intersect(starts, own(i))
        checks.append(F.size(starts) > 0)
    if template.version is not None:
        major = F.exists(matches, lambda m: (m["back"] == 1 - template.version) & (~m["next"].rlike("^[0-9]+$") | (m["next"] == "0")))
        minor = F.exists(matches, lambda m: m["back"] == -template.version)
        checks.append(major | minor if template.version < len(words) - 1 else major)
    return reduce(lambda x, y: x & y, checks)


def spans(documents: DataFrame, templates: Sequence[Template] = TEMPLATES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, n_words, template, first, last, cover, exact, base): places of templates, and one row without template for each document.

    Every two neighbouring words of a text are hashed and joined to the templates' grams; the words themselves are compared as
    well, so equal hashes of different words don't count. A match votes for its diagonal (place in the text less place in the
    template). Diagonals at most three apart are merged into one span, which lets words be put in or left out; a span of one
    diagonal that covers all is the template word for word. Each span with enough votes is verified: the template's places that
    stand in it in order, each counted once, must cover enough of its grams, and the words that tell it from other licences must
    be there. Of overlapping spans the one with the most places is kept.

    Joined rows are counted on the map side: what is dealt out are a document's diagonals, not its words.
    """
    words = F.regexp_extract_all(lower_ascii(text_of(text)), F.lit(WORD), F.lit(0))
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), words.alias("words"))
    counted = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), "words")
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))
    grams = F.when(F.col("n_words") >= GRAM, F.arrays_zip(pairs.alias("own_gram"), F.slice("words", 3, F.size("words")).alias("next")))
    rolled = counted.select("row", "id", "n_words", F.posexplode_outer(grams).alias("at", "own"))
    rolled = rolled.select("row", "id", "n_words", "at", F.col("own")["own_gram"].alias("own_gram"), F.col("own")["next"].alias("next")).withColumn("own_hash", F.xxhash64("own_gram"))
    known = template_grams(documents.sparkSession, templates)
    voted = rolled.join(F.broadcast(known), (F.col("own_hash") == F.col("gram_hash")) & (F.col("own_gram") == F.col("gram")), "left")
    per_template = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("template") + 1)
    base = F.coalesce(per_template([t.base for t in templates]), F.lit(True))
    match = F.struct("at", (-F.col("place")).alias("back"), F.coalesce("next", F.lit("")).alias("next"))
    diagonals = voted.groupBy("row", "id", "n_words", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count("place").alias("votes"), F.min("place").alias("low"), F.max("place").alias("high"), F.collect_list(F.when(~base, match)).alias("matches")
    )
    order = W.partitionBy("row", "template").orderBy("diagonal")
    length = per_template([len(t.words.split(" ")) for t in templates])
    needed = length - GRAM + 1
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS) | F.col("__base") | F.lag("diagonal").over(order).isNull()
    marked = diagonals.withColumn("__base", base).withColumn("span", F.sum(apart.cast("int")).over(order))
    merged = marked.groupBy("row", "id", "n_words", "template", "span").agg(
        F.sum("votes").alias("votes"), F.max("votes").alias("most"), F.min(F.col("diagonal") + F.col("low")).alias("first"),
        F.max(F.col("diagonal") + F.col("high") + GRAM - 1).alias("last"), F.max("__base").alias("base"), F.flatten(F.collect_list("matches")).alias("matches"),
    )
    exact = F.col("most") == needed
    voted_for = (F.col("votes") / needed >= COVERAGE) & (F.col("last") - F.col("first") < length + NEIGHBOURS * 4)
    told = reduce(lambda other, n: other.when(F.col("template") == n, tells(templates[n], F.col("matches"))), range(1, len(templates)), F.when(F.col("template") == 0, tells(templates[0], F.col("matches"))))
    chain = F.when(~F.col("base") & voted_for, F.when(told, longest_chain(F.col("matches"), max(len(t.words.split(" ")) for t in templates))))
    verified = merged.select("row", "id", "n_words", "template", "first", "last", exact.alias("exact"), "base", needed.alias("needed"), chain.alias("chain"))
    cover = F.when(F.col("base"), F.when(F.col("exact"), 1.0)).otherwise(F.col("chain")["n"] / F.col("needed"))
    sure = verified.withColumn("cover", cover)
    holds = F.when(F.col("base"), F.col("exact")).otherwise(F.col("cover") >= COVERAGE)
    placed = lambda side: F.when(F.col("base"), F.col(side)).otherwise(F.coalesce(F.col("chain")[side].cast("long"), F.col(side)))
    found = sure.select(
        "row", "id", "n_words", F.when(holds, F.col("template")).alias("template"), placed("first").alias("first"), placed("last").alias("last"), "cover", "exact", "base", F.col("chain")["n"].alias("n")
    )
    return best_of_overlapping(found)


def best_of_overlapping(found: DataFrame) -> DataFrame:
    """Spans without those that overlap a better one: more places, then a larger cover, then the template listed first."""
    rival = ~F.col("base") & F.col("template").isNotNull()
    earlier = W.partitionBy("row").orderBy("rival", "first", "last", "template").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("rival"), F.col("last"))).over(earlier)
    alone = ~F.col("rival") | reach.isNull() | (F.col("first") > reach)
    islands = found.withColumn("rival", F.coalesce(rival, F.lit(False))).withColumn("alone", alone)
    islands = islands.withColumn("island", F.count_if(F.col("alone")).over(earlier) + F.col("alone").cast("int"))
    kept = F.collect_list(F.struct((-F.col("n")).alias("less"), (-F.col("cover")).alias("lower"), "template", "first", "last", "cover", "exact", "base"))
    # an island is a row of its own, or spans that overlap
    chosen = F.aggregate(
        F.sort_array("all"), F.slice("all", 1, 0),
        lambda best, s: F.when(F.exists(best, lambda b: (b["first"] <= s["last"]) & (s["first"] <= b["last"])), best).otherwise(F.concat(best, F.array(s))),
    )
    grouped = islands.groupBy("row", "id", "n_words", "island").agg(kept.alias("all"))
    picked = grouped.select("row", "id", "n_words", F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(chosen)).alias("s"))
    return picked.select("row", "id", "n_words", *(F.col("s")[c].alias(c) for c in ("template", "first", "last", "cover", "exact", "base")))


def scan_licences(documents: DataFrame, templates: Sequence[Template] = TEMPLATES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are lower-cased (A-Z) and cut into words. ``n_base`` counts the places of base templates, first_word and last_word
    are their smallest and largest start; labels of both kinds are distinct, sorted and joined by commas; score is the best
    cover of any template, 0 without a match. Null and empty texts have no words and no labels, one word has no gram.
    Repeated rows are documents of their own; other columns are not touched; an empty table gives no rows.
    """
    found = spans(documents, templates, id, text)
    label = F.element_at(F.array(*(F.lit(t.label) for t in templates)), F.col("template") + 1)
    is_base = F.col("base") & F.col("template").isNotNull()
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        found.groupBy("row", "id", "n_words")
        .agg(
            F.count_if(is_base).alias("n_base"),
            F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
            joined(F.when(is_base, label)).alias("base_labels"),
            joined(label).alias("labels"),
            F.round(F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("cover"))), F.lit(0.0)), 6).alias("score"),
        )
        .select(F.col("id").alias(id), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def op9_licence_scan(spark: SparkSession, path: str) -> DataFrame:
    """The licences that every document names; see :func:`scan_licences`."""
    return scan_licences(read(spark, path, "documents").select("doc_id", "text"))


def _oracle() -> str:
    listed = ", ".join(
        f"({i}, '{t.label}', {str(t.base).lower()}, string_split('{t.words}', ' '), {'NULL' if t.version is None else t.version}::INT)" for i, t in enumerate(TEMPLATES)
    )
    phrases = []
    for i, t in enumerate(TEMPLATES):
        for k, phrase in enumerate(t.telling):
            words, wanted = t.words.split(" "), phrase.split(" ")
            at = next(a for a in range(len(words)) if words[a : a + len(wanted)] == wanted)
            phrases.append(f"({i}, {k}, {at}, {at + len(wanted) - GRAM})")
    return rf"""
WITH templates(template, label, base, tw, version) AS (VALUES {listed}),
telling(template, phrase, from_place, to_place) AS (VALUES {", ".join(phrases)}),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tgrams AS (SELECT template, place, tw[place + 1] AS a, tw[place + 2] AS b FROM templates, LATERAL unnest(range(len(tw) - 1)) AS u(place)),
dgrams AS (SELECT doc_id, pos, w[pos + 1] AS a, w[pos + 2] AS b, coalesce(w[pos + 3], '') AS next FROM docs, LATERAL unnest(range(len(w) - 1)) AS u(pos)),
matches AS (SELECT doc_id, template, pos, place, next, pos - place AS diagonal FROM dgrams JOIN tgrams USING (a, b)),
diagonals AS (SELECT doc_id, template, diagonal, count(*) AS votes, min(place) AS low, max(place) AS high FROM matches GROUP BY ALL),
marked AS (SELECT d.*, t.base, len(tw) AS length,
  CASE WHEN base OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {NEIGHBOURS} THEN 1 ELSE 0 END AS apart
  FROM diagonals d JOIN templates t USING (template) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
merged AS (SELECT doc_id, template, base, length, span, sum(votes) AS votes, max(votes) AS most, min(diagonal + low) AS first_at, max(diagonal + high + 1) AS last_at
  FROM numbered GROUP BY ALL),
voted AS (SELECT * FROM merged WHERE NOT base AND votes / (length - 1) >= {COVERAGE} AND last_at - first_at < length + {NEIGHBOURS * 4}),
own AS (SELECT doc_id, template, span, pos, place, next, diagonal FROM voted JOIN numbered n USING (doc_id, template, span) JOIN matches m USING (doc_id, template, diagonal)),
said AS (SELECT doc_id, template, span, phrase FROM own JOIN telling USING (template) WHERE place BETWEEN from_place AND to_place
  GROUP BY doc_id, template, span, phrase, diagonal, from_place, to_place HAVING count(DISTINCT place) = to_place - from_place + 1),
told AS (SELECT v.doc_id, v.template, v.span FROM voted v JOIN templates t USING (template)
  WHERE (SELECT count(DISTINCT phrase) FROM said s WHERE s.doc_id = v.doc_id AND s.template = v.template AND s.span = v.span) = (SELECT count(*) FROM telling l WHERE l.template = v.template)
    AND (version IS NULL
      OR EXISTS (SELECT 1 FROM own o WHERE o.doc_id = v.doc_id AND o.template = v.template AND o.span = v.span AND place = version - 1 AND (NOT regexp_full_match(next, '[0-9]+') OR next = '0'))
      OR version < len(tw) - 1 AND EXISTS (SELECT 1 FROM own o WHERE o.doc_id = v.doc_id AND o.template = v.template AND o.span = v.span AND place = version))),
ordered AS (SELECT doc_id, template, span, list({{'at': pos, 'place': place}} ORDER BY pos, place DESC) AS steps FROM own JOIN told USING (doc_id, template, span) GROUP BY ALL),
chains AS (SELECT doc_id, template, span, list_max(list_reduce(steps, lambda best, m: list_transform(best, lambda old, i:
    CASE WHEN i = m.place + 1 AND coalesce(list_max(best[: m.place]).n, 0) + 1 > old.n
    THEN {{'n': coalesce(list_max(best[: m.place]).n, 0) + 1, 'first': coalesce(list_max(best[: m.place]).first, m.at), 'last': m.at + 1}} ELSE old END),
    list_transform(range(20), lambda k: {{'n': 0::BIGINT, 'first': NULL::BIGINT, 'last': NULL::BIGINT}}))) AS chain FROM ordered),
rivals AS (SELECT doc_id, template, chain.n AS n, chain.n / (len(tw) - 1) AS cover, chain.first AS first, chain.last AS last FROM chains JOIN templates USING (template)
  WHERE chain.n / (len(tw) - 1) >= {COVERAGE}),
chosen AS (SELECT doc_id, unnest(list_reduce(list({{'template': template, 'first': first, 'last': last, 'cover': cover}} ORDER BY n DESC, cover DESC, template, first, last),
    lambda kept, s: CASE WHEN len(list_filter(kept, lambda k: k.first <= s.last AND s.first <= k.last)) > 0 THEN kept ELSE kept || [s] END,
    [{{'template': 0, 'first': 0::BIGINT, 'last': 0::BIGINT, 'cover': 0::DOUBLE}}][:0])) AS s FROM rivals GROUP BY doc_id),
found AS (
  SELECT doc_id, template, TRUE AS base, first_at, 1.0::DOUBLE AS cover FROM merged WHERE base AND most = length - 1
  UNION ALL SELECT doc_id, s.template, FALSE, s.first, s.cover FROM chosen),
per_doc AS (SELECT doc_id, count(*) FILTER (WHERE f.base) AS n_base, min(first_at) FILTER (WHERE f.base) AS first_word, max(first_at) FILTER (WHERE f.base) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE f.base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
  round(max(cover), 6) AS score FROM found f JOIN templates USING (template) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN per_doc USING (doc_id)
"""


OP9_SQL = _oracle()
